"""Homomorphic multiset hashes of documents' paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_document, pieces

#: Lanes of 16 bits. Sums are taken modulo 2**16; 256 lanes cost about 2**(2 * sqrt(256 * 16)) = 2**128 steps to forge by a generalised birthday attack.
LANES = 256


def paragraphs(text: str) -> list[str]:
    """Lines without the blanks, tabs and carriage returns at their ends; empty ones don't count."""
    return [p for line in text.split("\n") if (p := line.strip(" \t\r"))]


def expand(paragraph: str, lanes: int = LANES) -> bytes:
    """The paragraph's wide vector: big-endian 16-bit lanes of SHA-256 in counter mode over the paragraph's own SHA-256."""
    seed = sha256(paragraph.encode("utf-8", "surrogatepass")).hexdigest()
    return b"".join(sha256(f"{seed}:{i}".encode()).digest() for i in range(-(-lanes // 16)))[: 2 * lanes]


def vector(parts: list[str], lanes: int = LANES) -> np.ndarray:
    """Sum of the parts' vectors modulo 2**16; the order of the parts makes no difference, their repeats do."""
    if not parts:
        return np.zeros(lanes, np.uint16)
    wide = np.frombuffer(b"".join(expand(p, lanes) for p in parts), ">u2").reshape(len(parts), lanes)
    return wide.sum(axis=0, dtype=np.uint64).astype(np.uint16)


def to_hex(v: np.ndarray) -> str:
    return v.astype(">u2").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16)


def combine(a: str, b: str) -> str:
    """Fingerprint of the union (with repeats) of two multisets of paragraphs."""
    return to_hex(from_hex(a) + from_hex(b))


def insert(fingerprint: str, paragraph: str) -> str:
    """Fingerprint after a paragraph has come, without the others' text. A paragraph that is blank changes nothing."""
    v = from_hex(fingerprint)
    return to_hex(v + vector(paragraphs(paragraph), len(v)))


def delete(fingerprint: str, paragraph: str) -> str:
    """Fingerprint after a paragraph has gone; the inverse of insert."""
    v = from_hex(fingerprint)
    return to_hex(v - vector(paragraphs(paragraph), len(v)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """(id, n_paragraphs, fingerprint as 4 hex digits a lane) of each row.

    Two documents have equal fingerprints if they hold the same paragraphs equally often, in any order. A null text has a
    null fingerprint and count; an empty or blank one has the zero vector and 0. Repeated rows give repeated rows, an empty
    table an empty one, and other columns are ignored. Map-only: no shuffle.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                parts = [None if t is None else paragraphs(t) for t in texts]
                yield pa.record_batch([
                    ids,
                    pa.array([None if p is None else len(p) for p in parts], pa.int64()),
                    pa.array([None if p is None else to_hex(vector(p, lanes)) for p in parts], pa.string()),
                ], ["id", "n_paragraphs", "fingerprint"])

    return per_document(docs, id_col, text_col, "n_paragraphs long, fingerprint string", f)


def equal_documents(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(kept id, id) of each document that holds just the paragraphs of another with a lower id; blank ones don't count."""

    filled = prints.where("n_paragraphs > 0").select(F.col(f"`{id_col}`").alias("id"), "fingerprint")
    firsts = filled.groupBy("fingerprint").agg(F.min("id").alias("kept_id"), F.countDistinct("id").alias("n")).where("n > 1").drop("n")
    return filled.join(firsts, "fingerprint").where("id > kept_id").select("kept_id", F.col("id").alias(id_col)).distinct()


def oracle(lanes: int = LANES) -> str:
    return f"""WITH lines AS (SELECT doc_id, trim(p, chr(32) || chr(9) || chr(13)) AS p FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents)),
    seeds AS (SELECT doc_id, sha256(p) AS s FROM lines WHERE p <> ''),
    blocks AS (SELECT doc_id, i, sha256(s || ':' || i) AS h FROM seeds, range({lanes // 16}) t(i)),
    lanes AS (SELECT doc_id, i * 16 + j AS lane, sum(('0x' || substr(h, (j * 4 + 1)::INT, 4))::INT) % 65536 AS v FROM blocks, range(16) t(j) GROUP BY ALL),
    sums AS (SELECT doc_id, string_agg(printf('%04x', v::INT), '' ORDER BY lane) AS fingerprint FROM lanes GROUP BY doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM seeds GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS n_paragraphs,
      CASE WHEN text IS NOT NULL THEN coalesce(fingerprint, repeat('0', {4 * lanes})) END AS fingerprint
    FROM documents LEFT JOIN sums USING (doc_id) LEFT JOIN counts USING (doc_id)"""
