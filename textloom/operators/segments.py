"""Row-expanding operators: sentences, chunks, rule-based training segments, splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.text import let
from textloom.operators.lineage import sliced

#: (kind, pattern of named parts, priority): the higher comes first; all that match contribute.
RULES: list[tuple[str, str, int]] = [
    ("qa", r"(?is)\bQ(?:uestion)?\s*[:.]\s*(?P<instruction>.+?)\s*\bA(?:nswer)?\s*[:.]\s*(?P<output>.+?)(?=\bQ(?:uestion)?\s*[:.]|\Z)", 30),
    ("task", r"(?is)\bTask\s*:\s*(?P<instruction>.+?)\s*(?:\bInput\s*:\s*(?P<input>.+?)\s*)?\bOutput\s*:\s*(?P<output>.+?)(?=\bTask\s*:|\Z)", 20),
    ("dialogue", r"(?is)\b(?:User|Human)\s*:\s*(?P<instruction>.+?)\s*\b(?:AI|Assistant)\s*:\s*(?P<output>.+?)(?=\b(?:User|Human)\s*:|\Z)", 10),
]
SCHEMA = "kind string, instruction string, input string, output string"


def add_rule(kind: str, pattern: str, priority: int = 0) -> None:
    re.compile(pattern)
    RULES.append((kind, pattern, priority))


def sentences(text: Column, least: int = 10, most: int = 1000) -> Column:
    """Sentences with an end sign, without bullets and numbers before them, of least to most characters of which 30 % are letters or digits."""
    parts = F.transform(T.sentences(T.whitespace(text)), lambda s: F.concat(F.regexp_replace(s, r"^(?:[-*•]\s+|\d+[.)]\s+)", ""), F.lit(".")))
    return F.filter(parts, lambda s: F.length(s).between(least, most) & (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) >= 0.3 * F.length(s)))


def chunks(text: Column, most: int = 512) -> Column:
    """Sentences packed in order while a chunk has most characters at most; a fold, as each chunk depends on the last."""

    def add(acc: Column, s: Column) -> Column:
        fits = (F.length(acc["now"]) > 0) & (F.length(acc["now"]) + 1 + F.length(s) <= most)
        fresh = F.struct(F.when(F.length(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), s.alias("now"))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["now"], s).alias("now"))).otherwise(fresh)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(sentences(text), start, add, lambda a: F.when(F.length(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def token_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 400, overlap: int = 50) -> DataFrame:
    """(id, k, chunk): sentences packed up to most tokens, each chunk beginning with the last sentences, of overlap tokens at most, of the one before."""
    words = re.compile(r"\w+|[^\w\s]")

    def cut(text: str) -> list[str]:
        out, now, size = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+", text.strip()):
            n = len(words.findall(s))
            if now and size + n > most:
                out.append(" ".join(x for x, _ in now))
                back, held = [], 0
                for x, k in reversed(now):
                    if held + k > overlap:
                        break
                    back.insert(0, (x, k))
                    held += k
                now, size = (back, held) if held + n <= most else ([], 0)
            now.append((s, n))
            size += n
        return [*out, " ".join(x for x, _ in now)] if now and size else out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["chunk"] = [cut(t) if t else [] for t in f.pop("text")]
            f["k"] = [list(range(len(c))) for c in f["chunk"]]
            yield f.explode(["k", "chunk"]).dropna(subset=["k"])[["id", "k", "chunk"]].astype({"k": "int64"})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, k long, chunk string").withColumnRenamed("id", id_col)


def training_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int = 1000) -> DataFrame:
    """(id, kind, instruction, input, output) by the rules; a text that none matches is split for completion: a long one at its middle sentence."""
    rules = [(kind, re.compile(p)) for kind, p, _ in sorted(RULES, key=lambda r: -r[2])]

    def of(text: str) -> list[tuple]:
        out = [(kind, *((m.groupdict().get(k) or "").strip() for k in ("instruction", "input", "output"))) for kind, p in rules for m in p.finditer(text)]
        if out or not text.strip():
            return out
        if len(text) <= long:
            return [("completion", "", "", text)]
        ends = [m.end() for m in re.finditer(r"\. ", text)]
        at = ends[len(ends) // 2] if ends else len(text) // 2
        return [("completion", text[:at], "", text[at:])]

    names = ["kind", "instruction", "input", "output"]

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, s) for k, t in enumerate(part["text"].to_pylist()) if t for s in of(t)]
        return pa.RecordBatch.from_arrays([part["id"].take(pa.array([k for k, _ in rows], pa.int64())), *(pa.array([s[c] for _, s in rows], pa.string()) for c in range(4))], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sliced(make), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def split(key: Column, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: str = "split") -> Column:
    """train, validation or test by the key's hash: stable, without a shuffle, and each row's split doesn't depend on the others."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("the shares add up to 1")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") / float(2**32)
    return F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test")


def language_segments(text: Column, detect, least: int = 200) -> Column:
    """array of (language, confidence, text): sentences packed to least characters or more, each run detected."""
    packed = chunks(text, least)
    return F.transform(packed, lambda c: let(detect(c), lambda d: F.struct(d["language"].alias("language"), d["confidence"].alias("confidence"), c.alias("text"))))
