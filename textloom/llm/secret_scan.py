"""Secret scans that report a candidate only after its decoded structure has been confirmed."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log2
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_document, pieces

MASK = "[{}]"

# Each candidate begins where its class of characters does, so a long run is one candidate, whatever it holds.
FORMS = (
    r"(?P<pem>-----BEGIN (?P<label>[A-Z0-9 ]{0,80}PRIVATE KEY)-----(?P<head>(?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)*)(?P<body>[A-Za-z0-9+/=\s]*)-----END (?P=label)-----)",
    r"(?P<jwt>(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*)",
    r"(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9]))",
    r"(?P<blob>(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2})",
)
CANDIDATES = re.compile("|".join(FORMS))
PEM, JWT, AWS, BLOB = map(re.compile, FORMS)
#: Every structure that confirm() knows begins with one of these: a label, an id's prefix, the base64 of a JSON object, the base64 or hex of a DER sequence or of OpenSSH's magic. A text without any is done with after the JVM's search.
NEEDLES = r"PRIVATE KEY-|A[KS]IA[A-Z2-7]{16}|(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{6,}\.|(?<![A-Za-z0-9+/_-])(?:M[A-P]|30|b3Bl|6[fF]70)[A-Za-z0-9+/_-]{36}"
HEX = re.compile(r"[0-9a-fA-F]+\Z")
#: Block sizes of the ciphers that a key file's DEK-Info names.
BLOCKS = {"AES": 16, "CAMELLIA": 16, "ARIA": 16, "SEED": 16, "DES": 8, "BF": 8, "IDEA": 8, "RC2": 8}
#: An opaque value in quotes or bare behind a name: no structure confirms it, so the scan doesn't report it; masking may include it.
OPAQUE = re.compile(r"(?i:(?<![a-z])(?P<name>password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]{0,20}[:=][ \t]{0,20}[\"']?(?P<value>[A-Za-z0-9+/_-]{12,}={0,2}))")
NAMES = ("passw", "pwd", "secret", "token", "key", "auth")
#: Shannon bits a byte, as a share of what so few bytes can reach, that an opaque value needs at least.
MIN_RANDOMNESS = 0.80
#: DER contents of the object identifiers of keys' algorithms: RSA, EC, Ed25519, X25519, DSA.
KEY_OIDS = {bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a8648ce3d0201"): "ec", bytes.fromhex("2b6570"): "ed25519", bytes.fromhex("2b656e"): "x25519", bytes.fromhex("2a8648ce380401"): "dsa"}


def decode(candidate: str) -> bytes | None:
    """Bytes of a hex run, else of base64 in either alphabet with or without padding; None where neither fits."""
    bare = candidate.rstrip("=")
    if HEX.match(bare) and len(bare) % 2 == 0 and bare == candidate:
        return bytes.fromhex(bare)
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare.translate(str.maketrans("-_", "+/")) + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and contents of consecutive DER elements that fill data exactly; None where a length doesn't fit."""
    found, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data) or data[i] == 0:
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
            if n < 0x80:
                return None
        if i + n > len(data):
            return None
        found.append((tag, data[i : i + n]))
        i += n
    return found


def private_key(data: bytes) -> str | None:
    """Kind of the private key that data is in PKCS#1, SEC 1, PKCS#8 (plain or encrypted) or OpenSSH's form, with all nested lengths in order."""
    if data.startswith(b"openssh-key-v1\0"):
        i, parts = 15, []
        while i + 4 <= len(data) and len(parts) < 3:
            n = int.from_bytes(data[i : i + 4], "big")
            if i + 4 + n > len(data):
                return None
            parts.append(data[i + 4 : i + 4 + n])
            i += 4 + n
        return "openssh" if len(parts) == 3 and i + 4 <= len(data) else None
    outer = der(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or (inner := der(outer[0][1])) is None:
        return None
    tags = [t for t, _ in inner]
    if tags[:3] == [2, 0x30, 4] and len(inner[0][1]) == 1:
        algorithm = der(inner[1][1])
        return f"pkcs8-{KEY_OIDS.get(algorithm[0][1], 'other')}" if algorithm and algorithm[0][0] == 6 else None
    if len(tags) >= 9 and set(tags[:9]) == {2} and len(inner[1][1]) >= 32:
        return "pkcs1-rsa"
    if tags[:2] == [2, 4] and inner[0][1] == b"\1" and len(inner[1][1]) in (24, 28, 32, 48, 66):
        return "sec1-ec"
    if tags == [0x30, 4] and (scheme := der(inner[0][1])) and scheme[0][0] == 6 and len(inner[1][1]) % 8 == 0 and inner[1][1]:
        return "pkcs8-encrypted"
    return None


def signed_token(text: str) -> bool:
    """Whether text is three base64url parts of which the first is a JSON header with alg and the second a JSON object; the last is empty only with alg none."""
    parts = text.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return len(parts) == 3 and isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and bool(parts[2]) == (head["alg"].lower() != "none")


def key_file(head: str, body: str) -> str | None:
    """Kind of the key in a PEM body: its DER in order or, where a header says that it is encrypted, whole blocks of the cipher that the header names, with an initial vector of its size."""
    data = decode("".join(body.split())) or b""
    if not head.strip():
        return private_key(data)
    m = re.search(r"Proc-Type:\s*4,ENCRYPTED\s*\n\s*DEK-Info:\s*([A-Z0-9]+)[A-Z0-9-]*,\s*([0-9A-Fa-f]+)", head)
    block = BLOCKS.get(m[1]) if m else None
    return "encrypted" if block and len(m[2]) == 2 * block and data and len(data) % block == 0 else None


def aws_key(candidate: str) -> bool:
    """Whether the id's sixteen base32 digits hold, as such ids do, the number of an account: 40 bits behind the first that are below 10^12, and none of ten equal bytes."""
    data = base64.b32decode(candidate[4:])
    return (int.from_bytes(data[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12 and len(set(data)) > 1


def random_bytes(data: bytes) -> bool:
    """Whether the bytes are as mixed as chance would make them, not a word, a counter or a repeated pattern."""
    n = len(data)
    if n < 8:
        return False
    entropy = -sum(k / n * log2(k / n) for k in Counter(data).values())
    return entropy >= MIN_RANDOMNESS * min(8.0, log2(n))


def confirm(text: str, start: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of the first form of candidate that begins there and whose structure holds."""
    if (m := PEM.match(text, start)) and (kind := key_file(m["head"], m["body"])):
        return f"private-key:{kind}", *m.span()
    if (m := JWT.match(text, start)) and signed_token(m["jwt"]):
        return "signed-token", *m.span()
    if (m := AWS.match(text, start)) and aws_key(m["aws"]):
        return "aws-key-id", *m.span()
    if (m := BLOB.match(text, start)) and (data := decode(m["blob"])) is not None and (kind := private_key(data)):
        return f"private-key:{kind}", *m.span()
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """Confirmed secrets of the whole text, from left to right without overlap.

    After a candidate that fails, the search goes on inside it. A run isn't a candidate again from its middle, but other forms
    may begin there, so the time stays linear.
    """
    found, at = [], 0
    while m := CANDIDATES.search(text, at):
        if hit := confirm(text, m.start()):
            found.append(hit)
            at = hit[2]
        else:
            at = m.start() + 1
    return found


def opaque(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of values assigned to a name of a secret whose decoded bytes are mixed as chance would, and which have no structure that could confirm them."""
    found, at = [], 0
    while m := OPAQUE.search(text, at):
        data = decode(m["value"])
        if data is not None and any(c.isdigit() for c in m["value"]) and random_bytes(data):
            found.append((f"unconfirmed:{m['name'].lower().replace('-', '_')}", *m.span("value")))
            at = m.end()
        else:
            at = m.end("name")
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, length) of each secret whose structure is confirmed, with offsets in characters; the secret itself isn't copied.

    Documents without any, with a null or an empty text give no row; repeated rows give theirs again. Other columns are
    ignored. Map-only; the JVM drops texts that can hold no candidate before any reaches Python.
    """
    possible = docs.where(F.col(f"`{text_col}`").cast("string").rlike(NEEDLES))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                rows = [(i, *hit) for i, t in enumerate(texts) if t for hit in find(t)]
                yield pa.record_batch([
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] - r[2] for r in rows], pa.int64()),
                ], ["id", "kind", "start", "length"])

    return per_document(possible, id_col, text_col, "kind string, start long, length long", f)


def redact(text: str, unconfirmed: bool = False) -> str:
    """text with [kind] in place of each confirmed secret and, if asked for, of each opaque value outside these."""
    hits = find(text)
    if unconfirmed:
        hits = sorted([*hits, *(o for o in opaque(text) if not any(o[1] < h[2] and h[1] < o[2] for h in hits))], key=lambda h: h[1])
    out, at = [], 0
    for kind, start, end in hits:
        out += [text[at:start], MASK.format(kind)]
        at = end
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", unconfirmed: bool = False) -> DataFrame:
    """docs with secrets replaced by [kind] in text_col and nothing else changed; no row is dropped, nulls stay null.

    With unconfirmed, opaque values that are assigned to a secret's name are masked too, as [unconfirmed:name]. Only texts
    that may hold a candidate are searched in Python, inside one Arrow function; other columns never leave the JVM. Repeated
    rows are treated alike, an empty table stays empty.
    """
    text = F.col(f"`{text_col}`").cast("string")

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, unconfirmed) if t else t)

    possible = text.rlike(NEEDLES)
    if unconfirmed:
        low = F.lower(text)
        possible = possible | reduce(or_, (F.contains(low, F.lit(n)) for n in NAMES))
    # The search runs once: what it passes over comes back as null and stays as it was.
    return docs.withColumn(text_col, F.coalesce(clean(F.when(possible, text)), text))
