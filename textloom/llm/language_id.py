"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_document, pieces

#: Components of a hypervector, and the seed of the letters' random ones.
DIM, SEED = 1024, 20240
#: Labelled rows of each language that prototypes are bundled from, at most: the rows with the lowest hashes of their ids.
SAMPLE_PER_LANGUAGE = 500
#: A document whose best cosine is lower, or that has no n-gram, gets the language null.
MIN_COSINE = 0.05
#: Symbol 0 separates words and each of these letters has the next; any other letter of any script is SYMBOLS plus its code point. Trigrams of the first are looked up, the others are bound as they come.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçèéêëíîïñóôöùúûüßœæ"
SYMBOLS = len(LETTERS) + 1
#: More than any symbol, and how many vectors of other letters a worker keeps.
RADIX, KEPT = SYMBOLS + 0x110000, 20_000


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point, whatever the letter's case."""
    table = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = LETTERS.index(low) + 1 if low in LETTERS and len(low) == 1 else SYMBOLS + ord(low[0])
    return table


def letter_vectors(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))


def other_vector(symbol: int, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The random vector of a letter that isn't in LETTERS, made from its symbol wherever it is needed."""
    return np.random.default_rng([seed, symbol]).choice(np.array([-1, 1], np.int8), dim)


class Encoder:
    """Bundles of trigram hypervectors: the trigram abc is bound as permute(permute(a)) * permute(b) * c, where permute is a rotation."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        letters = letter_vectors(dim, seed)
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.pairs = (self.first[:, None, :] * self.second[None, :, :]).reshape(SYMBOLS * SYMBOLS, dim)
        self.dim, self.seed = dim, seed
        self.others: dict[int, np.ndarray] = {}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams (as one number, below 0 where a letter isn't in LETTERS) of the whole text and how often each is there. Runs of separators count as one; one stands at either end."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate(([0], symbol_table()[codes], [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if len(s) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        if (rare := s >= SYMBOLS).any():
            rare = rare[:-2] | rare[1:-1] | rare[2:]
            grams = np.where(rare, -1 - ((s[:-2] * RADIX + s[1:-1]) * RADIX + s[2:]), grams)
        elif len(grams) > 20_000:
            n = np.bincount(grams)
            found = np.flatnonzero(n)
            return found, n[found]
        return np.unique(grams, return_counts=True)

    def vectors(self, symbols: np.ndarray) -> np.ndarray:
        if len(self.others) > KEPT:
            self.others.clear()
        out = np.empty((len(symbols), self.dim), np.int8)
        for i, x in enumerate(symbols.tolist()):
            if x < SYMBOLS:
                out[i] = self.third[x]
            else:
                v = self.others.get(x)
                if v is None:
                    v = self.others[x] = other_vector(x, self.dim, self.seed)
                out[i] = v
        return out

    def bundle(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each as often as it occurs."""
        if not len(grams):
            return np.zeros(self.dim, np.float32)
        total = np.zeros(self.dim, np.float32)
        if grams[0] < 0:  # sorted, so these come first
            few = int(np.searchsorted(grams, 0))
            for at in range(0, few, 4096):
                pair, c = np.divmod(-1 - grams[at : min(at + 4096, few)], RADIX)
                a, b = np.divmod(pair, RADIX)
                symbols, where = np.unique(np.concatenate([a, b, c]), return_inverse=True)
                v, (a, b, c) = self.vectors(symbols), where.reshape(3, -1)
                bound = np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]
                total += n[at : min(at + 4096, few)].astype(np.float32) @ bound.astype(np.float32)
            grams, n = grams[few:], n[few:]
        pair, last = np.divmod(grams, SYMBOLS)
        for at in range(0, len(grams), 4096):
            bound = self.pairs[pair[at : at + 4096]] * self.third[last[at : at + 4096]]
            total += n[at : at + 4096].astype(np.float32) @ bound.astype(np.float32)
        return total


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray
    dim: int = DIM
    seed: int = SEED


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, dim: int = DIM, seed: int = SEED) -> Prototypes:
    """Bundle the labelled rows' normalised vectors into a prototype a language.

    Uses at most per_language rows of each, those whose ids hash lowest. Rows with a null text or language are left out.
    The bundles are summed in the executors; a few vectors a language and task reach the driver.
    """
    from pyspark.sql import Window

    lang, picked = F.col(f"`{lang_col}`"), F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    labelled = docs.select(picked.alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    light = labelled.select("h", "lang")
    lowest = light.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("most"))
    bound = {r["lang"]: r["most"] for r in lowest.collect()}
    if not bound:
        return Prototypes([], np.zeros((0, dim), np.float32), dim, seed)
    rule = None
    for k, most in sorted(bound.items()):
        one = (F.col("lang") == k) & (F.col("h") <= most)
        rule = one if rule is None else rule | one

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(dim, seed), {}
        for batch in batches:
            for langs, texts in pieces(batch):
                for k, t in zip(langs.to_pylist(), texts, strict=True):
                    v = encoder.bundle(*encoder.counts(t))
                    total[k] = total.get(k, 0) + v.astype(np.float64) / max(1e-9, float(np.linalg.norm(v)))
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.round(9).tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums: dict[str, np.ndarray] = {}
    for r in labelled.where(rule).select("lang", "text").mapInArrow(f, "lang string, v array<double>").collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["v"])
    languages = sorted(sums)
    vectors = np.array([sums[k] / max(1e-9, np.linalg.norm(sums[k])) for k in languages], np.float32)
    return Prototypes(languages, vectors, dim, seed)


def classify(docs: DataFrame, prototypes: Prototypes, id_col: str = "doc_id", text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, predicted, cosine, margin over the next language) of each row.

    The language with the highest cosine wins; of equal ones the first by name. A null text, one without letters, and one
    below min_cosine have the language null, the first two also the other columns. Repeated rows give repeated rows. Map-only;
    what goes to the executors is one vector a language, whatever the input's size.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, m = Encoder(prototypes.dim, prototypes.seed), prototypes.vectors
        for batch in batches:
            for ids, texts in pieces(batch):
                rows: list[tuple] = []
                for t in texts:
                    v = encoder.bundle(*encoder.counts(t)) if t else None
                    norm = 0.0 if v is None else float(np.linalg.norm(v))
                    if not norm or not len(m):
                        rows.append((None, None, None))
                        continue
                    cosines = m @ v / norm
                    best = int(np.argmax(cosines))
                    rest = np.delete(cosines, best)
                    rows.append((prototypes.languages[best] if cosines[best] >= min_cosine else None, float(cosines[best]), float(cosines[best] - rest.max()) if len(rest) else None))
                yield pa.record_batch([ids, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], ["id", "predicted", "cosine", "margin"])

    return per_document(docs, id_col, text_col, "predicted string, cosine double, margin double", f)
