"""Toxicity: a classifier chain over categories of abuse."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import per_document, pieces

#: The chain, in order, made of the two columns of labels: low quality, toxic, and both at once.
CATEGORIES = ("low_quality", "toxic", "severe")
#: Labelled rows of each class that are used, at most: those whose ids hash lowest.
SAMPLE_PER_CLASS = 2000
#: Terms kept for each label, letters of the stems that count as terms, folds for the out-of-fold predictions.
TERMS, STEMS, FOLDS = 512, (4, 5, 6, 7, 8), 5
#: Half a log-likelihood ratio that a term needs (chance alone gives it about once in 16,000), or long clean texts gather terms that only look abusive.
SURE = 8.0
#: Rows of the class that a term needs at least.
LEAST_ROWS = 3
#: A document whose probability of being toxic is higher is rejected.
THRESHOLD, REJECTS = 0.5, CATEGORIES.index("toxic")
WORD = re.compile(r"\w+")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights, the last of them the bias, of a logistic regression with an L2 penalty, by Newton's method with conjugate gradients."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)], dtype=np.float32)
    y, w = y.astype(np.float32), np.zeros(x1.shape[1], np.float32)
    penalty = np.full(len(w), decay, np.float32)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        g = x1.T @ (p - y) + penalty * w
        if np.abs(g).max() < 1e-4 * max(1, len(y)) ** 0.5:
            break
        s = p * (1 - p) + np.float32(1e-9)
        d, r = np.zeros_like(w), -g
        q, rr = r.copy(), float(r @ r)
        for _ in range(40):
            hq = x1.T @ (s * (x1 @ q)) + penalty * q
            a = np.float32(rr / float(q @ hq))
            d += a * q
            r -= a * hq
            new = float(r @ r)
            if new < 1e-8:
                break
            q, rr = r + np.float32(new / rr) * q, new
        w += d
    return w


def terms_of(text: str) -> Counter:
    """Words and the stems of longer ones (a prefix and *), with their counts."""
    n = Counter(WORD.findall(text.lower()))
    out = Counter(n)
    for w, k in n.items():
        for size in STEMS:
            if len(w) > size:
                out[w[:size] + "*"] += k
    return out


@dataclass
class Chain:
    """terms: with their column; weights: of each link, whose last inputs are the earlier links' probabilities."""

    terms: dict[str, int]
    weights: list[np.ndarray]

    def __post_init__(self) -> None:
        self.heads = {t.rstrip("*")[: STEMS[0]] for t in self.terms}

    def row(self, text: str) -> np.ndarray:
        """Two features a term: the log of its count, and of its count in 100 words."""
        words = WORD.findall(text.lower())
        heads, size, k = self.heads, STEMS[0], len(self.terms)
        counts = np.zeros(k, np.float32)
        terms = self.terms
        for w in words:
            if w[:size] in heads:
                if (i := terms.get(w)) is not None:
                    counts[i] += 1
                for n in STEMS:
                    if len(w) > n and (i := terms.get(w[:n] + "*")) is not None:
                        counts[i] += 1
        return np.concatenate([np.log1p(counts), np.log1p(counts * (100 / max(1, len(words))))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column a category, each link fed with those before it."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, sigmoid(np.hstack([x, out]) @ w[:-1] + w[-1])[:, None]])
        return out


Row = tuple[str, int, int]


def categories(low: int, toxic: int) -> tuple[int, int, int]:
    return low, toxic, low * toxic


def telling(seen: np.ndarray, total: list[int], n_terms: int) -> list[int]:
    """The n_terms that rows of class 1 have more often, with the greatest log-likelihood ratio against the class. seen: by class, the rows with each term; total: rows of each."""
    if not all(total):
        return []
    b, a = seen.astype(np.float64)
    p = (a + b) / sum(total)
    with np.errstate(all="ignore"):
        worth = sum(np.where(k > 0, k * np.log(k / (n * p)), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - p))), 0) for k, n in ((a, total[1]), (b, total[0])))
    at = np.flatnonzero((a >= LEAST_ROWS) & (a / total[1] > 2 * b / total[0]) & (worth >= SURE))
    return at[np.lexsort((at, -worth[at]))][:n_terms].tolist()


def fold_of(text: str, folds: int) -> int:
    """The fold of a text: copies, whatever their case and signs, share one, so that none is predicted from another."""
    return int.from_bytes(blake2b(" ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass"), digest_size=4).digest()) % folds


def fit(rows: list[Row], n_terms: int = TERMS, folds: int = FOLDS, decay: float = 1.0) -> Chain:
    """Fit the chain to (text, low quality, toxic) rows.

    Each link is fitted to the terms and to the earlier links' out-of-fold probabilities, so a later link sees an earlier one
    as unsure as it is on new text. What makes these has seen nothing of the fold: its terms, too, are chosen on the other
    folds alone. The links kept are fitted to all rows, with terms chosen on all. Without rows of both toxic classes the
    chain rejects nothing.
    """
    none = Chain({}, [np.array([0.0] * i + [-40.0]) for i in range(len(CATEGORIES))])
    if len({toxic for _, _, toxic in rows}) < 2:
        return none
    fold = np.array([fold_of(t, folds) for t, _, _ in rows])
    labels = np.array([categories(low, toxic) for _, low, toxic in rows], np.float64)
    terms = [terms_of(t).keys() for t, _, _ in rows]
    often = Counter()
    for found, (_, low, toxic) in zip(terms, rows, strict=True):
        if low or toxic:
            often.update(found)
    known = sorted(t for t, n in often.items() if n >= LEAST_ROWS)  # no other term can be chosen
    index = {t: i for i, t in enumerate(known)}
    seen = np.zeros((folds, 2, 2, len(known)), np.int64)  # by fold, label, class and term
    for found, (_, *ys), k in zip(terms, rows, fold.tolist(), strict=True):
        at = [i for t in found if (i := index.get(t)) is not None]
        for c, y in enumerate(ys):
            seen[k, c, y, at] += 1
    every_fold = seen.sum(axis=0)

    def chosen(without: int | None) -> list[str]:
        out: set[int] = set()
        for c in range(2):
            total = [int(np.sum((labels[:, c] == y) & (fold != (-1 if without is None else without)))) for y in (0, 1)]
            out.update(telling(every_fold[c] - (0 if without is None else seen[without, c]), total, n_terms))
        return [known[i] for i in sorted(out)]

    by_fold, final = [chosen(k) for k in range(folds)], chosen(None)
    every = Chain({t: i for i, t in enumerate(sorted({*final, *(t for ts in by_fold for t in ts)}))}, [])
    x = np.array([every.row(t) for t, _, _ in rows], np.float32)

    def inputs(terms: list[str]) -> np.ndarray:
        at = [every.terms[t] for t in terms]
        return x[:, [*at, *(len(every.terms) + i for i in at)]]

    chain, own = Chain({t: i for i, t in enumerate(final)}, []), inputs(final)
    earlier = np.zeros((len(rows), 0), np.float32)
    for c in range(len(CATEGORIES)):
        y, held = labels[:, c], np.zeros(len(rows))
        for k in range(folds):
            if (part := fold != k).any() and (~part).any():
                given = np.hstack([inputs(by_fold[k]), earlier])
                w = fit_logistic(given[part], y[part], decay)
                held[~part] = sigmoid(given[~part] @ w[:-1] + w[-1])
        chain.weights.append(fit_logistic(np.hstack([own, earlier]), y, decay))
        earlier = np.hstack([earlier, held[:, None]]).astype(np.float32)
    return chain


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", quality_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> list[Row]:
    """(text, low quality, toxic) of at most per_class rows a toxic class, those whose ids hash lowest; null texts and toxic labels are left out, a null quality isn't low."""
    low = F.coalesce((F.col(f"`{quality_col}`").cast("int") == 0).cast("int"), F.lit(0))
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("y"), low.alias("low")).where("id IS NOT NULL AND y IN (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"), F.max("low").alias("low")).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    # A bound of the hash for each class lets about 1.5 times as many through, so that few rows are left to rank.
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bounds = {k: -(2**63) + min(2**64 - 1, 2**64 * (per_class * 3 // 2 + 100) // n[k]) for k in n}
    y = y.where(F.col("h") <= F.when(F.col("y") == 1, F.lit(bounds.get(1, 0))).otherwise(F.lit(bounds.get(0, 0))))
    picked = y.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).where(F.col("r") <= per_class).select("id", "y", "low", "h")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(picked), "id").select("h", "text", "low", "y").toArrow().to_pylist()  # picked has 2 * per_class rows at most
    return [(r["text"], r["low"], r["y"]) for r in sorted(found, key=lambda r: (r["h"], r["text"], r["low"], r["y"]))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Chain:
    return fit(labelled_rows(docs, labels, id_col, text_col, per_class=per_class))


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_low_quality, p_toxic, p_severe) of each row, from the whole text. A null text has them null; an empty one is scored
    by the biases. Repeated rows are scored alike, an empty table gives an empty one, other columns are ignored. Map-only."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                x = np.array([chain.row(t or "") for t in texts])
                p = chain.probabilities(x)
                none = np.array([t is None for t in texts])
                yield pa.record_batch([ids, *(pa.array(p[:, c], mask=none) for c in range(len(CATEGORIES)))], ["id", *(f"p_{c}" for c in CATEGORIES)])

    return per_document(docs, id_col, text_col, ", ".join(f"p_{c} double" for c in CATEGORIES), f)


def toxic_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Scores of the documents that are rejected, with toxic true. A null text is not rejected."""
    return score_toxicity(docs, chain, id_col, text_col).where(F.col("p_toxic") > threshold).withColumn("toxic", F.lit(True))


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are rejected. Each row is judged by its own text, so ids may be null or repeated. No join, no shuffle. Repeated rows are judged alike, an empty table stays empty."""

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 512):
            x = np.array([chain.row(t or "") for t in texts.iloc[at : at + 512]])
            out.append(chain.probabilities(x)[:, REJECTS] <= threshold)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    text = F.col(f"`{text_col}`").cast("string")
    return docs.where(text.isNull() | keep(text))
