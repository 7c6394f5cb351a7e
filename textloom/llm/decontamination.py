"""Benchmark decontamination: a generalised suffix automaton of test items, through which documents are streamed."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, out_schema, pieces

#: A span is removed that has LENGTH words in a row from an item, or COVERAGE of an item's words where that is less, but no fewer than LEAST; an item of fewer words than that counts whole.
LENGTH, COVERAGE, LEAST = 13, 0.7, 6
#: Items share an automaton up to this many words, which takes about AUTOMATON_BYTES pickled at most; more make more automata, and texts pass through one after another.
AUTOMATON_WORDS, AUTOMATON_BYTES = 200_000, 64_000_000
#: Words are told apart in lower case; signs and white space don't count.
WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    """The words in lower case, as many as WORD finds in the text itself: lowering the text first would make two code points of some letters, and words of others by their neighbours."""
    if text.isascii():
        return WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


def limit(words: int, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> int:
    """Words in a row of an item of so many that are too many."""
    return min(length, max(min(least, words), ceil(round(coverage * words, 9))))


class Automaton:
    """Suffix automaton of all items. step: transitions of each state; size: of its longest string; link: its suffix link.

    need: the least limit of the items that hold the state's strings. below: the longest suffix outside the state that is
    itself too long, 0 if there is none.
    """

    def __init__(self, items: Iterable[tuple[list[str], int]]) -> None:
        """items: words and the limit of each."""
        self.step: list[dict[str, int]] = [{}]
        self.size, self.link, self.need = [0], [-1], [1 << 30]
        for words, bound in items:
            at = 0
            for w in words:
                at = self._extend(at, w)
                self.need[at] = min(self.need[at], bound)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for s in reversed(order):
            p = self.link[s]
            self.need[p] = min(self.need[p], self.need[s])
        self.below = [0] * len(self.size)
        for s in order:
            p = self.link[s]
            self.below[s] = self.size[p] if p and self.size[p] >= self.need[p] else self.below[p]

    def _new(self, step: dict[str, int], size: int, link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.need.append(1 << 30)
        return len(self.size) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        """The state of p's longest string and w, cut out of q if q has longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(dict(self.step[q]), self.size[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return self._split(last, w, q)
        new, p = self._new({}, self.size[last] + 1, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.step[p][w])
        return new

    def matches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(index, length) of each word of the stream at which a suffix that is too long ends, with the longest such."""
        step, size, link, need, below = self.step, self.size, self.link, self.need, self.below
        root = step[0]
        at = n = 0
        for i, w in enumerate(words):
            if not at:  # most words, most of the time
                if w in root:
                    at, n = root[w], 1
                    if n >= need[at]:
                        yield i, 1
                continue
            to = step[at].get(w)
            while to is None and at:
                at = link[at]
                n = size[at]
                to = step[at].get(w)
            if to is None:
                continue
            at, n = to, n + 1
            if n >= need[at]:
                yield i, n
            elif below[at]:
                yield i, below[at]

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """[start, end) of words to remove; spans that overlap or touch are one."""
        out: list[tuple[int, int]] = []
        for i, n in self.matches(words):
            start = i + 1 - n
            while out and out[-1][1] >= start:
                start = min(start, out.pop()[0])
            out.append((start, i + 1))
        return out


def item_pieces(text: str, words: int, **limits: float) -> Iterator[tuple[list[str], int]]:
    """The item with its limit; one of more words than that in pieces, which overlap so far that each run of the limit lies in one of them."""
    item = normalise(text)
    if item:
        bound = limit(len(item), **limits)
        step = max(1, words - bound + 1)
        for at in range(0, max(1, len(item) - bound + 1), step):
            yield item[at : at + step + bound - 1], bound


def automata(benchmark: DataFrame, text_col: str = "text", words: int = AUTOMATON_WORDS, **limits: float) -> Iterator[Automaton]:
    """Automata of the items in the benchmark table, made on the driver one after another; null texts and those without a word are left out and equal ones count once.

    Each holds a bounded number of words, and its pickled size is checked before it is broadcast.
    """

    def made(part: list[tuple[list[str], int]]) -> Automaton:
        found = Automaton(part)
        if (size := len(pickle.dumps(found))) > AUTOMATON_BYTES:
            raise ValueError(f"an automaton of {size} bytes is too large to broadcast: make AUTOMATON_WORDS smaller")
        return found

    part: list[tuple[list[str], int]] = []
    total = 0
    for row in benchmark.select(F.col(f"`{text_col}`").cast("string").alias("t")).where("t IS NOT NULL").distinct().orderBy("t").toLocalIterator():
        for piece in item_pieces(row["t"], words, **limits):
            if total and total + len(piece[0]) > words:
                yield made(part)
                part, total = [], 0
            part.append(piece)
            total += len(piece[0])
    if part:
        yield made(part)


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans of words, from the first one's first sign to the last one's last, and without the blanks before each."""
    at, out = 0, []
    where = [m.span() for m in WORD.finditer(text)]
    for a, b in spans:
        out.append(text[at : where[a][0]].rstrip(" \t"))
        at = where[b - 1][1]
    return "".join(out) + text[at:]


def _marked(rows: DataFrame, held: Iterator[Automaton]) -> tuple[DataFrame, Automaton | None]:
    """rows (with the columns text and spans) after all automata but the last, which is returned too.

    Between two passes lies a checkpoint, so that a Python worker holds one automaton at a time.
    """
    last = next(held, None)
    for following in held:
        rows = cut(rows.withColumn("spans", _added(rows.sparkSession.sparkContext.broadcast(last))("text", "spans")))
        last = following
    return rows, last


def _added(shared: Broadcast):
    """An Arrow function: the spans found before, as starts and ends in turn, and those of the broadcast automaton."""

    def add(texts: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(texts, before, strict=True):
            found = shared.value.spans(normalise(t)) if t else []
            out.append(b if not found else [*([] if b is None else b), *(x for s in found for x in s)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(add, "array<long>")


def _all_spans(words: list[str], automaton: Automaton, before: list[int] | None) -> list[tuple[int, int]]:
    """The automaton's spans, and those that other ones found before."""
    found = automaton.spans(words)
    return union([*found, *zip(before[::2], before[1::2], strict=True)]) if before is not None and len(before) else found


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = AUTOMATON_WORDS, **limits: float) -> DataFrame:
    """(id, start, words) of each span to remove, counted in normalised words from 0.

    A word is removed if it lies in a run of words that an item holds too and that has limit(words of the item) words at
    least. Spans that overlap or touch are one. A null or empty text and a clean one give no row; repeated rows give theirs
    again; other columns are ignored. With an empty benchmark nothing is found. Map-only: whole texts are streamed through
    the automaton, and nothing of the corpus is shuffled.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(None).cast("array<long>").alias("spans"))
    marked, last = _marked(picked, automata(benchmark, words=words, **limits))
    held = docs.sparkSession.sparkContext.broadcast(last)
    several = marked is not picked

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(2).to_pylist() if several else []
            done = 0
            for ids, texts in pieces(batch):
                rows = []
                for i, t in enumerate(texts):
                    if t and held.value:
                        rows += [(i, a, b - a) for a, b in _all_spans(normalise(t), held.value, before[done + i] if several else None)]
                done += len(texts)
                yield pa.record_batch([ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["id", "start", "words"])

    return (marked if several else marked.drop("spans")).mapInArrow(f, out_schema(docs, id_col, "start long, words long")).withColumnRenamed("id", id_col)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", words: int = AUTOMATON_WORDS, **limits: float) -> DataFrame:
    """docs with the spans cut out of text_col; a row that no word is left of goes, every other stays.

    A text without a span is returned as it is, a null one as null. Rows are treated one by one, so ids don't matter.
    """
    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.lit(None).cast("array<long>").alias("spans"))
    marked, last = _marked(picked, automata(benchmark, words=words, **limits))
    if last is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(last)

    def one(t: str | None, before: list[int] | None) -> str | None:
        if not t:
            return t
        found = normalise(t)
        spans = _all_spans(found, held.value, before)
        if not spans:
            return t
        return None if sum(b - a for a, b in spans) == len(found) else cut_out(t, spans)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([one(t, b) for t, b in zip(texts, before, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def clean_one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t, None))

    once = clean_one.asNondeterministic()("text") if marked is picked else clean.asNondeterministic()("text", "spans")  # or the filter below would run it a second time
    cleaned = marked.select("row", F.col("text").isNull().alias("none"), once.alias("cleaned"))
    return cleaned.where("none OR cleaned IS NOT NULL").select(*(F.col("cleaned").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def oracle(length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST) -> str:
    """The same spans by n-grams: windows as long as an item's limit that equal one of its own cover their words."""
    return f"""WITH items AS (SELECT DISTINCT list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS w FROM benchmark WHERE text IS NOT NULL),
    limits AS (SELECT w, least({length}, greatest(least({least}, len(w)), ceil(round({coverage} * len(w), 9))))::BIGINT AS n FROM items WHERE len(w) > 0),
    grams AS (SELECT DISTINCT n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS k FROM limits)),
    tokens AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS w FROM documents),
    windows AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM tokens CROSS JOIN (SELECT DISTINCT n FROM grams))),
    hits AS (SELECT DISTINCT doc_id, k - 1 AS a, k - 1 + n AS b FROM windows SEMI JOIN grams USING (n, g)),
    marked AS (SELECT doc_id, a, b, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM hits),
    runs AS (SELECT doc_id, a, b, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT doc_id, min(a) AS start, max(b) - min(a) AS words FROM runs GROUP BY doc_id, run"""
