"""Filters over documents, entities, changes and metrics. Bounds that are None aren't applied; 0 is a bound like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import raw_tokens
from textloom.operators.relational import page


def between(value: Column, least: float | None, most: float | None) -> Column:
    ok = F.lit(True)
    if least is not None:
        ok = ok & (value >= least)
    return ok if most is None else ok & (value <= most)


def documents(docs: DataFrame, language: str | None = None, source: str | None = None, words: tuple[float | None, float | None] = (None, None), quality: tuple[float | None, float | None] = (None, None), score: Column | None = None, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0, text_col: str = "text") -> DataFrame:
    out = docs if language is None else docs.where(F.col("lang") == language)
    out = out if source is None else out.where(F.col("source") == source)
    if words != (None, None):
        out = out.where(between(F.size(raw_tokens(F.col(text_col))), *words))
    if quality != (None, None) and score is not None:
        out = out.where(between(score, *quality))
    return page(out, order_by, limit, offset)


def long_enough(docs: DataFrame, least: int = 50, text_col: str = "text") -> DataFrame:
    return docs.where(F.length(F.regexp_replace(text_col, r"^\s+|\s+$", "")) >= least)


def entities(found: DataFrame, labels: Sequence[str] | None = None, confidence: float | None = None) -> DataFrame:
    """Entities' rows (label, text, confidence) of some labels and of a confidence at least."""
    out = found if labels is None else found.where(F.col("label").isin(*labels))
    return out if confidence is None else out.where(F.col("confidence") >= confidence)


def without_overlap(spans: Column) -> Column:
    """array of (start, end, confidence, ...) structs with, of two that overlap, the one of the higher confidence, in order of their starts."""

    def add(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = F.coalesce(s["start"] >= last["end"], F.lit(True))
        better = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(apart, F.concat(kept, F.array(s))).when(s["confidence"] > last["confidence"], better).otherwise(kept)

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def history(changes: DataFrame, entity: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Changes' rows (entity, ts, ...), the newest first."""
    out = changes if entity is None else changes.where(F.col("entity") == entity)
    out = out if since is None else out.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return page(out, ["ts DESC"], limit)
