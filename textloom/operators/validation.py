"""Rules over datasets: issues as rows, summaries, benchmarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule name -> (severity, what, test over a text column). Add to it with register().
RULES: dict[str, list[tuple[str, str, Callable[[Column], Column]]]] = {
    "content": [
        ("ERROR", "too short", lambda t: F.length(t) < 10),
        ("WARNING", "too long", lambda t: F.length(t) > 1_000_000),
        ("WARNING", "mostly white space", lambda t: (F.length(t) > 0) & (F.length(F.regexp_replace(t, r"\s", "")) < 0.1 * F.length(t))),
    ],
    "completeness": [("ERROR", "missing text", lambda t: t.isNull())],
}


def register(rule: str, severity: str, what: str, test: Callable[[Column], Column]) -> None:
    RULES.setdefault(rule, []).append((severity, what, test))


def unregister(rule: str) -> None:
    RULES.pop(rule, None)


def issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, severity, what) of all that fails. The texts are read once; duplicate ids take a shuffle of ids alone."""
    tests = [F.when(test(F.col(text_col)), F.struct(F.lit(rule).alias("rule"), F.lit(s).alias("severity"), F.lit(w).alias("what"))) for rule, parts in RULES.items() for s, w, test in parts]
    own = docs.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*tests))).alias("i")).select("id", "i.*")
    again = docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id", F.lit("consistency").alias("rule"), F.lit("CRITICAL").alias("severity"), F.lit("duplicate id").alias("what"))
    return own.union(again)


def quality_issues(scored: DataFrame, score: str, least: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """(id, rule, severity, what): each document below the score, and the dataset (id null) if its mean is. One scan for either; the mean is one row."""
    issue = lambda severity, what: (F.lit("quality").alias("rule"), F.lit(severity).alias("severity"), F.lit(what).alias("what"))
    own = scored.where(F.col(score) < least).select(F.col(id_col).alias("id"), *issue("INFO", "document below the least score"))
    whole = scored.agg(F.avg(score).alias("m")).where(F.col("m") < least).select(F.lit(None).cast(scored.schema[id_col].dataType).alias("id"), *issue("WARNING", "dataset below the least score"))
    return own.union(whole)


def summary(found: DataFrame) -> DataFrame:
    """One row: counts by severity, and whether the dataset is valid, that is without an error or a critical issue."""
    n = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("INFO", "WARNING", "ERROR", "CRITICAL")]
    return found.agg(F.count("*").alias("issues"), *n).withColumn("valid", (F.col("error") == 0) & (F.col("critical") == 0))


def missing_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *(F.round(F.count_if(F.col(c).isNull() | F.col(c).isin("", "unknown")) / F.count("*"), 6).alias(c) for c in columns))


def consistency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Share of texts whose first 1,000 characters came before (that is the reference measure), of texts in good encoding, and of the largest language."""
    n = F.count("*")
    out = docs.agg(n.alias("n"), F.round(1 - F.countDistinct(F.md5(F.substring(text_col, 1, 1000))) / n, 6).alias("duplicate_ratio"), F.round(F.count_if(~F.contains(F.col(text_col), F.lit("�"))) / n, 6).alias("encoding_ratio"))
    largest = docs.groupBy("lang").agg(n.alias("k")).agg(F.round(F.max("k") / F.sum("k"), 6).alias("language_dominance"))
    return out.crossJoin(largest)  # one row each


def passes(value: Column, threshold: float, tolerance: float = 0.0) -> Column:
    return value >= threshold - tolerance


def regressed(value: Column, baseline: Column, share: float = 0.9) -> Column:
    return value < share * baseline


JSON_SCHEMA = {"required": ["id", "content"], "properties": {"id": "string", "content": "string", "metadata": "object"}}


def json_errors(text: Column, schema: dict = JSON_SCHEMA) -> Column:
    """What a JSON line lacks of the schema's required keys, or "not JSON"."""
    missing = [F.when(F.get_json_object(text, f"$.{k}").isNull(), F.lit(f"missing {k}")) for k in schema["required"]]
    return F.when(F.try_parse_json(text).isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*missing)))
