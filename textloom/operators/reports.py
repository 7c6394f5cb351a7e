"""Summaries of a corpus: recommendations, cleaning statistics, topics, languages, training estimates, histograms, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.analytics import distribution, diversity

#: Issue -> (share of the documents beyond which it is one of the corpus, advice).
ADVICE = {
    "length": (0.3, "check the limits on length"), "coherence": (0.2, "filter spam and repetition"), "uniqueness": (0.15, "remove duplicates more strictly"),
    "readability": (0.25, "simplify the text before use"), "structure": (0.3, "normalise layout and paragraphs"),
}


def recommendations(scored: DataFrame, top: int = 5) -> DataFrame:
    """(what) that follows from the grades and the top issue types of (overall, grade, issues: array of struct(type, ...)), in one row at least.

    The documents are read once; what is left is a row a type of issue.
    """
    types = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.transform("issues", lambda i: i["type"])))
    rows = scored.select("overall", "grade", types.alias("type")).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("overall") < 0.6).alias("low"), F.count_if(F.col("grade").isin("D", "F")).alias("poor"))
    rank = F.row_number().over(Window.partitionBy(F.col("type").isNull()).orderBy(F.desc("n"), "type"))  # a row a type of issue
    total = F.max(F.when(F.col("type").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    limit = F.coalesce(*(F.when(F.col("type") == k, F.lit(x)) for k, (x, _) in ADVICE.items()))
    advice = F.coalesce(*(F.when(F.col("type") == k, F.lit(a)) for k, (_, a) in ADVICE.items()))
    own = F.when(F.col("type").isNotNull() & (F.col("rank") <= top) & (F.col("n") > limit * F.col("total")), F.array(advice)).otherwise(F.array().cast("array<string>"))
    every = F.array_compact(F.array(F.when(F.col("low") > 0.2 * F.col("total"), F.lit("filter by quality when collecting")), F.when(F.col("poor") > 0.3 * F.col("total"), F.lit("raise the quality threshold"))))
    found = rows.withColumns({"rank": rank, "total": total}).select(F.when(F.col("type").isNull(), every).otherwise(own).alias("a"))
    return found.agg(F.flatten(F.collect_list("a")).alias("a")).select(F.explode(F.when(F.size("a") > 0, F.array_sort("a")).otherwise(F.array(F.lit("quality is good")))).alias("what"))  # eight at most


def cleaning_statistics(cleaned: DataFrame, before: str = "before", after: str = "after", score: str = "score") -> DataFrame:
    """One row: documents, failures (null results), mean score over all documents, characters before and after, and the share removed."""
    ok = F.col(after).isNotNull()
    sums = cleaned.agg(F.count("*").alias("documents"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col(score))).alias("s"), F.coalesce(F.sum(F.length(before)), F.lit(0)).alias("chars_before"), F.coalesce(F.sum(F.length(after)), F.lit(0)).alias("chars_after"))
    removed = F.coalesce(F.try_divide(F.col("chars_before") - F.col("chars_after"), F.col("chars_before")), F.lit(0.0))
    return sums.select("documents", "failed", F.round(F.try_divide("s", "documents"), 6).alias("score"), "chars_before", "chars_after", F.round(removed, 6).alias("removed"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) of all columns in one aggregation."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def topic_summary(assigned: DataFrame, topic: str) -> DataFrame:
    """One row: topics, documents, the most and the least common topic with their counts; of equal ones the first by name."""
    n = assigned.where(F.col(topic).isNotNull()).groupBy(F.col(topic).cast("string").alias("topic")).agg(F.count("*").alias("n"))
    first = lambda sign: F.min(F.struct((sign * F.col("n")).alias("k"), F.col("topic").alias("topic")))
    return n.agg(F.count("*").alias("topics"), F.sum("n").alias("documents"), first(-1).alias("most"), first(1).alias("least")).select("topics", "documents", F.col("most.topic").alias("most"), (-F.col("most.k")).alias("most_n"), F.col("least.topic").alias("least"), F.col("least.k").alias("least_n"))


def language_summary(docs: DataFrame, language: str = "lang", top: int = 5) -> DataFrame:
    """(rank, language, n, share in percent, level of the corpus' diversity) of the top languages: beyond 1.5 bits high, beyond 0.8 medium."""
    level = F.when(F.col("entropy") > 1.5, "High").when(F.col("entropy") > 0.8, "Medium").otherwise("Low")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), language))  # a row a language
    ranked = distribution(docs, language).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.crossJoin(diversity(docs, language)).select("rank", F.col(language).alias("language"), "n", F.round("share", 1).alias("share"), level.alias("diversity"))  # one row on the right


def sentiment_label(polarity: Column) -> Column:
    return F.when(polarity > 0.1, "Positive").when(polarity < -0.1, "Negative").otherwise("Neutral")


def training_estimate(tokens: DataFrame, column: str, epochs: int, price: float, rate: int = 1000) -> DataFrame:
    """One row of tokens, hours at so many tokens a second, and cost at a price for 1,000 tokens. Arithmetic, not a measurement."""
    n = F.sum(column)
    return tokens.agg(F.count("*").alias("documents"), n.alias("tokens"), (n * epochs).alias("all_tokens"), F.round(n * epochs / rate / 3600, 6).alias("hours"), F.round(n * epochs / 1000 * price, 6).alias("cost"))


def accuracy_benchmark(docs: DataFrame, language: str, text: str, entities: Column) -> DataFrame:
    """The nominal confidences of detections, by length and by entities a document, as the benchmark defines them; nothing is compared with a truth."""
    known = F.col(language).isNotNull() & ~F.col(language).isin("", "unknown")
    mean = F.avg(entities)
    return docs.agg(F.round(F.avg(F.when(known, F.least(F.lit(0.95), 0.5 + F.length(text) / 10000))), 6).alias("language_confidence"), F.round(mean, 6).alias("entities"), F.round(F.least(F.lit(0.95), 0.7 + mean / 100), 6).alias("entity_precision"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from low to high; 0 is below, bins + 1 beyond."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def version_history(versions: DataFrame, log: DataFrame, version: str, entity: Column) -> DataFrame:
    """The versions whose changes meet the condition on the log, each once; a semi join, so a version with many changes isn't multiplied."""
    return versions.join(log.where(entity).select(F.col(version)), version, "left_semi")


def collection_info(df: DataFrame) -> DataFrame:
    """(field, kind, n) of the values of every top-level field, null for missing ones, over all rows."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.when(F.col(f"`{c}`").isNotNull(), F.lit(t)).alias("kind")) for c, t in df.dtypes)))
    return df.select(kinds.alias("k")).groupBy("k.field", "k.kind").agg(F.count("*").alias("n"))


def chunk_size(item_bytes: Column, items: Column, memory_mb: float) -> Column:
    """Items that fit into the memory: one at least, all at most."""
    return F.least(F.greatest(F.floor(F.lit(memory_mb * 1024 * 1024) / item_bytes), F.lit(1)), items)
