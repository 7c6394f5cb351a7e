"""Queries of quality scores, reports and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import quality as Q
from textloom.functions import text as T
from textloom.operators import similarity as S
from textloom.operators import validation as V
from textloom.plans.registry import query, table
from textloom.plans.text import PAIRS_SQL, RAW_SQL, SENTENCES_SQL

LENGTH_SQL = "CASE WHEN n < 50 THEN 0.2 WHEN n > 50000 THEN 0.7 WHEN n BETWEEN 200 AND 5000 THEN 1.0 WHEN n < 200 THEN greatest(0.5, n / 200) ELSE greatest(0.6, 1 - 0.4 * (n - 5000) / 5000) END"
LANGUAGE_SQL = "CASE WHEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / n > 0.3 THEN 0.8 ELSE 1 END * CASE WHEN contains(text, '�') THEN 0.5 ELSE 1 END * CASE WHEN length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) / n > 0.2 THEN 0.9 ELSE 1 END"
READABILITY_SQL = f"""coalesce(least(greatest((206.835 - 1.015 * len({RAW_SQL}) / nullif(len({SENTENCES_SQL}), 0) - 84.6 * list_sum(list_transform({RAW_SQL}, lambda w: greatest(length(w) - length(regexp_replace(w, '[aeiouAEIOU]', '', 'g')), 1))) / nullif(len({RAW_SQL}), 0)) / 100, 0), 1), 0)"""
STRUCTURE_SQL = f"CASE WHEN contains(text, chr(10) || chr(10)) OR n <= 500 THEN 1 ELSE 0.8 END * CASE WHEN regexp_matches(text, '{Q.FORMATTING}') THEN 0.9 ELSE 1 END"
COMPLETENESS_SQL = "least(1, CASE WHEN regexp_matches(text, '" + Q.INCOMPLETE + "') THEN 0.6 ELSE 1 END + least(0.2, 0.05 * (" + " + ".join(f"regexp_matches(lower(text), '{'|'.join(w)}')::INT" for w in L.COMPLETENESS.values()) + ")))"


@query("quality_simple", """SELECT doc_id, round((least(length(text) / 800, 1) + CASE WHEN lang IS NULL OR lower(lang) IN ('', 'unknown') THEN 0.5 ELSE 1 END + greatest(0, 1 - least(1, 10.0 * (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F]', '', 'g'))) / greatest(length(text), 1)))) / 3, 6) AS overall,
    round(least(length(text) / 800, 1), 6) AS length FROM documents""")
def quality_simple(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", Q.simple_score(F.col("text"), F.col("lang"), places=6).alias("s"))
    return s.select("doc_id", "s.overall", "s.length")


@query("quality_factors_plain", f"SELECT doc_id, round({LENGTH_SQL}, 6) AS length, round(({LANGUAGE_SQL})::DOUBLE, 6) AS language, round({READABILITY_SQL} + 1e-10, 6) AS readability, round(({STRUCTURE_SQL})::DOUBLE, 6) AS structure, round(({COMPLETENESS_SQL})::DOUBLE, 6) AS completeness FROM (SELECT doc_id, text, length(text)::DOUBLE AS n FROM documents)")
def quality_factors_plain(spark, sf):
    t = F.col("text")
    scores = {"length": Q.length_score(t), "language": Q.language_score(t), "readability": Q.readability_score(t) + 1e-10, "structure": Q.structure_score(t), "completeness": Q.completeness_score(t)}
    return table(spark, sf, "documents").select("doc_id", *(F.round(x, 6).alias(k) for k, x in scores.items()))  # 1e-10 settles ties at the sixth place alike in both engines


def scored(spark, sf):
    docs = table(spark, sf, "documents")
    near = S.nearest(docs).select(F.col("id").alias("doc_id"), F.col("similarity").alias("near")).where("doc_id IS NOT NULL").distinct()
    all_docs = docs.join(near, "doc_id", "left").withColumn("near", F.coalesce("near", F.lit(0.0)))  # a row a document, without an id or with another's too
    return all_docs.select("doc_id", "lang", "near", Q.factors(F.col("text"), 1 - F.col("near")).alias("s"), Q.issues(F.col("text"), F.col("near")).alias("issues"))


@query("quality_scores")
def quality_scores(spark, sf):
    return scored(spark, sf).select("doc_id", "s.*", Q.grade(F.col("s.overall")).alias("grade"), Q.level(F.col("s.overall")).alias("level"))


_ISSUES = [
    ("length", "high", "shorter than 50 characters", "length(text) < 50"), ("length", "medium", "longer than 50,000 characters", "length(text) > 50000"),
    ("language", "medium", "many characters outside ASCII", "length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / n > 0.3"), ("language", "high", "replacement characters", "contains(text, chr(65533))"), ("language", "low", "many signs", "length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) / n > 0.2"),
    ("readability", "medium", "long sentences", f"len({RAW_SQL}) / greatest(len({SENTENCES_SQL}), 1) > 25"), ("structure", "medium", "no break between paragraphs", "NOT contains(text, chr(10) || chr(10)) AND length(text) > 500"),
    ("structure", "low", "untidy spacing or signs", f"regexp_matches(text, '{Q.FORMATTING}')"), ("completeness", "high", "unfinished", f"regexp_matches(text, '{Q.INCOMPLETE}')"), ("uniqueness", "high", "very like another document", "near > 0.8"), ("uniqueness", "medium", "like another document", "near > 0.6 AND near <= 0.8"),
]


@query("quality_issues", f"""WITH {PAIRS_SQL}, q AS (SELECT a AS doc_id, k / (na + nb - k) AS s FROM i UNION ALL SELECT b, k / (na + nb - k) FROM i), m AS (SELECT doc_id, max(s) AS near FROM q GROUP BY doc_id), d AS (SELECT text, greatest(length(text), 1)::DOUBLE AS n, coalesce(near, 0) AS near FROM documents LEFT JOIN m USING (doc_id))
    SELECT type, severity, what, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT '{t}' AS type, '{s}' AS severity, '{w}' AS what FROM d WHERE {test}" for t, s, w, test in _ISSUES) + ") GROUP BY ALL")
def quality_issues(spark, sf):
    """What is like another document begins at 0.6, so only pairs from there are looked for."""
    docs = table(spark, sf, "documents")
    pairs = S.similar_pairs(docs, 0.6)
    near = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "similarity").groupBy("doc_id").agg(F.max("similarity").alias("near"))
    found = docs.join(near, "doc_id", "left").select("doc_id", Q.issues(F.col("text"), F.coalesce("near", F.lit(0.0))).alias("issues"))
    return found.select("doc_id", F.explode("issues").alias("i")).groupBy("i.type", "i.severity", "i.what").agg(F.count("*").alias("n"))


@query("quality_report")
def quality_report(spark, sf):
    """Mean, bounds, population deviation, grades and shares of the overall score."""
    s = scored(spark, sf).select(F.col("s.overall").alias("x"), Q.grade(F.col("s.overall")).alias("g"))
    share = lambda *g: F.round(100 * F.count_if(F.col("g").isin(*g)) / F.count("*"), 4)
    return s.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.round(F.stddev_pop("x"), 6).alias("deviation"), *(F.count_if(F.col("g") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"), share("A", "B").alias("high_quality"), share("D", "F").alias("low_quality"))


@query("quality_vs_label", f"SELECT quality, count(*) AS n, round(avg({LENGTH_SQL}), 6) AS length, round(avg({STRUCTURE_SQL}), 6) AS structure FROM (SELECT doc_id, text, length(text)::DOUBLE AS n FROM documents) JOIN labels USING (doc_id) GROUP BY quality")
def quality_vs_label(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(Q.length_score(F.col("text"))), 6).alias("length"), F.round(F.avg(Q.structure_score(F.col("text"))), 6).alias("structure"))


@query("quality_bands", f"SELECT CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT {READABILITY_SQL} AS s FROM documents) GROUP BY band")
def quality_bands(spark, sf):
    return table(spark, sf, "documents").select(Q.band(Q.readability_score(F.col("text"))).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


_CLEANED = T.rewrite_sql("text", [*T.CONTROL, *T.WHITESPACE, *T.TEXT_NOISE, *T.WEB_NOISE, *T.GLOBAL_BOILERPLATE, *T.GENERATED, *T.CODE_SECRETS, *T.PII, *T.FINAL])


@query("clean_scores", f"""SELECT doc_id, round(0.2 * CASE WHEN n < 100 THEN n / 100.0 * 0.5 WHEN n < 1000 THEN 0.5 + 0.5 * (n - 100) / 900.0 ELSE 1 END + 0.2 * CASE WHEN lang = 'en' THEN 1 ELSE 0.5 END + 0.3 * least(greatest(1 - (1 - n / greatest(m, 1)) / 0.4, 0), 1) + 0.3, 6) AS score
    FROM (SELECT doc_id, lang, length({_CLEANED})::DOUBLE AS n, length(text)::DOUBLE AS m FROM documents)""")
def clean_scores(spark, sf):
    d = table(spark, sf, "documents").withColumn("c", T.clean_document(F.col("text")))
    return d.select("doc_id", F.round(Q.clean_score(F.col("c"), F.col("text"), F.col("lang") == "en"), 6).alias("score"))


@query("validation_issues", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), i AS (
    SELECT doc_id, 'content' AS rule, 'too short' AS what FROM d WHERE n < 10 UNION ALL SELECT doc_id, 'content', 'too long' FROM d WHERE n > 1000000
    UNION ALL SELECT doc_id, 'content', 'mostly white space' FROM d WHERE n > 0 AND length(regexp_replace(text, '\\s', '', 'g')) < 0.1 * n
    UNION ALL SELECT doc_id, 'consistency', 'duplicate id' FROM d GROUP BY doc_id HAVING count(*) > 1) SELECT rule, what, count(*) AS n FROM i GROUP BY ALL""")
def validation_issues(spark, sf):
    return V.issues(table(spark, sf, "documents")).groupBy("rule", "what").agg(F.count("*").alias("n"))


@query("validation_summary", """WITH i AS (SELECT 'error' AS s FROM documents WHERE length(text) < 10 UNION ALL SELECT 'error' FROM documents WHERE text IS NULL UNION ALL SELECT 'warning' FROM documents WHERE length(text) > 1000000
    UNION ALL SELECT 'warning' FROM documents WHERE length(text) > 0 AND length(regexp_replace(text, '\\s', '', 'g')) < 0.1 * length(text) UNION ALL SELECT 'critical' FROM documents GROUP BY doc_id HAVING count(*) > 1)
    SELECT count(*) AS issues, 0::BIGINT AS info, count(*) FILTER (WHERE s = 'warning') AS warning, count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'critical') AS critical, count(*) FILTER (WHERE s IN ('error', 'critical')) = 0 AS valid FROM i""")
def validation_summary(spark, sf):
    return V.summary(V.issues(table(spark, sf, "documents")))


@query("completeness", "SELECT count(*) AS n, round(count(*) FILTER (WHERE lang IS NULL OR lang IN ('', 'unknown')) / count(*), 6) AS lang, round(count(*) FILTER (WHERE source IS NULL OR source IN ('', 'unknown')) / count(*), 6) AS source FROM documents")
def completeness(spark, sf):
    return V.missing_ratios(table(spark, sf, "documents"), ["lang", "source"])


@query("consistency_benchmark", """SELECT count(*) AS n, round(1 - count(DISTINCT md5(substr(text, 1, 1000))) / count(*), 6) AS duplicate_ratio, round(count(*) FILTER (WHERE NOT contains(text, '�')) / count(*), 6) AS encoding_ratio,
    (SELECT round(max(k) / sum(k), 6) FROM (SELECT count(*) AS k FROM documents GROUP BY lang)) AS language_dominance FROM documents""")
def consistency_benchmark(spark, sf):
    return V.consistency(table(spark, sf, "documents"))


@query("performance_benchmark", "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 50000.0, 6) AS seconds FROM documents")
def performance_benchmark(spark, sf):
    """The nominal rate of 50,000 characters a second: arithmetic, not a measurement."""
    chars = F.sum(F.length("text"))
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), chars.alias("chars"), F.round(chars / 50000, 6).alias("seconds"))


@query("metric_thresholds", "SELECT source, n, n >= 30 AS passed, n < 0.9 * avg(n) OVER () AS regressed FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def metric_thresholds(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy(F.lit(0)))  # a row a source
    return n.select("source", "n", V.passes(F.col("n"), 30).alias("passed"), V.regressed(F.col("n"), mean).alias("regressed"))
