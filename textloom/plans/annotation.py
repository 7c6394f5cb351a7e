"""Queries of annotations: language, sentiment, domain, metadata, entities, token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.plans.registry import query, table
from textloom.plans.text import RAW_SQL, SENTENCES_SQL

_COUNTS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
SCRIPT_SQL = "CASE " + " ".join(f"WHEN s{k} > 0 AND s{k} >= greatest({', '.join(f's{j}' for j in range(len(L.SCRIPTS)))}) THEN '{n}'" for k, n in enumerate(L.SCRIPTS)) + " END"
LANGUAGE_SQL = f"""WITH s AS (SELECT doc_id, {_COUNTS} AS w, {', '.join(f"length(text) - length(regexp_replace(text, '[{c}]', '', 'g')) AS s{k}" for k, c in enumerate(L.SCRIPTS.values()))} FROM documents),
    c AS (SELECT doc_id, len(w) AS n, {SCRIPT_SQL} AS script, {', '.join(f"len(list_filter(w, lambda x: x IN {tuple(v.split())})) AS l_{k}" for k, v in L.LANGUAGE_WORDS.items())} FROM s),
    b AS (SELECT *, greatest({', '.join(f'l_{k}' for k in L.LANGUAGE_WORDS)}) AS best FROM c)
    SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN best = 0 THEN CASE WHEN script = 'latin' THEN 'en' ELSE 'unknown' END {' '.join(f"WHEN l_{k} = best THEN '{k}'" for k in L.LANGUAGE_WORDS)} END AS language,
    round(CASE WHEN n = 0 THEN 0 WHEN best = 0 THEN CASE WHEN script = 'latin' THEN 0.3 ELSE 0 END ELSE least(1, best / n) END::DOUBLE, 6) AS confidence, script FROM b"""


@query("language_patterns", LANGUAGE_SQL)
def language_patterns(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.language(F.col("text")).alias("l")).select("doc_id", "l.*")


@query("language_detected_distribution", f"SELECT language, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.7) AS reliable, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most FROM ({LANGUAGE_SQL}) GROUP BY language")
def language_detected_distribution(spark, sf):
    d = language_patterns(spark, sf)
    return d.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("reliable"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query("language_filter", f"SELECT doc_id, language IN ('en', 'de') AND confidence >= 0.1 AS kept, CASE WHEN language NOT IN ('en', 'de') THEN 'language' WHEN confidence < 0.1 THEN 'confidence' ELSE 'kept' END AS reason FROM ({LANGUAGE_SQL})")
def language_filter(spark, sf):
    d = language_patterns(spark, sf)
    allowed, sure = F.col("language").isin("en", "de"), F.col("confidence") >= 0.1
    return d.select("doc_id", (allowed & sure).alias("kept"), F.when(~allowed, "language").when(~sure, "confidence").otherwise("kept").alias("reason"))


_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
_INTENSITY = "CASE " + " ".join(f"WHEN b1 = '{w}' THEN {x}" for w, x in L.INTENSIFIERS.items()) + " ELSE 1.0 END"
_EMOTIONS = sorted(set(L.EMOTIONS.values()))
_EMOTION = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(w) for w, v in L.EMOTIONS.items() if v == e)}) THEN {k}" for k, e in enumerate(_EMOTIONS)) + " END"


def sentiment_sql(source: str, keys: str) -> str:
    """Polarity, subjectivity, confidence and emotion of source's texts, with the words as rows."""
    return f"""WITH t AS (SELECT {keys}, {_WORDS} AS w FROM {source}), u AS (SELECT {keys}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
    v AS (SELECT *, coalesce(lag(x, 1) OVER o, '') AS b1, coalesce(lag(x, 2) OVER o, '') AS b2 FROM u WINDOW o AS (PARTITION BY {keys} ORDER BY i)),
    s AS (SELECT {keys}, CASE WHEN x IN {L.POSITIVE} THEN 1.0 WHEN x IN {L.NEGATIVE} THEN -1.0 ELSE 0 END::DOUBLE * CASE WHEN b1 IN {L.NEGATIONS} THEN -0.8 WHEN b2 IN {L.NEGATIONS} THEN -0.6 ELSE 1.0 END::DOUBLE * ({_INTENSITY})::DOUBLE AS s, {_EMOTION} AS e FROM v),
    f AS (SELECT {keys}, e, sum(abs(s)) AS m FROM s WHERE e IS NOT NULL GROUP BY ALL), g AS (SELECT {keys}, e FROM f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY m DESC, e) = 1),
    h AS (SELECT {keys}, sum(greatest(s, 0)) AS up, sum(greatest(-s, 0)) AS down FROM s GROUP BY {keys}),
    p AS (SELECT {keys}, coalesce(up, 0) / greatest(len(w), 1) AS up, coalesce(down, 0) / greatest(len(w), 1) AS down FROM t LEFT JOIN h USING ({keys}))
    SELECT {keys}, round(up - down, 6) AS polarity, round(least(1, up + down), 6) AS subjectivity, round(least(1, abs(up - down) + 0.5 * least(1, up + down)), 6) AS confidence,
    coalesce({_EMOTIONS}[e + 1], CASE WHEN up - down > 0.1 THEN 'joy' WHEN up - down < -0.1 THEN 'sadness' ELSE 'neutral' END) AS emotion FROM p LEFT JOIN g USING ({keys})"""


@query("sentiment", sentiment_sql("documents", "doc_id"))
def sentiment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("sentiment_summary", f"SELECT emotion, count(*) AS n, round(avg(polarity), 6) AS polarity, round(avg(subjectivity), 6) AS subjectivity, count(*) FILTER (WHERE polarity > 0.1) AS positive, count(*) FILTER (WHERE polarity < -0.1) AS negative, min(confidence) AS least, max(confidence) AS most FROM ({sentiment_sql('documents', 'doc_id')}) GROUP BY emotion")
def sentiment_summary(spark, sf):
    s = sentiment(spark, sf)
    return s.groupBy("emotion").agg(F.count("*").alias("n"), F.round(F.avg("polarity"), 6).alias("polarity"), F.round(F.avg("subjectivity"), 6).alias("subjectivity"), F.count_if(F.col("polarity") > 0.1).alias("positive"), F.count_if(F.col("polarity") < -0.1).alias("negative"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query("sentence_sentiment", sentiment_sql(f"(SELECT conv_id, turn, unnest({SENTENCES_SQL}) AS text, (generate_subscripts({SENTENCES_SQL}, 1) - 1)::INT AS k FROM conversations)", "conv_id, turn, k"))
def sentence_sentiment(spark, sf):
    one = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence"))
    return one.select("conv_id", "turn", "k", A.sentiment(F.col("sentence")).alias("s")).select("conv_id", "turn", "k", "s.*")


_SCORES = {d: "(" + " + ".join([*(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in keys), f"2 * len(regexp_extract_all(text, '(?i)\\b(?:{p})\\b'))"]) + ")" for d, (keys, p) in L.TAXONOMY.items()}


@query("taxonomy", f"""WITH s AS (SELECT doc_id, greatest(len({RAW_SQL}), 1) AS n, {', '.join(f'{s} AS {d}' for d, s in _SCORES.items())} FROM (SELECT doc_id, text, lower(text) AS t FROM documents)), b AS (SELECT *, greatest({', '.join(L.TAXONOMY)}) AS best FROM s)
    SELECT doc_id, CASE WHEN best = 0 OR least(1, 10.0 * best / n) < 0.3 THEN 'uncategorized' {' '.join(f"WHEN {d} = best THEN '{d}'" for d in L.TAXONOMY)} END AS domain, round(least(1, 10.0 * best / n)::DOUBLE, 6) AS confidence FROM b""")
def taxonomy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.domain(F.col("text")).alias("d")).select("doc_id", "d.*")


_FOUND = {k: "trim(coalesce(" + ", ".join("nullif(regexp_extract(text, '" + p.replace("'", "''") + "', 1), '')" for p in ps) + "))" for k, ps in (("author", A.AUTHOR), ("date", A.DATE), ("url", A.URL), ("title", A.TITLE))}
METADATA_SQL = f"SELECT doc_id, author, date, url, title, ((author IS NOT NULL)::INT + (date IS NOT NULL)::INT + (url IS NOT NULL)::INT + (title IS NOT NULL)::INT) / 4::DOUBLE AS confidence FROM (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _FOUND.items())} FROM documents)"


@query("metadata_patterns", METADATA_SQL)
def metadata_patterns(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("metadata_coverage", f"SELECT count(*) AS n, count(author) AS author, count(date) AS date, count(url) AS url, count(title) AS title, round(avg(confidence), 6) AS confidence FROM ({METADATA_SQL})")
def metadata_coverage(spark, sf):
    m = metadata_patterns(spark, sf)
    return m.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in ("author", "date", "url", "title")), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("entity_statistics", "SELECT label, count(*) AS n, count(DISTINCT lower(t)) AS kinds FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS label, unnest(regexp_extract_all(text, '{p}')) AS t FROM documents" for k, p in A.ENTITIES.items()) + ") GROUP BY label")
def entity_statistics(spark, sf):
    e = table(spark, sf, "documents").select(F.explode(A.entities(F.col("text"), most=2**31 - 1)).alias("e")).select("e.*")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(F.lower("text")).alias("kinds"))


@query("token_budget", """SELECT doc_id, n, n <= 4096 AS fits, round(n / 4096, 6) AS utilisation, greatest(n - 4096, 0) AS over, ceil(n / 4096)::BIGINT AS chunks, round(n / 1000 * 0.0015, 6) AS cost
    FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents)""")
def token_budget(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n"))
    return d.select("doc_id", "n", A.token_fit(F.col("n"), "small-4k").alias("f")).select("doc_id", "n", "f.*")


@query("token_statistics", """SELECT band, count(*) AS docs, sum(n)::BIGINT AS tokens, round(sum(n) / 1000 * 0.03, 6) AS cost FROM (SELECT n, CASE WHEN n < 100 THEN '0' WHEN n < 500 THEN '100' WHEN n < 1000 THEN '500' WHEN n < 2000 THEN '1000' WHEN n < 4000 THEN '2000' ELSE '4000' END AS band
    FROM (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents)) GROUP BY band""")
def token_statistics(spark, sf):
    n = F.col("n")
    band = F.when(n < 100, "0").when(n < 500, "100").when(n < 1000, "500").when(n < 2000, "1000").when(n < 4000, "2000").otherwise("4000")
    d = table(spark, sf, "documents").select(T.token_count(F.col("text")).alias("n")).withColumn("band", band)
    return d.groupBy("band").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.round(F.sum("n") / 1000 * 0.03, 6).alias("cost"))
