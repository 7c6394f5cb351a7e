"""Queries of summaries, recommendations, checks and the warehouse's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.functions import lexicons as L
from textloom.functions import quality as Q
from textloom.functions import text as T
from textloom.operators import reports as R
from textloom.operators import validation as V
from textloom.operators import warehouse as W
from textloom.plans.annotation import _SCORES
from textloom.plans.quality import LENGTH_SQL, scored
from textloom.plans.registry import query, table
from textloom.plans.text import RAW_SQL
from textloom.sources import files as X
from textloom.sources import formats

_CLEANED = f"SELECT doc_id, lang, text AS before, {T.rewrite_sql('text', [*T.WHITESPACE, *T.GLOBAL_BOILERPLATE, *T.PII])} AS after FROM documents"


def _cleaned(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("before"), T.rewrite(F.col("text"), [*T.WHITESPACE, *T.GLOBAL_BOILERPLATE, *T.PII]).alias("after"))


@query("quality_recommendations")
def quality_recommendations(spark, sf):
    s = scored(spark, sf).select(F.col("s.overall").alias("overall"), Q.grade(F.col("s.overall")).alias("grade"), "issues")
    return R.recommendations(s)


_PREPROCESSED = """CASE WHEN n = 0 THEN 0 ELSE least(greatest(0.3 * CASE WHEN n < 50 THEN n / 50.0::DOUBLE * 0.5 WHEN n <= 1000 THEN 0.5 + n / 1000.0::DOUBLE * 0.5 ELSE 1 END + 0.2 * (n >= 10)::INT + 0.2 * least(1, variety / 26.0::DOUBLE)
    + 0.2 * CASE WHEN gone BETWEEN 0.1 AND 0.4 THEN 1 WHEN gone < 0.1 THEN 0.8 ELSE greatest(0.3, 1 - (gone - 0.4) * 2) END + 0.1 * CASE WHEN n >= 10 THEN 1 ELSE 0.5 END, 0), 1) END"""


@query("preprocessor_scores", f"SELECT doc_id, round(({_PREPROCESSED})::DOUBLE, 6) AS score FROM (SELECT doc_id, length(after) AS n, len(list_distinct(list_filter(string_split(lower(after), ''), lambda c: c <> ''))) AS variety, 1 - length(after) / greatest(length(before), 1)::DOUBLE AS gone FROM ({_CLEANED}))")
def preprocessor_scores(spark, sf):
    d = _cleaned(spark, sf)
    return d.select("doc_id", F.round(Q.preprocessor_score(F.col("before"), F.col("after"), F.length("after") >= 10), 6).alias("score"))


_UNCLEAN = f"""SELECT doc_id, [x FOR x IN [CASE WHEN regexp_matches(text, '{Q.BROKEN}') THEN 'broken sentences' END, CASE WHEN len(regexp_extract_all(text, '{Q.CLUSTER}')) > length(text) / 1000.0 THEN 'gibberish' END,
    CASE WHEN length(text) > 0 AND length(regexp_replace(text, '[\\p{{L}}\\p{{N}}_\\s]', '', 'g')) > 0.1 * length(text) THEN 'many signs' END, CASE WHEN contains(text, chr(65533)) THEN 'bad encoding' END] IF x IS NOT NULL] AS found FROM documents"""


@query("cleanliness", f"SELECT what, count(*) AS n FROM (SELECT unnest(CASE WHEN len(found) = 0 THEN ['clean'] ELSE found END) AS what FROM ({_UNCLEAN})) GROUP BY what")
def cleanliness(spark, sf):
    found = table(spark, sf, "documents").select(Q.uncleanliness(F.col("text")).alias("f"))
    return found.select(F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(F.lit("clean")))).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


@query("quality_rule", f"""WITH s AS (SELECT doc_id, {LENGTH_SQL} AS score FROM (SELECT doc_id, length(text)::DOUBLE AS n FROM documents)) SELECT doc_id AS id, 'quality' AS rule, 'INFO' AS severity, 'document below the least score' AS what FROM s WHERE score < 0.3
    UNION ALL SELECT NULL, 'quality', 'WARNING', 'dataset below the least score' FROM s HAVING avg(score) < 0.3""")
def quality_rule(spark, sf):
    return V.quality_issues(table(spark, sf, "documents").select("doc_id", Q.length_score(F.col("text")).alias("score")), "score")


@query("boilerplate_statistics", "SELECT name, split_part(name, '_', 1) AS type, count(*) AS docs, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in T.BOILERPLATE.items()) + ") WHERE n > 0 GROUP BY ALL")
def boilerplate_statistics(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(T.boilerplate_found(F.col("text"))).alias("name", "matches"))
    return found.groupBy("name", F.split_part("name", F.lit("_"), F.lit(1)).alias("type")).agg(F.count("*").alias("docs"), F.sum(F.size("matches")).alias("n"))


@query("metadata_merged", f"SELECT doc_id, coalesce(nullif(regexp_extract(text, '{A.DATE[0]}', 1), ''), source) AS date, coalesce(nullif(regexp_extract(text, '{A.URL[1].replace("'", "''")}', 1), ''), source) AS source_url FROM documents")
def metadata_merged(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", A.merged(F.col("source"), F.regexp_extract("text", A.DATE[0], 1)).alias("date"), A.merged(F.col("source"), F.regexp_extract("text", A.URL[1], 1)).alias("source_url"))


@query("language_names", "SELECT CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANGUAGE_NAMES.items()) + " ELSE lang END AS language, count(*) AS n FROM documents GROUP BY ALL")
def language_names(spark, sf):
    return table(spark, sf, "documents").groupBy(A.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


@query("version_history", "SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 7")
def version_history(spark, sf):
    log = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.version_history(table(spark, sf, "orders"), log, "o_orderkey", F.col("l_partkey") == 7).select("o_orderkey", "o_orderdate")


@query("cleaning_statistics", f"SELECT count(*) AS documents, count(*) FILTER (WHERE after IS NULL) AS failed, round(sum(least(length(after) / 800, 1)) / count(*), 6) AS score, sum(length(before))::BIGINT AS chars_before, sum(length(after))::BIGINT AS chars_after, round(1 - sum(length(after)) / sum(length(before)), 6) AS removed FROM ({_CLEANED})")
def cleaning_statistics(spark, sf):
    return R.cleaning_statistics(_cleaned(spark, sf).withColumn("score", F.least(F.length("after") / 800, F.lit(1.0))))


@query("sample_statistics", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def sample_statistics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return R.value_counts(d, ["lang", "source", "toxic"])


@query("training_estimate", "SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, (sum(n) * 3)::BIGINT AS all_tokens, round(sum(n) * 3 / 1000.0 / 3600, 6) AS hours, round(sum(n) * 3 / 1000.0 * 0.0015, 6) AS cost FROM (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents)")
def training_estimate(spark, sf):
    return R.training_estimate(table(spark, sf, "documents").select(T.token_count(F.col("text")).alias("n")), "n", 3, 0.0015)


@query("topic_summary", f"""WITH d AS (SELECT CASE WHEN best = 0 OR least(1, 10.0 * best / n) < 0.3 THEN 'uncategorized' {' '.join(f"WHEN {d} = best THEN '{d}'" for d in L.TAXONOMY)} END AS topic FROM (SELECT *, greatest({', '.join(L.TAXONOMY)}) AS best FROM (SELECT greatest(len({RAW_SQL}), 1) AS n, {', '.join(f'{s} AS {d}' for d, s in _SCORES.items())} FROM (SELECT text, lower(text) AS t FROM documents)))),
    c AS (SELECT topic, count(*) AS n FROM d GROUP BY topic) SELECT count(*) AS topics, sum(n)::BIGINT AS documents, (SELECT topic FROM c ORDER BY n DESC, topic LIMIT 1) AS most, max(n) AS most_n, (SELECT topic FROM c ORDER BY n, topic LIMIT 1) AS least, min(n) AS least_n FROM c""")
def topic_summary(spark, sf):
    return R.topic_summary(table(spark, sf, "documents").select(A.domain(F.col("text"))["domain"].alias("topic")), "topic")


@query("language_summary", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t, -sum(n / (SELECT sum(n) FROM n) * log2(n / (SELECT sum(n) FROM n))) AS h FROM n)
    SELECT row_number() OVER (ORDER BY n DESC, lang)::INT AS rank, lang AS language, n, round(100.0 * n / t, 1) AS share, CASE WHEN h > 1.5 THEN 'High' WHEN h > 0.8 THEN 'Medium' ELSE 'Low' END AS diversity FROM n, t QUALIFY rank <= 5""")
def language_summary(spark, sf):
    return R.language_summary(table(spark, sf, "documents"))


@query("accuracy_benchmark", f"SELECT round(avg(least(0.95, 0.5 + length(text) / 10000.0::DOUBLE)) FILTER (WHERE lang IS NOT NULL AND lang NOT IN ('', 'unknown')), 6) AS language_confidence, round(avg(e), 6) AS entities, round(least(0.95, 0.7 + avg(e) / 100), 6) AS entity_precision FROM (SELECT text, lang, {' + '.join(f'''len(regexp_extract_all(text, '{p}'))''' for p in A.ENTITIES.values())} AS e FROM documents)")
def accuracy_benchmark(spark, sf):
    return R.accuracy_benchmark(table(spark, sf, "documents"), "lang", "text", F.size(A.entities(F.col("text"), most=2**31 - 1)))


@query("length_histogram", "SELECT CASE WHEN n < 0 THEN 0 WHEN n >= 5000 THEN 11 ELSE n // 500 + 1 END AS bin, count(*) AS n FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY bin")
def length_histogram(spark, sf):
    return R.histogram(table(spark, sf, "documents").select(F.length("text").alias("chars")), "chars", 0, 5000, 10)


@query("collection_info", "SELECT unnest(['event_id', 'user_id', 'event_type', 'value']) AS field, unnest(['bigint', 'bigint', 'string', 'double']) AS kind, (SELECT count(*) FROM events) AS n")
def collection_info(spark, sf):
    return R.collection_info(table(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value")))


@query("chunk_sizes", "SELECT source, least(greatest(floor(1048576.0 / avg(n_chars)), 1)::BIGINT, count(*)) AS items FROM documents GROUP BY source")
def chunk_sizes(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    return s.select("source", R.chunk_size(F.col("mean"), F.col("n"), 1.0).alias("items"))


@query("tabular_arrays", "SELECT conv_id, count(*) >= 2 AND count(*) % 2 = 1 AS tabular FROM conversations GROUP BY conv_id")
def tabular_arrays(spark, sf):
    """Conversations as JSON arrays; in those of an even number of turns the last lacks a key, or is an array."""
    t = formats.conversations(table(spark, sf, "conversations"))
    items = F.transform("turns", lambda x: F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    n = F.size("turns")
    odd = F.concat(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), F.array(F.when(n % 4 == 0, F.lit("[1]")).otherwise(F.lit('{"role": "user"}'))))
    arrays = F.concat(F.lit("["), F.array_join(F.when(n % 2 == 1, items).otherwise(odd), ","), F.lit("]"))
    return t.select("conv_id", X.is_tabular(arrays).alias("tabular"))


_UPPER = "upper(s) = s AND lower(s) <> s AND length(s) BETWEEN 5 AND 50"
_NUMBERED = r"^[A-Z][A-Z\s]+$|^\d+\.\s+[A-Z]|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$|^(?:Chapter|Section)\s+\d+|^Appendix\s+[A-Z]"


@query("heading_lines", f"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) BETWEEN 3 AND 100 AND (regexp_matches(s, '{_NUMBERED}') OR {_UPPER} OR NOT regexp_matches(s, '[.!?,;]$') AND length(s) <= 80 AND regexp_matches(s, '^\\p{{Lu}}\\S*(?:\\s+\\p{{Lu}}\\S*)+$')))) AS headings FROM documents")
def heading_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.headings(F.col("text"))).cast("long").alias("headings"))


@query("star_documents", f"""SELECT doc_id::VARCHAR AS id, source AS source_path, 'text' AS file_type, strlen(text) AS size_bytes, lang AS language, {LENGTH_SQL} AS quality_score FROM (SELECT *, length(text)::DOUBLE AS n FROM documents)""")
def star_documents(spark, sf):
    return W.star(table(spark, sf, "documents"), "corpus")["documents"].select("id", "source_path", "file_type", "size_bytes", "language", "quality_score")


@query("star_entities", "SELECT label, count(*) AS n, count(DISTINCT document_id) AS documents FROM (" + " UNION ALL ".join(f"SELECT doc_id AS document_id, '{k}' AS label, unnest(regexp_extract_all(text, '{p}')) AS t FROM documents" for k, p in A.ENTITIES.items()) + ") GROUP BY label")
def star_entities(spark, sf):
    return W.star(table(spark, sf, "documents"), "corpus")["document_entities"].groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query("star_datasets", "SELECT 'corpus' AS id, count(*) AS documents FROM documents")
def star_datasets(spark, sf):
    return W.star(table(spark, sf, "documents"), "corpus")["datasets"].select("id", "documents")


@query("star_members", "SELECT dataset_id, split, count(*) AS n FROM (SELECT 'corpus' AS dataset_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT ('0x' || substr(md5('split' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)) GROUP BY ALL")
def star_members(spark, sf):
    return W.star(table(spark, sf, "documents"), "corpus")["dataset_documents"].groupBy("dataset_id", "split").agg(F.count("*").alias("n"))
