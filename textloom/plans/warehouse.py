"""Queries of partitions, versions, incremental updates and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import warehouse as W
from textloom.plans.registry import query, table


@query("partition_hash", "SELECT bucket, count(*) AS docs, sum(n_chars)::BIGINT AS bytes, round(avg(n_chars), 6) AS mean FROM (SELECT n_chars, ('0x' || right(md5(doc_id::VARCHAR), 1))::BIGINT AS bucket FROM documents) GROUP BY bucket")
def partition_hash(spark, sf):
    return W.partition_statistics(table(spark, sf, "documents").withColumn("bucket", W.hash_bucket(F.col("doc_id"), 16)), "bucket", "n_chars")


@query("partition_language", "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS bytes, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def partition_language(spark, sf):
    return W.partition_statistics(table(spark, sf, "documents"), "lang", "n_chars")


@query("partition_dates", """SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y') || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL""")
def partition_dates(spark, sf):
    return table(spark, sf, "events").groupBy(*(W.date_bucket(F.col("ts"), u).alias(u) for u in ("day", "week", "month"))).agg(F.count("*").alias("n"))


@query("partition_bands", "SELECT CASE WHEN s < 0.3 THEN 'low' WHEN s < 0.6 THEN 'medium' WHEN s < 0.8 THEN 'high' ELSE 'excellent' END AS band, count(*) AS n FROM (SELECT least(n_chars / 5000, 1) AS s FROM documents) GROUP BY band")
def partition_bands(spark, sf):
    return table(spark, sf, "documents").groupBy(W.quality_band(F.least(F.col("n_chars") / 5000, F.lit(1.0))).alias("band")).agg(F.count("*").alias("n"))


@query("partition_fill", """WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
    r(lang, doc_id, k, part, held) AS (SELECT lang, doc_id, k, 0::BIGINT, n FROM d WHERE k = 1 UNION ALL
    SELECT d.lang, d.doc_id, d.k, part + (held > 0 AND held + n > 100000)::INT, CASE WHEN held > 0 AND held + n > 100000 THEN n ELSE held + n END FROM r JOIN d ON d.lang = r.lang AND d.k = r.k + 1) SELECT lang, doc_id, part FROM r""")
def partition_fill(spark, sf):
    return W.fill(table(spark, sf, "documents"), "lang", "doc_id", "n_chars", 100_000)


@query("partition_merge", """WITH s AS (SELECT source, sum(n_chars) AS bytes FROM documents GROUP BY source), h AS (SELECT source, floor((sum(bytes) OVER (ORDER BY bytes, source ROWS UNBOUNDED PRECEDING) - bytes) / 150000)::BIGINT AS h FROM s WHERE bytes < 150000)
    SELECT source, coalesce('merged-' || h, source) AS merged FROM s LEFT JOIN h USING (source)""")
def partition_merge(spark, sf):
    return W.merge_small(W.partition_statistics(table(spark, sf, "documents"), "source", "n_chars"), "source", 150_000)


@query("count_batches", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch FROM documents")
def count_batches(spark, sf):
    return W.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


def _scans(spark, sf):
    """Two scans of the documents: the later lacks some sources' texts, and others have changed."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", F.sha2("text", 256).alias("digest"))
    later = d.where("source <> 'src1'").withColumn("digest", F.when(F.col("source") == "src2", F.sha2(F.upper("text"), 256)).otherwise(F.col("digest")))
    return d.where("source <> 'src3'"), later


@query("incremental_changes", """SELECT doc_id, CASE source WHEN 'src1' THEN 'DELETE' WHEN 'src3' THEN 'ADD' ELSE 'UPDATE' END AS change FROM documents WHERE source IN ('src1', 'src3') OR source = 'src2' AND upper(text) <> text""")
def incremental_changes(spark, sf):
    return W.changes(*_scans(spark, sf), "doc_id", "digest")


@query("incremental_applied", "SELECT source, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY source")
def incremental_applied(spark, sf):
    old, new = _scans(spark, sf)
    return W.apply_changes(old, new, W.changes(old, new, "doc_id", "digest"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("version_diff", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'removed' WHEN c_custkey % 10 = 2 THEN 'added' ELSE 'changed' END AS change, CASE WHEN c_custkey % 10 = 3 THEN ['c_acctbal'] ELSE [] END AS columns FROM customer WHERE c_custkey % 10 IN (1, 2, 3)""")
def version_diff(spark, sf):
    c = table(spark, sf, "customer")
    new = c.where("c_custkey % 10 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return W.version_diff(c.where("c_custkey % 10 <> 2"), new, "c_custkey")


@query("schema_diff", "SELECT * FROM (VALUES ('documents', 'table added', NULL), ('customer', 'table removed', NULL), ('orders', 'column added', 'note'), ('orders', 'column removed', 'o_orderstatus'), ('orders', 'type changed', 'o_custkey')) AS t(\"table\", change, \"column\")")
def schema_diff(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return W.schema_diff(spark, {"orders": o, "customer": c}, {"orders": o.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("note", F.lit("")), "documents": table(spark, sf, "documents")})


@query("retention", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def retention(spark, sf):
    from textloom.operators.relational import keep_newest

    e = table(spark, sf, "events").withColumn("newest", F.struct("ts", "event_id"))
    return keep_newest(e, ["user_id"], "newest", 5).select("user_id", "event_id")


def _tasks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("task"))
    edges = n.withColumn("needs", F.explode(F.array(F.floor(F.col("task") / 2).cast("int"), F.floor(F.col("task") / 3).cast("int")))).where("task > 0").distinct()
    return n, edges


_EDGES = "edges AS (SELECT DISTINCT n_nationkey AS task, unnest([n_nationkey // 2, n_nationkey // 3]) AS needs FROM nation WHERE n_nationkey > 0)"


@query("workflow_levels", f"WITH RECURSIVE {_EDGES}, p(task, level) AS (SELECT 0, 0 UNION ALL SELECT e.task, p.level + 1 FROM p JOIN edges e ON e.needs = p.task) SELECT task, max(level) AS level FROM p GROUP BY task")
def workflow_levels(spark, sf):
    return G.levels(*_tasks(spark, sf))


@query("workflow_reachable", f"WITH RECURSIVE {_EDGES}, p(task, needs) AS (SELECT task, needs FROM edges UNION SELECT p.task, e.needs FROM p JOIN edges e ON e.task = p.needs) SELECT task, needs FROM p")
def workflow_reachable(spark, sf):
    return G.reachable(_tasks(spark, sf)[1])
