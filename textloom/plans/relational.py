"""Queries of the relational surface over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import relational as R
from textloom.plans.registry import query, table


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_discount) AS avg_discount, count(*) AS n_lines
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf):
    aggregations = [{"function": "SUM", "column": "l_quantity", "alias": "sum_qty"}, {"function": "COUNT", "alias": "n_lines"}, {"function": "AVG", "column": "l_discount", "alias": "avg_discount"}, {"function": "SUM", "column": "l_extendedprice * (1 - l_discount)", "alias": "revenue"}]
    return R.aggregate(table(spark, sf, "lineitem"), aggregations, ["l_returnflag", "l_linestatus"], where="l_shipdate <= TIMESTAMP '1998-09-02'").withColumn("revenue", F.round("revenue", 2))


@query("select_filter", "SELECT o_orderkey, o_totalprice, upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def select_filter(spark, sf):
    return R.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "upper(o_orderpriority) AS priority"], where="o_totalprice > 100000 AND o_orderstatus = 'O'")


@query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, sf):
    return R.select(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], distinct=True)


@query("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def order_limit_offset(spark, sf):
    return R.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], order_by=["o_totalprice DESC", "o_orderkey"], limit=100, offset=50)


@query("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    joins = [{"table": "customer", "join_type": "INNER", "on_condition": "o_custkey = c_custkey", "alias": "c"}, {"table": "nation", "on_condition": "c.c_nationkey = n_nationkey"}]
    return R.join(t, "orders", joins, ["o_orderkey", "c_name", "n_name"])


def _outer(kind: str):
    sql = f"SELECT c_custkey, o_orderkey FROM customer {kind} JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey AND c_acctbal > 0"

    @query(f"join_{kind.split()[0].lower()}", sql)
    def outer(spark, sf):
        t = {"customer": table(spark, sf, "customer"), "o": table(spark, sf, "orders").where("o_totalprice > 200000")}
        return R.join(t, "customer", [{"table": "o", "join_type": kind, "on_condition": "c_custkey = o_custkey AND c_acctbal > 0"}], ["c_custkey", "o_orderkey"])

    return outer


for _kind in ("LEFT", "RIGHT", "FULL OUTER"):
    _outer(_kind)


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, sf):
    t = {"customer": table(spark, sf, "customer"), "f": table(spark, sf, "orders").where("o_orderstatus = 'F'")}
    return R.join(t, "customer", [{"table": "f", "join_type": "SEMI", "on_condition": "c_custkey = o_custkey"}], ["c_custkey", "c_name"])


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "orders")}
    return R.join(t, "customer", [{"table": "orders", "join_type": "ANTI", "on_condition": "c_custkey = o_custkey"}], ["c_custkey", "c_name"])


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return R.join({n: table(spark, sf, n) for n in ("nation", "region")}, "nation", [{"table": "region", "join_type": "CROSS"}], ["n_name", "r_name"])


@query("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000")
def join_theta(spark, sf):
    t = {n: table(spark, sf, n) for n in ("supplier", "nation")}
    return R.join(t, "supplier", [{"table": "nation", "on_condition": "s_nationkey < n_nationkey AND s_acctbal > 5000"}], ["s_suppkey", "n_nationkey"])


@query("join_range", """WITH bands AS (SELECT * FROM (VALUES ('low', 0, 50000), ('mid', 50000, 150000), ('high', 150000, 1000000)) t(band, lo, hi))
    SELECT band, count(*) AS n FROM orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band""")
def join_range(spark, sf):
    bands = spark.createDataFrame([("low", 0, 50000), ("mid", 50000, 150000), ("high", 150000, 1000000)], "band string, lo int, hi int")
    joined = table(spark, sf, "orders").join(F.broadcast(bands), F.expr("o_totalprice >= lo AND o_totalprice < hi"))  # three rows
    return joined.groupBy("band").agg(F.count("*").alias("n"))


@query("join_as_of", """SELECT p.event_id, p.user_id, c.event_id AS last_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_as_of(spark, sf):
    e = table(spark, sf, "events")
    out = R.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", ["event_id"])
    return out.select("event_id", "user_id", "last_event_id")


@query("summary_fan_out", """SELECT c_custkey, count(o_orderkey) AS n_orders, count(l_linenumber) AS n_lines, count(DISTINCT o_orderkey) AS distinct_orders
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey""")
def summary_fan_out(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    joined = R.join(t, "customer", [{"table": "orders", "join_type": "LEFT", "on_condition": "c_custkey = o_custkey"}, {"table": "lineitem", "join_type": "LEFT", "on_condition": "o_orderkey = l_orderkey"}])
    return R.aggregate(joined, [{"function": "count", "column": "o_orderkey", "alias": "n_orders"}, {"function": "count", "column": "l_linenumber", "alias": "n_lines"}, {"function": "count", "column": "o_orderkey", "distinct": True, "alias": "distinct_orders"}], ["c_custkey"])


@query("agg_having", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def agg_having(spark, sf):
    total = [{"function": f, "column": "o_totalprice", "alias": a} for f, a in (("SUM", "total"), ("AVG", "mean"), ("MIN", "least"), ("MAX", "most"))]
    return R.aggregate(table(spark, sf, "orders"), [{"function": "COUNT", "alias": "n"}, *total], ["o_custkey"], having="n > 10")


@query("agg_count_distinct", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def agg_count_distinct(spark, sf):
    return R.aggregate(table(spark, sf, "orders"), [{"function": "count", "alias": "n"}, {"function": "count", "column": "o_custkey", "distinct": True, "alias": "customers"}, {"function": "count", "column": "o_orderstatus", "distinct": True, "alias": "statuses"}])


@query("agg_any_function", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS spread, round(var_pop(p_retailprice), 3) AS variance, median(p_size) AS middle, count(*) FILTER (WHERE p_size > 25) AS large FROM part GROUP BY p_brand")
def agg_any_function(spark, sf):
    specs = [{"function": "stddev_samp", "column": "p_retailprice", "alias": "spread"}, {"function": "var_pop", "column": "p_retailprice", "alias": "variance"}, {"function": "median", "column": "p_size", "alias": "middle"}, {"function": "count", "where": "p_size > 25", "alias": "large"}]
    return R.aggregate(table(spark, sf, "part"), specs, ["p_brand"]).withColumns({"spread": F.round("spread", 4), "variance": F.round("variance", 3)})


@query("agg_status_distribution", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY o_orderstatus")
def agg_status_distribution(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))  # a row a status


def _grouping(kind: str, sql: str):
    @query(f"agg_{kind}", f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY {sql}")
    def grouping(spark, sf):
        return R.aggregate(table(spark, sf, "lineitem"), [{"function": "count", "alias": "n"}, {"function": "sum", "column": "l_quantity", "alias": "qty"}], ["l_returnflag", "l_linestatus"], grouping=kind)


_grouping("rollup", "ROLLUP (l_returnflag, l_linestatus)")
_grouping("cube", "CUBE (l_returnflag, l_linestatus)")


@query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    return table(spark, sf, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg_approximate")
def agg_approximate(spark, sf):
    """HyperLogLog++ and Greenwald-Khanna sketches: partial states merge, so distinct counts and quantiles need no shuffle of values."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 10000).alias("prices"))


@query("agg_approximate_bounds", "SELECT l_returnflag, true AS parts, true AS prices FROM lineitem GROUP BY l_returnflag")
def agg_approximate_bounds(spark, sf):
    """Whether the sketches lie within three standard errors of the exact counts and quantiles.

    An estimate's place among the values is counted, and the values next to it are all that the exact quantiles are needed for, so no task gathers a flag's values.
    """
    lines, keys = table(spark, sf, "lineitem"), ["l_returnflag", "parts", "prices"]
    price = F.col("l_extendedprice")
    counts = [F.count(price).alias("n")]
    for k in range(3):
        x = F.col("prices")[k]
        counts += [F.count_if(price < x).alias(f"below{k}"), F.count_if(price <= x).alias(f"upto{k}")]
        counts += [F.max(F.when(price < x, price)).alias(f"under{k}"), F.max(F.when(price <= x, price)).alias(f"until{k}"), F.min(F.when(price > x, price)).alias(f"over{k}"), F.min(F.when(price >= x, price)).alias(f"from{k}")]
    sketches = F.broadcast(agg_approximate(spark, sf).withColumnRenamed("l_returnflag", "flag"))  # a row a flag
    placed = lines.join(sketches, F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy(*keys).agg(*counts)
    exact = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_partkey").alias("kinds"))
    both = placed.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    near = F.abs(F.col("parts") - F.col("kinds")) <= 0.06 * F.col("kinds")
    inside = F.lit(True)
    for k, (lo, hi) in enumerate(((0.09, 0.11), (0.49, 0.51), (0.89, 0.91))):
        x = F.col("prices")[k]
        for share, before, left, right, holds in ((lo, F.col(f"upto{k}"), f"until{k}", f"over{k}", lambda x, q: x >= q), (hi, F.col(f"below{k}"), f"under{k}", f"from{k}", lambda x, q: x <= q)):
            at = (F.col("n") - 1) * F.lit(share)
            i, h = F.floor(at), F.ceil(at)  # the quantile lies between the values of these places
            between = (h - at) * F.col(left) + (at - i) * F.col(right)
            inside = inside & F.when(before > h, F.lit(share == lo)).when(before <= i, F.lit(share == hi)).otherwise(holds(x, between))
    return both.select("l_returnflag", near.alias("parts"), inside.alias("prices"))


@query("window_rank", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
    rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders""")
def window_rank(spark, sf):
    key = ["o_custkey"]
    specs = [{"function": "ROW_NUMBER", "partition_by": key, "order_by": ["o_totalprice DESC", "o_orderkey"], "alias": "rn"}, {"function": "RANK", "partition_by": key, "order_by": ["o_orderpriority"], "alias": "rk"}, {"function": "DENSE_RANK", "partition_by": key, "order_by": ["o_orderpriority"], "alias": "dr"}]
    return R.window(table(spark, sf, "orders"), specs, ["o_orderkey"]).withColumns({c: F.col(c).cast("long") for c in ("rn", "rk", "dr")})


@query("window_lag_lead", """SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after,
    ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events""")
def window_lag_lead(spark, sf):
    over = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    specs = [{"function": "lag", "arguments": ["value", 1], "alias": "before"}, {"function": "lead", "arguments": ["event_type", 1, "'none'"], "alias": "after"}, {"function": "ntile", "arguments": [4], "alias": "quarter"}]
    return R.window(table(spark, sf, "events"), [s | over for s in specs], ["event_id"]).withColumn("quarter", F.col("quarter").cast("long"))


@query("window_frame", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events""")
def window_frame(spark, sf):
    over = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    specs = [{"function": "sum", "arguments": ["value"], "frame": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "alias": "running"}, {"function": "avg", "arguments": ["value"], "frame": "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW", "alias": "smooth"}]
    out = R.window(table(spark, sf, "events"), [s | over for s in specs], ["event_id"])
    return out.select("event_id", F.round("running", 4).alias("running"), F.round("smooth", 6).alias("smooth"))


@query("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark, sf):
    newest = table(spark, sf, "orders").withColumn("newest", F.struct("o_orderdate", "o_orderkey"))
    return R.keep_newest(newest, ["o_custkey"], "newest", 3).select("o_custkey", "o_orderkey")


@query("sessions", """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, session::BIGINT AS session, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), F.lit(False))
    marked = table(spark, sf, "events").withColumn("fresh", F.when(gap, 0).otherwise(1))
    marked = marked.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.count("*").alias("n"))


@query("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT n_name, count(*) AS n FROM top JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def cte(spark, sf):
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    ctes = [{"name": "big", "query": "SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey"}, {"name": "top", "query": "SELECT * FROM big WHERE total > 500000"}]
    return R.cte(spark, t, ctes, "SELECT n_name, count(*) AS n FROM top JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")


@query("cte_recursive", """WITH RECURSIVE reach(src, dst, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL
    SELECT src, n_nationkey, hops + 1 FROM reach JOIN nation ON n_nationkey = dst + 1 AND hops < 10) SELECT dst, max(hops) AS hops FROM reach GROUP BY dst""")
def cte_recursive(spark, sf):
    step = "SELECT n_nationkey AS src, n_nationkey AS dst, 0 AS hops FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT src, n_nationkey, hops + 1 FROM reach JOIN {nation} ON n_nationkey = dst + 1 AND hops < 10"
    return R.cte(spark, {"nation": table(spark, sf, "nation")}, [{"name": "reach", "query": step, "recursive": True}], "SELECT dst, max(hops) AS hops FROM reach GROUP BY dst")


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_union_all", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def set_union_all(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_name AS name", "c_acctbal AS balance").union(table(spark, sf, "supplier").select("s_name", "s_acctbal"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_nationkey AS k").intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS k").exceptAll(table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey").distinct())


@query("pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("json_props", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY event_type")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k.cast("long")).alias("k"), F.countDistinct(k).alias("kinds"))
