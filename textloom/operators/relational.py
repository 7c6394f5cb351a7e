"""The relational surface: declarative specifications turned into DataFrame plans, which Catalyst optimises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "FULL OUTER": "full", "CROSS": "cross", "SEMI": "left_semi", "LEFT SEMI": "left_semi", "ANTI": "left_anti", "LEFT ANTI": "left_anti"}


def select(df: DataFrame, columns: Sequence[str] = ("*",), *, distinct: bool = False, where: str | None = None, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """SELECT [DISTINCT] columns WHERE ... ORDER BY ... LIMIT ... OFFSET; columns are SQL expressions, offset works without a limit too."""
    out = df.where(where) if where else df
    out = out.selectExpr(*columns)
    if distinct:
        out = out.distinct()
    return page(out, order_by, limit, offset)


def page(df: DataFrame, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY ("col", "col DESC", ...), then OFFSET, then LIMIT."""
    if order_by:
        df = df.orderBy(*(order_key(k) for k in order_by))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def order_key(text: str) -> Column:
    name, _, way = text.strip().rpartition(" ")
    if name and way.upper() in ("ASC", "DESC"):
        return F.expr(name).desc() if way.upper() == "DESC" else F.expr(name).asc()
    return F.expr(text)


def call(spec: Mapping[str, Any]) -> Column:
    """Aggregate of a {function, column, alias, distinct, where} specification; any SQL aggregate's name will do."""
    function, column = str(spec["function"]).lower(), str(spec.get("column", "*"))
    inner = f"DISTINCT {column}" if spec.get("distinct") else column
    keep = f" FILTER (WHERE {spec['where']})" if spec.get("where") else ""
    return F.expr(f"{function}({inner}){keep}").alias(spec.get("alias") or (f"{function}_{column}" if column != "*" else function))


def aggregate(df: DataFrame, aggregations: Sequence[Mapping[str, Any]], group_by: Sequence[str] = (), *, where: str | None = None, having: str | None = None, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0, grouping: str = "group") -> DataFrame:
    """Grouped aggregates with HAVING over their aliases. grouping: group, cube or rollup."""
    out = df.where(where) if where else df
    keys = [F.expr(k) for k in group_by]
    grouped = {"group": out.groupBy, "cube": out.cube, "rollup": out.rollup}[grouping](*keys)
    out = grouped.agg(*(call(a) for a in aggregations))
    return page(out.where(having) if having else out, order_by, limit, offset)


def join(tables: Mapping[str, DataFrame], base: str, joins: Sequence[Mapping[str, Any]], columns: Sequence[str] = ("*",), *, base_alias: str | None = None, where: str | None = None, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """N-way join of {table, join_type, on_condition, alias} specifications. Conditions are SQL text, so theta and range joins pass; Catalyst picks the strategy."""
    out = tables[base].alias(base_alias or base)
    for spec in joins:
        right = tables[spec["table"]].alias(spec.get("alias") or spec["table"])
        kind = JOINS[str(spec.get("join_type", "INNER")).upper().removesuffix(" JOIN")]
        out = out.crossJoin(right) if kind == "cross" else out.join(right, F.expr(spec["on_condition"]), kind)
    out = out.where(where) if where else out
    return page(out.selectExpr(*columns), order_by, limit, offset)


def window(df: DataFrame, functions: Sequence[Mapping[str, Any]], columns: Sequence[str] = ("*",), *, where: str | None = None) -> DataFrame:
    """Add FUNC(arguments) OVER (PARTITION BY ... ORDER BY ... [frame]) columns of {function, arguments, partition_by, order_by, frame, alias}."""
    out = df.where(where) if where else df
    calls = []
    for spec in functions:
        over = [f"PARTITION BY {', '.join(spec['partition_by'])}" if spec.get("partition_by") else "", f"ORDER BY {', '.join(spec['order_by'])}" if spec.get("order_by") else "", spec.get("frame", "")]
        text = f"{spec['function']}({', '.join(map(str, spec.get('arguments', ())))}) OVER ({' '.join(x for x in over if x)})"
        calls.append(f"{text} AS {spec.get('alias') or str(spec['function']).lower()}")
    return out.selectExpr(*columns, *calls)


def cte(spark: SparkSession, tables: Mapping[str, DataFrame], ctes: Sequence[Mapping[str, Any]], main: str) -> DataFrame:
    """WITH [RECURSIVE] name AS (query), ... main, over the tables given. The views have names of their own, so none of the session's is replaced."""
    from uuid import uuid4

    text = ("WITH RECURSIVE " if any(c.get("recursive") for c in ctes) else "WITH ") + ", ".join(f"{c['name']} AS ({c['query']})" for c in ctes) + f" {main}" if ctes else main
    names = {name: f"v{uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
        text = text.replace(f"{{{name}}}", names[name])
    try:
        return spark.sql(text)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the last row of right at or before each row's time, within by; equal times take the greatest columns.

    One sort of both sides together, by one shuffle on by, rather than a range join.
    """
    width = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    body = F.struct(*(left[c] for c in left.columns))
    a = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), body.alias("_row"), F.struct(*width).alias("_seen")).withColumn("_seen", F.when(F.lit(False), F.col("_seen")))
    b = right.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*(F.col(c) for c in columns)).alias("_seen"))
    over = Window.partitionBy("_by").orderBy("_at", "_side", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_seen", ignorenulls=True).over(over)).where("_side = 1")
    return both.select("_row.*", *(F.col(f"_last.{c}").alias(f"last_{c}") for c in columns))


def keep_newest(df: DataFrame, by: Sequence[str], newest: str, n: int) -> DataFrame:
    """The n newest rows of each group (retention)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(newest).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
