"""The warehouse: partitions, versions, incremental updates, snapshots and backups as tables and set algebra."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.lineage import cut

# Partition keys


def hash_bucket(key: Column, buckets: int = 16) -> Column:
    """The key's MD5, as a number of 128 bits, modulo buckets; folded in 32-bit digits, as no column type holds it."""
    out = F.lit(0).cast("long")
    for i in range(4):
        digit = F.conv(F.substring(F.md5(key.cast("string")), 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * (2**32 % buckets) + digit) % buckets
    return out


def date_bucket(ts: Column, unit: str) -> Column:
    """day, week (calendar year and ISO week), month or year."""
    if unit == "week":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def quality_band(score: Column, bounds: Sequence[float] = (0.3, 0.6, 0.8)) -> Column:
    """Half-open bands; the highest score is in the last."""
    low, mid, high = bounds
    return F.when(score < low, "low").when(score < mid, "medium").when(score < high, "high").otherwise("excellent")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _place, each row's place from 0 within by, in order; equal rows in any order.

    The rows are ranged over the tasks and counted, and each range adds up those before it, so no group lies in one task.
    """
    spread = cut(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_p", F.spark_partition_id()))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = spread.groupBy(*by, "_p").agg(F.count("*").alias("_n"))  # a row a group and range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)) - 1 + F.col("_before")
    return spread.join(before, [*by, "_p"]).withColumn("_place", place).drop("_p", "_before")


def batches(docs: DataFrame, order: str, n: int) -> DataFrame:
    """docs with the column batch: rows i * n to (i + 1) * n in order."""
    return ranked(docs, [], [order]).withColumn("batch", F.floor(F.col("_place") / n).cast("long")).drop("_place")


def _next(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each document, and where the part that begins with it ends: it has one document at least, and is only closed once it holds something."""
    n, sums = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + most, side="right") - 1, np.arange(1, n + 1))
    return sums, np.where((sums[ends] == sums[:-1]) & (ends < n), ends + 1, ends)


def fill(docs: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, order, part): in order, a part is closed when the next document would take it beyond most.

    A part begins where the one before ends, a chain through the whole group, yet no group lies in one task: the rows are
    ranged over the tasks, and each range says, for every document of its first most bytes, how many parts follow if one begins
    there and what the last holds. These few rows a range are folded in order, and then each range deals out its parts.
    """
    ranged = cut(docs.select(by, order, size).repartitionByRange(by, order).withColumn("_p", F.spark_partition_id()))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (by, order)}

    def offers(rows: pd.DataFrame) -> pd.DataFrame:
        sums, ends = _next(rows.sort_values(order)[size].to_numpy(np.int64), most)
        n = len(ends)
        parts, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = int(ends[i])
            parts[i], held[i] = (0, sums[n] - sums[i]) if j >= n else (1 + parts[j], held[j])
        few = min(n, int(np.searchsorted(sums[1:], most, side="right")) + 1)
        return pd.DataFrame({by: [rows[by].iloc[0]], "_p": [int(rows["_p"].iloc[0])], "sums": [sums[1 : few + 1].tolist()], "parts": [parts[:few].tolist()], "held": [held[:few].tolist()], "n": [n], "total": [int(sums[n])]})

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        part, held, out = 0, 0, []
        for r in rows.sort_values("_p").itertuples(index=False):
            out.append((r[0], int(r[1]), part, held))
            at = 0 if not held else int(np.searchsorted(np.asarray(r.sums), most - held, side="right"))
            if at >= r.n:
                held += r.total
            else:
                part, held = part + bool(held) + int(r.parts[at]), int(r.held[at])
        return pd.DataFrame(out, columns=[by, "_p", "_part", "_held"])

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        sums, ends = _next(rows[size].to_numpy(np.int64), most)
        part, held, n = int(rows["_part"].iloc[0]), int(rows["_held"].iloc[0]), len(ends)
        at = 0 if not held else int(np.searchsorted(sums[1:], most - held, side="right"))
        out = np.full(n, part, np.int64)
        part += bool(held)
        while at < n:
            out[at : ends[at]] = part
            at, part = int(ends[at]), part + 1
        return rows[[by, order]].assign(part=out)

    first = ranged.groupBy(by, "_p").applyInPandas(offers, f"{by} {kinds[by]}, _p int, sums array<long>, parts array<long>, held array<long>, n long, total long")
    starts = first.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, _p int, _part long, _held long")  # a row a group and range
    return ranged.join(starts, [by, "_p"]).groupBy(by, "_p").applyInPandas(deal, f"{by} {kinds[by]}, {order} {kinds[order]}, part long")


def partition_statistics(df: DataFrame, key: str, size: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("docs"), F.sum(size).alias("bytes"), F.round(F.avg(size), 6).alias("mean"))


def merge_small(statistics: DataFrame, key: str, least: int) -> DataFrame:
    """(key, merged): partitions under least bytes are merged, smallest first, until each heap has least bytes."""
    small = statistics.where(F.col("bytes") < least)
    w = Window.partitionBy(F.lit(0)).orderBy("bytes", key).rowsBetween(Window.unboundedPreceding, 0)  # a row a partition of the catalog
    heap = small.select(F.col(key).alias("_k"), F.floor((F.sum("bytes").over(w) - F.col("bytes")) / least).alias("_h"))
    return statistics.join(heap, statistics[key] == heap["_k"], "left").select(key, F.coalesce(F.concat(F.lit("merged-"), F.col("_h").cast("string")), F.col(key).cast("string")).alias("merged"))


def write_partitions(df: DataFrame, path: str, key: str, tasks: int = 8) -> None:
    """A folder a key value, each written by up to so many tasks, whatever the skew."""
    salt = F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(tasks))
    df.repartition(F.col(key), salt).write.partitionBy(key).parquet(path)


# Changes


def changes(tracked: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): ADD, UPDATE and DELETE between two scans, by one full outer join of keys and digests."""
    a = tracked.select(F.col(key).alias("ka"), F.col(digest).alias("da"))
    b = current.select(F.col(key).alias("kb"), F.col(digest).alias("db"))
    kind = F.when(F.col("ka").isNull(), "ADD").when(F.col("kb").isNull(), "DELETE").when(~F.col("da").eqNullSafe(F.col("db")), "UPDATE")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), kind.alias("change")).where("change IS NOT NULL")


def update_mode(found: DataFrame, total: int, most: float = 0.5) -> str:
    """FULL where updates and deletions exceed the share most of all, else INCREMENTAL."""
    n = found.where("change IN ('UPDATE', 'DELETE')").count()
    return "FULL" if total and n / total > most else "INCREMENTAL"


def apply_changes(base: DataFrame, current: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """base after the changes: rows that go or change leave, those that come or changed are taken from current."""
    out = base.join(found.where("change <> 'ADD'").select(key), key, "left_anti")
    return out.unionByName(current.join(found.where("change <> 'DELETE'").select(key), key, "left_semi"))


def version_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, columns): rows added, removed, or changed with the names of the columns that differ."""
    columns = [c for c in old.columns if c != key and c in new.columns]
    a, b = (df.select(F.col(key).alias(f"k{x}"), F.struct(*columns).alias(x)) for df, x in ((old, "a"), (new, "b")))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    kind = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").otherwise("changed")
    both = a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), kind.alias("change"), F.when(kind == "changed", differ).otherwise(F.array().cast("array<string>")).alias("columns"))
    return both.where("change <> 'changed' OR size(columns) > 0")


def schema_diff(spark: SparkSession, old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """(table, change, column): tables added and removed, columns added, removed and of another type."""
    rows = [(t, "table added", None) for t in sorted(new.keys() - old.keys())] + [(t, "table removed", None) for t in sorted(old.keys() - new.keys())]
    for t in sorted(old.keys() & new.keys()):
        a, b = dict(old[t].dtypes), dict(new[t].dtypes)
        rows += [(t, "column added", c) for c in sorted(b.keys() - a.keys())] + [(t, "column removed", c) for c in sorted(a.keys() - b.keys())]
        rows += [(t, "type changed", c) for c in sorted(a.keys() & b.keys()) if a[c] != b[c]]
    return spark.createDataFrame(rows, "table string, change string, column string")


# Versions and backups in a folder


def checksum(df: DataFrame) -> str:
    """SHA-256 over order-independent sums of the rows' hashes, computed in the executors."""
    from hashlib import sha256

    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    digits = [F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    got = df.agg(F.count("*"), *digits).first()
    return sha256("|".join(map(str, got)).encode()).hexdigest()


def create_version(df: DataFrame, folder: str, version: str, parent: str | None = None, tags: Sequence[str] = ()) -> None:
    """Write a snapshot, then its row in the catalog of versions; a version that broke off before has no row."""
    spark = df.sparkSession
    df.write.parquet(f"{folder}/data/{version}")
    written = spark.read.parquet(f"{folder}/data/{version}")
    row = spark.createDataFrame([(version, parent, list(tags), written.count(), checksum(written))], "version string, parent string, tags array<string>, rows long, checksum string")
    row.withColumn("created", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/versions")


def load_version(spark: SparkSession, folder: str, version: str, verify: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{folder}/data/{version}")
    if verify and versions(spark, folder).where(F.col("version") == version).first()["checksum"] != checksum(df):
        raise ValueError(f"version {version} isn't what was written")
    return df


def rollback(spark: SparkSession, folder: str, version: str, to: str) -> None:
    """A new version with an older one's rows: the data are restored, not only the record."""
    create_version(load_version(spark, folder, version, verify=True), folder, to, parent=version, tags=["rollback"])


def backup_increment(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """now's new and changed rows, and the keys that went, as (change, row's columns)."""
    hashed = [df.select(key, F.xxhash64(*[c for c in df.columns if c != key]).alias("h")) for df in (base, now)]
    found = changes(hashed[0], hashed[1], key, "h")
    return found.join(now, key, "left")


def restore_increment(base: DataFrame, increment: DataFrame, key: str) -> DataFrame:
    kept = base.join(increment.select(key), key, "left_anti")
    return kept.unionByName(increment.where("change <> 'DELETE'").select(*base.columns))


def process_changes(found: DataFrame, current: DataFrame, key: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f over the rows that came or changed."""
    return f(current.join(found.where("change <> 'DELETE'").select(key), key, "left_semi"))


#: The tables of a document warehouse: name -> columns.
STAR = {
    "documents": "id string, source_path string, content string, file_type string, size_bytes long, language string, domain string, quality_score double, author string, created_at timestamp",
    "document_entities": "document_id string, entity_text string, label string, confidence double",
    "datasets": "id string, name string, version string, documents long, created_at timestamp",
    "dataset_documents": "dataset_id string, document_id string, split string",
    "processing_logs": "document_id string, stage string, status string, message string, created_at timestamp",
}


def star(docs: DataFrame, dataset: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> dict[str, DataFrame]:
    """The warehouse's tables of a corpus but the logs: facts a document and entity, the dataset and its members with their split. No join: each is a projection of the documents."""
    from textloom.functions import annotate, quality
    from textloom.operators.segments import split

    key, text = F.col(id_col).cast("string"), F.col(text_col)
    documents = docs.select(key.alias("id"), F.col(source_col).alias("source_path"), text.alias("content"), F.lit("text").alias("file_type"), F.octet_length(text).cast("long").alias("size_bytes"), F.col(lang_col).alias("language"), annotate.domain(text)["domain"].alias("domain"), quality.length_score(text).alias("quality_score"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("created_at"))
    entities = docs.select(key.alias("document_id"), F.explode(annotate.entities(text, most=2**31 - 1)).alias("e")).select("document_id", F.col("e.text").alias("entity_text"), "e.label", "e.confidence")
    sets = docs.agg(F.count("*").alias("documents")).select(F.lit(dataset).alias("id"), F.lit(dataset).alias("name"), F.lit("1").alias("version"), "documents", F.lit(None).cast("timestamp").alias("created_at"))
    members = docs.select(F.lit(dataset).alias("dataset_id"), key.alias("document_id"), split(F.col(id_col)).alias("split"))
    return {"documents": documents, "document_entities": entities, "datasets": sets, "dataset_documents": members}


def track(spark: SparkSession, folder: str, kind: str, **values: object) -> None:
    """Add a row to the registry of trainings, models or versions in a folder, as one JSON line with its time; readers see whole files only."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").select(F.lit(kind).alias("kind"), "value", F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{folder}/registry")


def tracked(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema("kind string, value string, at timestamp").json(f"{folder}/registry").where(F.col("kind") == kind)
