"""External stores: JDBC, document and search databases through their Spark packages, web services as a data source."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table or a query. With a partition column it is read in ranges at once; filters and columns are pushed down by Spark."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query:
        return reader.option("query", query).load()
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.option("dbtable", table).load()


def jdbc_batches(spark: SparkSession, url: str, table: str, key: str, size: int, lower: int, upper: int, **options: str) -> Iterator[tuple[int, DataFrame]]:
    """(batch number, rows) by ranges of the key, which unlike offsets stay put while rows come and go."""
    for k, at in enumerate(range(lower, upper + 1, size)):
        yield k, jdbc(spark, url, table, **options).where((F.col(key) >= at) & (F.col(key) < at + size))


def tables(spark: SparkSession, url: str, schema: str = "public", **options: str) -> DataFrame:
    return jdbc(spark, url, query=f"SELECT table_name, table_type FROM information_schema.tables WHERE table_schema = '{schema}'", **options)


def several(readers: Mapping[str, object]) -> dict[str, DataFrame | None]:
    """The DataFrame of each reader; None where its source fails."""
    out: dict[str, DataFrame | None] = {}
    for name, read in readers.items():
        try:
            out[name] = read()
        except Exception:  # whatever a driver raises
            out[name] = None
    return out


def mongo(spark: SparkSession, uri: str, database: str, collection: str, pipeline: list[dict] | None = None) -> DataFrame:
    """A collection, or what an aggregation pipeline makes of it; needs Spark's connector."""
    reader = spark.read.format("mongodb").options(**{"connection.uri": uri, "database": database, "collection": collection})
    if pipeline:
        reader = reader.option("aggregation.pipeline", json.dumps(pipeline))
    df = reader.load()
    return df.withColumn("_id", F.col("_id").cast("string")) if "_id" in df.columns else df


def elasticsearch(spark: SparkSession, nodes: str, index: str, query: dict | None = None) -> DataFrame:
    reader = spark.read.format("org.elasticsearch.spark.sql").option("es.nodes", nodes)
    return (reader.option("es.query", json.dumps({"query": query})) if query else reader).load(index)


def fetch(url: str, retries: int = 3, timeout: float = 30.0, wait: float = 1.0, headers: Mapping[str, str] | None = None, body: dict | None = None) -> bytes:
    """A response's body, tried again with growing waits."""
    for k in range(retries + 1):
        try:
            data = None if body is None else json.dumps(body).encode()
            with urllib.request.urlopen(urllib.request.Request(url, data, dict(headers or {})), timeout=timeout) as r:  # noqa: S310
                return r.read()
        except OSError:
            if k == retries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


class PagedJson(DataSource):
    """format("paged_json"): url with {page}, pages, items (the key of the list): a partition a page, a row (page, value as JSON) an item."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        got = json.loads(fetch(self.options["url"].replace("{page}", str(partition.value)), timeout=float(self.options.get("timeout", "30"))))
        for item in got if isinstance(got, list) else got.get(self.options.get("items", "items"), []):
            yield partition.value, json.dumps(item)


def record_text(value):
    """A column expression: the first filled of content, text, body and description of a JSON record, else the whole record."""
    found = [F.get_json_object(value, f"$.{k}") for k in ("content", "text", "body", "description")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), value)


def feed(xml: bytes, since: str = "") -> list[tuple[str, str, str, str]]:
    """(id, title, published, text) of an RSS or Atom feed's entries later than since, as the feed writes its times."""
    from xml.etree import ElementTree

    def of(e, *names: str) -> str:
        return next(((x.text or "").strip() for n in names for x in e if x.tag.rpartition("}")[2] == n), "")

    entries = [e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] in ("item", "entry")]
    rows = [(of(e, "guid", "id", "link"), of(e, "title"), of(e, "pubDate", "published", "updated"), of(e, "encoded", "content", "description", "summary")) for e in entries]
    return [r for r in rows if r[2] > since]
