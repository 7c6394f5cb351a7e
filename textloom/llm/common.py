"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.operators.lineage import cut, spread  # noqa: F401
from textloom.operators.lineage import shared_folder as shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one of texts is dealt out over the cores while it is small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def out_schema(docs: DataFrame, id_col: str, schema: str) -> StructType:
    """The id, of docs' own type, and the columns of schema."""
    out = StructType().add("id", docs.schema[id_col].dataType)
    for field in StructType.fromDDL(schema).fields:
        out.add(field)
    return out


def per_document(docs: DataFrame, id_col: str, text_col: str, schema: str, f: Callable[[Iterator], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run f over (id, text) batches in Arrow; only these two columns are read, whatever else docs holds.

    schema begins with the id, whose type is docs' own, so it lists only the columns after it.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(f, out_schema(docs, id_col, schema)).withColumnRenamed("id", id_col)


def pieces(batch: pa.RecordBatch, max_chars: int = 2_000_000) -> Iterator[tuple[pa.Array, list]]:
    """Cut a batch into (ids, texts) of about max_chars, so that memory follows max_chars and the longest text, not the batch."""
    ids, texts = batch.column(0), batch.column(1)
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_chars:
            yield ids.slice(start, i - start), texts.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield ids.slice(start), texts.slice(start).to_pylist()
