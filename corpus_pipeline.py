"""The corpus pipeline: from documents to tokens in five stages, each written as Parquet before the next one reads it.

Every stage takes all rows that its predecessor kept, whole texts included. Rows with a null id, a null or empty text, equal
ids or equal rows, and columns that bear names the operators use inside, pass through each of them as its docstring says; an
empty table stays empty.
"""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontamination, secret_scan, simhash_dedup, toxicity
from textloom.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted to the labelled documents, doesn't reject.

    Each row is judged by its own text: equal rows share their fate, a null or empty text stays.
    """
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id, and all that are in none.

    Of rows that share an id one stays: that whose text, then whole row, hashes lowest. Rows with a null id stay, as do those
    whose text is null or has no word, unless they share an id with one that goes.
    """
    return simhash_dedup.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the test items' passages; one that holds nothing else goes, whatever its id. A null or empty text stays as it is, and equal rows are cut alike."""
    return with_length(decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each confirmed secret replaced by its kind, and opaque values assigned to a secret's name masked as unconfirmed. A null or empty text stays as it is, and equal rows are masked alike."""
    return with_length(secret_scan.redact_secrets(docs, unconfirmed=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) of all documents, in equal rows for equal ones. A null text has tokens null, an empty one has none."""
    return bpe.encode_documents(docs)


def with_length(docs: DataFrame) -> DataFrame:
    """docs with the texts' length as it is now, if there is a column for it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Models and automata have no SQL; tests/llm compares run() with the stages in plain Python.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its table in the shared folder.

    A stage's table is deleted once the next one is written, and the last one, to which the result refers, when the driver
    ends with its session still open.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"

    @atexit.register
    def leave() -> None:
        if spark._jsc.sc().isStopped() is False:
            delete(spark, at)

    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
