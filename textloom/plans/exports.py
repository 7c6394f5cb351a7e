"""Queries of training formats, segments and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import segments as S
from textloom.plans.registry import query, table
from textloom.plans.text import RAW_SQL
from textloom.sources import formats as X

_TURNS = "SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id"


def _conversations(spark, sf):
    return X.conversations(table(spark, sf, "conversations"))


@query("format_chat", f"SELECT conv_id, array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>'), chr(10)) AS line FROM ({_TURNS})")
def format_chat(spark, sf):
    return _conversations(spark, sf).select("conv_id", X.chat_markup(F.col("turns")).alias("line"))


@query("format_instruction", f"""SELECT conv_id, CASE WHEN u <> '' AND a IS NOT NULL THEN u ELSE '' END AS instruction, CASE WHEN u <> '' AND a IS NOT NULL THEN a ELSE '' END AS output FROM (SELECT conv_id,
    array_to_string(list_transform(list_filter(turns, lambda t: t.role = 'user'), lambda t: t.text), chr(10)) AS u, list_filter(turns, lambda t: t.role = 'assistant')[1].text AS a FROM ({_TURNS}))""")
def format_instruction(spark, sf):
    return _conversations(spark, sf).select("conv_id", X.instruction_of(F.col("turns")).alias("i")).select("conv_id", "i.*")


@query("format_messages", f"SELECT conv_id, to_json({{'messages': list_transform(turns, lambda t: {{'role': t.role, 'content': t.text}})}})::VARCHAR AS line FROM ({_TURNS})")
def format_messages(spark, sf):
    return _conversations(spark, sf).select("conv_id", X.messages(F.col("turns")).alias("line"))


@query("format_validation", f"SELECT count(*) AS n, count(*) AS valid, 1.0::DOUBLE AS rate FROM ({_TURNS})")
def format_validation(spark, sf):
    c = _conversations(spark, sf).select(X.chat_markup(F.col("turns")).alias("line"))
    return X.convert(c, F.col("line"), X.valid_markup(F.col("value")))[1]


@query("export_manifest", f"SELECT count(*) AS documents, sum(len({RAW_SQL}))::BIGINT AS words, sum(length(text))::BIGINT AS chars, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources FROM documents")
def export_manifest(spark, sf):
    return X.manifest(table(spark, sf, "documents"))


@query("split_counts", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT ('0x' || substr(md5('split' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)) GROUP BY split")
def split_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(S.split(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))


@query("segment_sentences")
def segment_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("k", "sentence"))


@query("segment_chunks")
def segment_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(S.chunks(F.col("text"))).alias("k", "chunk"))


@query("segment_token_chunks")
def segment_token_chunks(spark, sf):
    return S.token_chunks(table(spark, sf, "documents"))


@query("segment_training")
def segment_training(spark, sf):
    return S.training_segments(table(spark, sf, "documents"))


@query("segment_languages")
def segment_languages(spark, sf):
    from textloom.functions.annotate import language

    return table(spark, sf, "documents").select("doc_id", F.posexplode(S.language_segments(F.col("text"), language)).alias("k", "s")).select("doc_id", "k", "s.language", "s.confidence")


@query("segment_statistics")
def segment_statistics(spark, sf):
    s = segment_training(spark, sf)
    mean = lambda c: F.round(F.avg(F.when(F.length(c) > 0, F.length(c))), 6)
    return s.groupBy("kind").agg(F.count("*").alias("n"), mean("instruction").alias("instruction"), mean("output").alias("output"))
