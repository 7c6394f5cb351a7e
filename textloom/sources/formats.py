"""Training formats: chat markup, instruction JSON, messages; with their validation and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order, as structs of turn, role and text; one shuffle on conv_id."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def chat_markup(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "\n")


def chat_instruction(instruction: Column, output: Column, input: Column | None = None, system: str | None = None) -> Column:
    """One exchange, with the input behind the instruction."""
    ask = instruction if input is None else F.when(F.length(input) > 0, F.concat(instruction, F.lit("\n\nInput: "), input)).otherwise(instruction)
    turns = [F.struct(F.lit("user").alias("role"), ask.alias("text")), F.struct(F.lit("assistant").alias("role"), output.alias("text"))]
    return chat_markup(F.array(*([F.struct(F.lit("system").alias("role"), F.lit(system).alias("text"))] if system else []), *turns))


def instruction_of(turns: Column) -> Column:
    """struct(instruction, output): all of the user's turns in lines and the assistant's first; both empty where either is missing."""
    user = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "user"), lambda t: t["text"]), "\n")
    answer = F.try_element_at(F.filter(turns, lambda t: t["role"] == "assistant"), F.lit(1))["text"]
    both = (F.length(user) > 0) & answer.isNotNull()
    return F.struct(F.when(both, user).otherwise("").alias("instruction"), F.when(both, answer).otherwise("").alias("output"))


def messages(turns: Column) -> Column:
    return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))


def valid_markup(text: Column) -> Column:
    """Whether opening and closing marks balance and each opening one has a role."""
    n = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    roles = F.size(F.regexp_extract_all(text, F.lit(re.escape(OPEN).replace("\\<", "<").replace("\\>", ">") + r"(?:assistant|system|user)\n"), F.lit(0)))
    return (n(OPEN) == n(CLOSE)) & (n(OPEN) > 0) & (roles == n(OPEN))


def valid_instruction(line: Column) -> Column:
    """Whether a JSON line has an instruction and an output."""
    return (F.length(F.get_json_object(line, "$.instruction")) > 0) & (F.length(F.get_json_object(line, "$.output")) > 0)


def valid_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def convert(df: DataFrame, column: Column, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(the valid rows' lines, one row of counts and the success rate)."""
    made = df.select(column.alias("value")).withColumn("ok", F.coalesce(valid, F.lit(False)))
    report = made.agg(F.count("*").alias("n"), F.count_if("ok").alias("valid")).withColumn("rate", F.round(F.try_divide(F.col("valid"), F.col("n")), 6))
    return made.where("ok").select("value"), report


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("value").write.mode(mode).text(path)


def write_documents(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """jsonl, csv, parquet, orc or text; CSV has no line breaks in its fields."""
    out = df.write.mode(mode)
    if kind == "jsonl":
        out.json(path)
    elif kind == "csv":
        df.select(*(F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.mode(mode).csv(path, header=True)
    elif kind == "text":
        df.select(F.concat("text", F.lit("\n")).alias("value")).write.mode(mode).text(path)
    else:
        out.format(kind).save(path)


def manifest(df: DataFrame) -> DataFrame:
    """One row: documents, words, characters, languages and sources."""
    from textloom.functions.text import raw_tokens

    return df.agg(F.count("*").alias("documents"), F.sum(F.size(raw_tokens(F.col("text")))).alias("words"), F.sum(F.length("text")).alias("chars"), F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("sources"))
