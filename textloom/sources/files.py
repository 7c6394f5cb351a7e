"""Files as DataFrames: listing, type detection, text, CSV, JSON."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Heads of files, as hex, and their types.
MAGIC = {"25504446": "pdf", "89504e47": "png", "ffd8ff": "jpg", "47494638": "gif", "504b0304": "zip", "d0cf11e0": "doc", "7b5c727466": "rtf", "1f8b": "gz", "49492a00": "tiff", "4d4d002a": "tiff"}
OFFICE = {"docx", "pptx", "xlsx", "odt", "epub"}
SIZE = r"(?i)^\s*([\d.]*\d)\s*([KMGT]?)B?\s*$"
EXTENSIONS = {e: k for k, es in {"txt": "txt text log", "markdown": "md markdown", "html": "htm html", "json": "json", "jsonl": "jsonl ndjson", "csv": "csv", "tsv": "tsv", "xml": "xml", "pdf": "pdf", "docx": "docx", "jpg": "jpeg jpg", "png": "png", "svg": "svg", "gif": "gif", "tiff": "tif tiff"}.items() for e in es.split()}


def scan(spark: SparkSession, paths: str | Sequence[str], types: Sequence[str] | None = None, ignore: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(id, path, length, modified, content, type, confidence) of files, in folders below too; empty and hidden ones, globs' matches and other types are left out.

    The id is a hash of the path, as a listing's order isn't stable. Only what the plan uses of content is read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    df = df.where(F.col("length") > 0).where(~F.col("path").rlike(r"/\.[^/]+(?:/|$)"))
    df = df if most is None else df.where(F.col("length") <= most)
    for glob in ignore:
        df = df.where(~F.col("path").rlike("(?:^|/)" + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, rf"\{c}" if not c.isalnum() else c) for c in glob) + "$"))
    kind = detect(F.col("path"), F.col("content"))
    out = df.select(F.concat(F.lit("doc_"), F.sha2("path", 256).substr(1, 16)).alias("id"), "path", "length", F.col("modificationTime").alias("modified"), "content", kind["type"].alias("type"), kind["confidence"].alias("confidence"))
    return out if types is None else out.where(F.col("type").isin(*types))


def detect(path: Column, content: Column) -> Column:
    """struct(type, confidence): the head's signature (0.95), else the extension (0.8), else what the first 1,024 bytes look like (0.4), else unknown."""
    head, ext = F.lower(F.hex(F.substring(content, 1, 8))), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    magic = F.coalesce(*(F.when(head.startswith(m), F.lit(t)) for m, t in MAGIC.items()))
    magic = F.when((magic == "zip") & ext.isin(*OFFICE), ext).otherwise(magic)
    named = F.coalesce(*(F.when(ext == e, F.lit(t)) for e, t in EXTENSIONS.items()))
    seen = sniff(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    answer = lambda t, c: F.struct(t.alias("type"), F.lit(c).alias("confidence"))
    return F.when(magic.isNotNull(), answer(magic, 0.95)).when(named.isNotNull(), answer(named, 0.8)).when(seen.isNotNull(), answer(seen, 0.4)).otherwise(answer(F.lit("unknown"), 0.0))


def sniff(start: Column) -> Column:
    """json, csv, html, xml, markdown or txt by a text's start; null where under 70 % is printable."""
    printable = F.length(F.regexp_replace(start, r"[^\x20-\x7E\s\xA0-\xFF]", "")) / F.greatest(F.length(start), F.lit(1))
    lines = F.slice(F.split(start, "\n"), 1, 5)
    commas = F.forall(F.filter(lines, lambda s: F.trim(s) != ""), lambda s: F.contains(s, F.lit(","))) & (F.size(lines) > 1)
    t = F.trim(start)
    return F.when(printable < 0.7, None).when(t.rlike(r"^(?s)[\[{].*[\]}:,\"]"), "json").when(commas, "csv").when(t.rlike(r"(?is)<!doctype html|<html\b"), "html").when(t.rlike(r"^<\?xml|^<[a-zA-Z]"), "xml").when(t.rlike(r"(?m)^#{1,6} |^```|\]\("), "markdown").otherwise("txt")


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 if it is valid, else Windows-1252; a byte-order mark goes."""

    def one(raw: pd.Series) -> pd.Series:
        def text(b: bytes | None) -> str | None:
            if b is None:
                return None
            for form in ("utf-8-sig", "cp1252"):
                try:
                    return bytes(b).decode(form)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "replace")

        return raw.map(text)

    return F.coalesce(F.when(F.is_valid_utf8(content), F.regexp_replace(content.cast("string"), "^﻿", "")), F.pandas_udf(one, "string")(F.when(~F.is_valid_utf8(content), content)))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """All columns as strings, trimmed, with snake-case names; the delimiter of the most fields in the first line unless one is given."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()  # a header line
        delimiter = max(",;\t|", key=lambda d: first[0][0].count(d)) if first else ","
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, escape='"')
    names = df.columns
    clean = [r["c"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.snake_case(F.col("n")).alias("c")).collect()]
    return df.toDF(*clean)


def clean_rows(df: DataFrame) -> DataFrame:
    """Placeholders become empty, rows without a value go, as do exact repeats."""
    out = df.select(*(F.when(T.is_placeholder(F.col(c)), "").otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in out.columns]
    keep = filled[0]
    for f in filled[1:]:
        keep = keep | f
    return out.where(keep).distinct()


def csv_text(df: DataFrame, rows: int = 10) -> str:
    """A table's header, its first rows and its totals as text."""
    n, head = df.count(), df.limit(rows).collect()
    return "\n".join([" | ".join(df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in head), f"{n} rows, {len(df.columns)} columns"])


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None) -> DataFrame:
    """JSON or JSON lines; lines that can't be parsed are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path, multiLine=not lines)


def flatten(df: DataFrame, separator: str = ".", depth: int = 10) -> DataFrame:
    """Structs' fields as columns with dotted names, level by level."""
    for _ in range(depth):
        structs = {f.name for f in df.schema.fields if f.dataType.typeName() == "struct"}
        if not structs:
            break
        columns = []
        for f in df.schema.fields:
            if f.name in structs:
                columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}") for g in f.dataType.fields]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def json_depth(text: Column, most: int = 100) -> Column:
    """Nesting of a JSON text: the most braces and brackets open at once outside strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    fold = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + F.when(s.isin("{", "["), 1).when(s.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(s.isin("{", "["), 1).otherwise(0)).alias("most")))
    return F.least(fold["most"], F.lit(most))


def is_tabular(array: Column) -> Column:
    """Whether a JSON array has two objects or more, all with the same keys."""
    objects = F.from_json(array, "array<string>")
    keys = F.transform(objects, lambda x: F.array_sort(F.json_object_keys(x)))
    return F.coalesce((F.size(objects) >= 2) & F.forall(keys, lambda k: k.isNotNull()) & (F.size(F.array_distinct(keys)) == 1), F.lit(False))


def headings(text: Column) -> Column:
    """Lines of 3 to 100 characters that look like headings: capitals throughout, numbered, in title case, or of a chapter, section or appendix."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    numbered = r"^[A-Z][A-Z\s]+$|^\d+\.\s+[A-Z]|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$|^(?:Chapter|Section)\s+\d+|^Appendix\s+[A-Z]"

    def heading(s: Column) -> Column:
        upper = (F.upper(s) == s) & (F.lower(s) != s) & F.length(s).between(5, 50)
        title = ~s.rlike("[.!?,;]$") & (F.length(s) <= 80) & s.rlike(r"^\p{Lu}\S*(?:\s+\p{Lu}\S*)+$")
        return F.length(s).between(3, 100) & (s.rlike(numbered) | upper | title)

    return F.filter(lines, heading)


def clean_yaml(text: Column) -> Column:
    """YAML to JSON with what clean_json tidies; null for what isn't YAML, and where no YAML parser is installed."""

    def one(texts: pd.Series) -> pd.Series:
        try:
            import yaml
        except ModuleNotFoundError:
            return pd.Series([None] * len(texts), dtype=object)
        import json

        def go(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(yaml.safe_load(t), default=str)
            except (yaml.YAMLError, ValueError, RecursionError):
                return None

        return texts.map(go)

    return clean_json(F.pandas_udf(one, "string")(text))


def clean_json(text: Column) -> Column:
    """Keys in snake case and placeholder values dropped, at every level; null for what isn't JSON."""
    import json
    import re

    from textloom.functions.lexicons import PLACEHOLDERS

    def name(k: str) -> str:
        k = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", k)
        return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]+", "_", k)).strip("_").lower()

    def tidy(x):
        if isinstance(x, dict):
            return {name(k): y for k, v in x.items() if (y := tidy(v)) not in (None, {}, [])}
        if isinstance(x, list):
            return [y for v in x if (y := tidy(v)) not in (None, {}, [])]
        return None if isinstance(x, str) and x.strip().lower() in PLACEHOLDERS else x

    def one(texts: pd.Series) -> pd.Series:
        def go(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(tidy(json.loads(t)), ensure_ascii=False, sort_keys=True)
            except (ValueError, RecursionError):
                return None

        return texts.map(go)

    return F.pandas_udf(one, "string")(text)


def size_of(text: Column) -> Column:
    """Bytes of a size such as 10MB, by 1,024s; null for anything else."""
    number, unit = F.regexp_extract(text, SIZE, 1), F.upper(F.regexp_extract(text, SIZE, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", (number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))
