"""Queries of the text functions: the length and the MD5 of each document's result, so that one wrong character shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.plans.registry import query, table

TOKENS_SQL = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}'))"
RAW_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
SENTENCES_SQL = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"

PAIRS_SQL = f"""s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM s),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


def fingerprint(df, result):
    return df.select("doc_id", F.length(result).cast("long").alias("n"), F.md5(result).alias("digest"))


def _rules(name: str, rules: T.Rules, sql: bool = True):
    text = T.rewrite_sql("text", rules)

    @query(f"text_{name}", f"SELECT doc_id, length(r) AS n, md5(r) AS digest FROM (SELECT doc_id, {text} AS r FROM documents)" if sql else None)
    def run(spark, sf):
        return fingerprint(table(spark, sf, "documents"), T.rewrite(F.col("text"), rules))


for _name, _set in {
    "whitespace": T.WHITESPACE, "final_cleanup": T.FINAL, "ocr_spacing": T.OCR_SPACING, "noise": T.TEXT_NOISE, "web_noise": T.WEB_NOISE, "web_metadata": T.WEB_METADATA, "metadata_junk": T.METADATA_JUNK,
    "global_boilerplate": T.GLOBAL_BOILERPLATE, "generated": T.GENERATED, "code_secrets": T.CODE_SECRETS, "code_noise": T.CODE_NOISE, "code_style": T.CODE_STYLE, "image_text": T.IMAGE_TEXT, "specials": T.SPECIALS,
    "web_references": T.WEB_REFERENCES, "language_input": T.LANGUAGE_INPUT, "ocr_line_joins": T.OCR_LINES, "duplicate_key": T.DUPLICATE_KEY, "pii_mask": T.PII,
}.items():
    _rules(_name, _set)


@query("text_smart_quotes", f"SELECT doc_id, length(r) AS n, md5(r) AS digest FROM (SELECT doc_id, translate(text, '{''.join(L.QUOTES)}', '{''.join(L.QUOTES.values()).replace(chr(39), chr(39) * 2)}') AS r FROM documents)")
def text_smart_quotes(spark, sf):
    return fingerprint(table(spark, sf, "documents"), T.smart_quotes(F.col("text")))


@query("text_clean", f"SELECT doc_id, length(r) AS n, md5(r) AS digest FROM (SELECT doc_id, {T.rewrite_sql('text', [*T.CONTROL, *T.WHITESPACE, *T.TEXT_NOISE, *T.WEB_NOISE, *T.GLOBAL_BOILERPLATE, *T.GENERATED, *T.CODE_SECRETS, *T.PII, *T.FINAL])} AS r FROM documents)")
def text_clean(spark, sf):
    return fingerprint(table(spark, sf, "documents"), T.clean_document(F.col("text")))


@query("text_normalise")
def text_normalise(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", T.normalise(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("digest"), F.col("r.corrections").alias("corrections"), F.round("r.score", 6).alias("score"))


@query("text_ocr")
def text_ocr(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", T.ocr(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("digest"), F.col("r.score").alias("score"))


@query("text_repeated_paragraphs")
def text_repeated_paragraphs(spark, sf):
    return fingerprint(table(spark, sf, "documents"), T.repeated_paragraphs(F.col("text")))


@query("text_boilerplate_lines", """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '(?i)license|copyright|all rights') AND length(trim(s)) >= 3), chr(10)) AS kept FROM documents""")
def text_boilerplate_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.boilerplate_lines(F.col("text"), ["license", "copyright", "all rights"], aggressive=True).alias("kept"))


@query("pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in sorted(T.PII_KINDS.items())) + " FROM documents")
def pii_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias(k) for k, p in sorted(T.PII_KINDS.items())))


@query("token_lists", f"SELECT doc_id, len({TOKENS_SQL}) AS words, len({RAW_SQL}) AS raw, len({SENTENCES_SQL}) AS sentences, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents")
def token_lists(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("words"), F.size(T.raw_tokens(t)).cast("long").alias("raw"), F.size(T.sentences(t)).cast("long").alias("sentences"), F.md5(F.array_join(T.tokens(t), " ")).alias("digest"))


@query("stopwords_removed", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) NOT IN {L.STOPWORDS} AND length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS kept FROM documents")
def stopwords_removed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.without_stopwords(F.col("text")), " ").alias("kept"))


@query("frequency_filtered", f"""WITH w AS (SELECT doc_id, unnest({TOKENS_SQL}) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, word, n FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM n) WHERE n >= 2 AND n <= 0.1 * total""")
def frequency_filtered(spark, sf):
    from textloom.operators.analytics import frequent_words

    return frequent_words(table(spark, sf, "documents"))


@query("term_positions", "SELECT doc_id, list_filter(range(0, greatest(length(text) - 3, 0) + 1), lambda i: substr(text, i + 1, 3) = 'tha') AS at FROM documents")
def term_positions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.positions(F.col("text"), "tha").cast("array<long>").alias("at"))


@query("token_counts", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n"))


@query("snake_case", "SELECT p_partkey, lower(" + T.rewrite_sql("p_name || ' ' || p_type", T.SNAKE) + ") AS name FROM part")
def snake_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.snake_case(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
