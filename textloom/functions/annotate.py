"""Annotations of a document as Column expressions: language, script, sentiment, domain, metadata, entities, tokens' cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.functions.text import let

WORDS = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def first_best(scores: list[tuple[str, Column]]) -> Column:
    """struct(score, name) of the highest score; of equal ones the first listed."""
    return F.array_max(F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores))))


def script(text: Column) -> Column:
    """The script with the most characters; null where no script has any. All but latin lie outside ASCII, so only what is there is searched for them."""

    def count(t: Column, chars: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]", ""))

    def pick(rest: Column) -> Column:
        scores = [(name, count(text if name == "latin" else rest, chars)) for name, chars in L.SCRIPTS.items()]
        return let(first_best(scores), lambda best: F.when(best["score"] > 0, best["name"]))

    return let(F.regexp_replace(text, r"[\x00-\x7F]+", ""), pick)


def language(text: Column) -> Column:
    """struct(language, confidence, script) by common words, with a bonus of a tenth of the words for a script of its own."""
    bonus = {"ru": "cyrillic", "ar": "arabic", "zh": "chinese", "ja": "japanese"}

    def result(code: Column, confidence: Column) -> Column:
        return F.struct(code.alias("language"), F.round(confidence, 6).alias("confidence"))

    def found(x: Column) -> Column:
        w, s = x["w"], x["s"]
        n = F.size(w)

        def common(words: str) -> Column:
            return F.size(F.filter(w, lambda y: y.isin(*words.split())))

        scores = [(k, common(v) + (F.when(s == bonus[k], n * 0.1).otherwise(0) if k in bonus else 0)) for k, v in L.LANGUAGE_WORDS.items()]
        none = F.when(s == "latin", result(F.lit("en"), F.lit(0.3))).otherwise(result(F.lit("unknown"), F.lit(0.0)))
        of_words = let(first_best([*scores, ("ko", F.when(s == "korean", n * 0.1).otherwise(0))]), lambda b: F.when(b["score"] > 0, result(b["name"], F.least(F.lit(1.0), b["score"] / n))).otherwise(none))
        got = F.when(n == 0, result(F.lit("unknown"), F.lit(0.0))).otherwise(of_words)
        return let(got, lambda g: F.struct(g["language"].alias("language"), g["confidence"].alias("confidence"), s.alias("script")))

    return let(F.struct(words(text).alias("w"), script(text).alias("s")), found)


def reliable(found: Column, allowed: tuple[str, ...] | None = None, least: float = 0.7) -> Column:
    """Whether a detection is confident, and of an allowed language."""
    ok = found["confidence"] >= least
    return ok if allowed is None else ok & found["language"].isin(*allowed)


def in_map(word: Column, values: dict[str, float], other: float) -> Column:
    groups: dict[float, list[str]] = {}
    for w, x in values.items():
        groups.setdefault(x, []).append(w)
    return reduce(lambda c, g: c.when(word.isin(*g[1]), g[0]), groups.items(), F.when(F.lit(False), other)).otherwise(other)


def sentiment(text: Column) -> Column:
    """struct(polarity, subjectivity, confidence, emotion): words of a lexicon, turned by a negation one or two words before and scaled by an intensifier."""
    return let(T.tokens(text, 1), _sentiment)


def _sentiment(w: Column) -> Column:
    at = lambda i, k: F.coalesce(F.try_element_at(w, i + 1 - k), F.lit(""))

    def score(x: Column, i: Column) -> Column:
        before, second = F.when(i > 0, at(i, 1)).otherwise(""), F.when(i > 1, at(i, 2)).otherwise("")
        base = F.when(x.isin(*L.POSITIVE), 1.0).when(x.isin(*L.NEGATIVE), -1.0).otherwise(0.0)
        turned = F.when(before.isin(*L.NEGATIONS), -0.8).when(second.isin(*L.NEGATIONS), -0.6).otherwise(1.0)
        emotion = reduce(lambda c, e: c.when(x.isin(*[k for k, v in L.EMOTIONS.items() if v == e]), e), sorted(set(L.EMOTIONS.values())), F.when(F.lit(False), ""))
        return F.struct((base * turned * in_map(before, L.INTENSIFIERS, 1.0)).alias("s"), emotion.alias("e"))

    known = sorted({*L.POSITIVE, *L.NEGATIVE, *L.EMOTIONS})
    scored = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*known), score(x, i))), lambda x: x.isNotNull())
    return let(F.struct(scored.alias("x"), F.greatest(F.size(w), F.lit(1)).alias("n")), lambda v: _emotion(v["x"], v["n"]))


def _emotion(scored: Column, n: Column) -> Column:
    up = F.aggregate(scored, F.lit(0.0), lambda a, x: a + F.greatest(x["s"], F.lit(0.0))) / n
    down = F.aggregate(scored, F.lit(0.0), lambda a, x: a + F.greatest(-x["s"], F.lit(0.0))) / n
    of = lambda e: F.filter(scored, lambda x: x["e"] == e)
    names = sorted(set(L.EMOTIONS.values()))
    best = F.array_max(F.array_compact(F.array(*(F.when(F.size(of(e)) > 0, F.struct(F.aggregate(of(e), F.lit(0.0), lambda a, x: a + F.abs(x["s"])).alias("s"), F.lit(-k).alias("rank"), F.lit(e).alias("e"))) for k, e in enumerate(names)))))
    return let(F.struct(up.alias("up"), down.alias("down"), best.alias("best")), lambda v: _scores(v["up"], v["down"], v["best"]))


def _scores(up: Column, down: Column, best: Column) -> Column:
    polarity, subjectivity = up - down, F.least(F.lit(1.0), up + down)
    emotion = F.coalesce(best["e"], F.when(polarity > 0.1, "joy").when(polarity < -0.1, "sadness").otherwise("neutral"))
    return F.struct(F.round(polarity, 6).alias("polarity"), F.round(subjectivity, 6).alias("subjectivity"), F.round(F.least(F.lit(1.0), F.abs(polarity) + 0.5 * subjectivity), 6).alias("confidence"), emotion.alias("emotion"))


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def domain(text: Column, taxonomy: dict = L.TAXONOMY, least: float = 0.3) -> Column:
    """struct(domain, confidence): occurrences of keywords and twice those of patterns, ten times their share of the words; below least uncategorized."""
    def scores(low: Column) -> Column:
        return first_best([(d, sum((occurrences(low, k) for k in keys), F.lit(0)) + 2 * F.size(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{p})\b"), F.lit(0)))) for d, (keys, p) in taxonomy.items()])

    share = lambda best: F.least(F.lit(1.0), 10 * best["score"] / F.greatest(F.size(T.raw_tokens(text)), F.lit(1)))
    return let(let(F.lower(text), scores), lambda best: let(share(best), lambda c: _domain(best, c, least)))


def _domain(best: Column, confidence: Column, least: float) -> Column:
    return F.struct(F.when((best["score"] > 0) & (confidence >= least), best["name"]).otherwise("uncategorized").alias("domain"), F.round(confidence, 6).alias("confidence"))


AUTHOR = (r"(?im)^(?:author|byline|written by|posted by):?\s*([^\n,]{2,50})$", r"(?im)\bby\s+([A-Z][a-z]+ [A-Z][a-z]+)\b")
DATE = (r"(\d{4}-\d\d-\d\d)", r"((?:\d\d?/){2}\d{4})", r"(?i)(\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4})", r"(?i)((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4})")
URL = (r"(?im)^(?:link|source|url):\s*(https?://\S+)", r"(https?://[^\s<>\x22']+)")
TITLE = (r"(?im)^title:\s*([^\n]{3,200})$", r"(?m)^#\s+([^\n]{3,200})$", r"^\s*([^\n]{3,100})\n")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.regexp_extract(text, T.ascii_pattern(p), 1) for p in patterns]
    return F.trim(F.coalesce(*(F.when(x != "", x) for x in found)))


def metadata(text: Column) -> Column:
    """struct(author, date, url, title, confidence): the first match of ordered patterns each; confidence is the share found."""
    parts = {"author": first_match(text, AUTHOR), "date": first_match(text, DATE), "url": first_match(text, URL), "title": first_match(text, TITLE)}
    found = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in parts.values()), F.lit(0))
    return F.struct(*(x.alias(k) for k, x in parts.items()), (found / 4).alias("confidence"))


ENTITIES = {"URL": T.PII_KINDS["url"], "EMAIL": T.PII_KINDS["email"], "MONEY": r"[$€£]\d+(?:[.,]\d+)*", "DATE": r"\b\d{4}(?:-\d\d){2}\b", "PERCENT": r"\b\d+(?:\.\d+)?%"}


def entities(text: Column, patterns: dict[str, str] = ENTITIES, confidence: float = 0.8, most: int = 100) -> Column:
    """array of (label, text, confidence) of the patterns' matches, most at most as the annotation's own limit."""

    def of(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"), F.lit(confidence).alias("confidence")))

    per = [of(k, p) for k, p in patterns.items()]
    return F.slice(F.concat(*per), 1, most)


def token_fit(tokens: Column, model: str) -> Column:
    """struct(fits, utilisation, over, chunks, cost) of a model's context and price."""
    price, context = L.MODELS[model]
    return F.struct((tokens <= context).alias("fits"), F.round(tokens / context, 6).alias("utilisation"), F.greatest(tokens - context, F.lit(0)).alias("over"), F.ceil(tokens / context).alias("chunks"), F.round(tokens / 1000 * price, 6).alias("cost"))


def language_name(code: Column) -> Column:
    """The English name of a code; the code itself where there is none."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in L.LANGUAGE_NAMES.items() for x in kv)), F.lower(code)), code)


def merged(old: Column, found: Column) -> Column:
    """What was found in the text, where it isn't empty, else what was known."""
    return F.coalesce(F.when(F.length(F.trim(found)) > 0, found), old)
