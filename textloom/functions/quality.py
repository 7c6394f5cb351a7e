"""Quality scores of a document as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T

WEIGHTS = {"length": 0.15, "language": 0.15, "coherence": 0.20, "uniqueness": 0.15, "readability": 0.15, "structure": 0.10, "completeness": 0.10}
#: Java's dialect (a reference back to a group). Case doesn't count in any pattern, so that capitals of five letters match any such word.
REPEATED_WORD = r"(?im)\b(\w+)(?:\s+\1){2}\b"
LOW_QUALITY = (r"(?im)\b(?:amazing|buy now|click here|free|incredible|!!+)\b", r"(?im)[A-Z]{5,}", r"(?im)[!]{3,}|[?]{3,}", r"(?im)\$\d+|\d+%\s*off")
INCOMPLETE = r"(?i)\.\.\.$|\[.*\]$|fixme|lorem ipsum|todo|xxx"
FORMATTING = r"[^\p{L}\p{N}_\s]{5,}|\n{4,}|\s{3,}"


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def simple_score(text: Column, language: Column, target: int = 800, least: float = 0.0, places: int = 4) -> Column:
    """struct(overall, length, language, cleanliness), rounded; the overall score is least at least."""
    n = F.length(text)
    bad = n - F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F]", ""))
    length = clamp(n / target)
    known = F.when(language.isNull() | F.lower(language).isin("", "unknown"), 0.5).otherwise(1.0)
    clean = clamp(1 - F.least(F.lit(1.0), 10 * bad / F.greatest(n, F.lit(1))))
    overall = F.greatest((length + known + clean) / 3, F.lit(least))
    return F.struct(*(F.round(x, places).alias(k) for k, x in (("overall", overall), ("length", length), ("language", known), ("cleanliness", clean))))


def length_score(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 50, 0.2).when(n > 50000, 0.7).when(n.between(200, 5000), 1.0).when(n < 200, F.greatest(F.lit(0.5), n / 200)).otherwise(F.greatest(F.lit(0.6), 1 - 0.4 * (n - 5000) / 5000))


def language_score(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / n
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / n
    return F.when(foreign > 0.3, 0.8).otherwise(1.0) * F.when(F.contains(text, F.lit("�")), 0.5).otherwise(1.0) * F.when(signs > 0.2, 0.9).otherwise(1.0)


def repeats_sequence(line: str, least: int = 10, times: int = 4) -> bool:
    """Whether a part of least characters or more stands times over in a row, as the pattern (.{10,})\\1{3,} has it.

    With a period p, (times - 1) * p characters in a row equal those p on, among them two at multiples of p next to each
    other; so only periods with such a pair are looked at, and all periods together cost n log n, not the square of n.
    """
    n = len(line)
    if not any(line.find(line[i : i + least], i + least) >= 0 for i in range(0, n - (times - 1) * least, least)):
        return False  # of a repeated part, the first least characters at a multiple of least come again
    s = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    for p in range(least, n // times + 1):
        grid = s[: n // p * p : p]
        same = grid[1:] == grid[:-1]
        if (same[1:] & same[:-1]).any():
            equal = np.flatnonzero(np.r_[True, s[p:] != s[:-p], True])
            if np.diff(equal).max() > (times - 1) * p:
                return True
    return False


def repeats_line(before: str, line: str, least: int = 50) -> bool:
    """Whether a line begins with the end, of least characters or more, of the one before it."""
    head, at = line[:least], -1
    if len(head) < least:
        return False
    while (at := before.find(head, at + 1)) >= 0:
        if line.startswith(before[at:]):
            return True
    return False


def repetitions():
    """An Arrow function: 1 if a line repeats a sequence, plus 2 if it repeats the line before."""

    def count(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            lines = (t or "").lower().split("\n")
            out.append(any(map(repeats_sequence, lines)) + 2 * any(map(repeats_line, lines, lines[1:])))
        return pd.Series(out, dtype="int32")

    return F.pandas_udf(count, "int")


def coherence_score(text: Column) -> Column:
    found = repetitions()(text)
    score = F.when(found.bitwiseAND(1) > 0, 0.7).otherwise(1.0) * F.when(found.bitwiseAND(2) > 0, 0.7).otherwise(1.0) * F.when(text.rlike(REPEATED_WORD), 0.7).otherwise(1.0)
    for pattern in LOW_QUALITY:
        score = score * F.when(text.rlike(pattern), 0.5).otherwise(1.0)
    return score * F.when(sentence_variance(text) < 5, 0.9).otherwise(1.0)


def sentence_variance(text: Column) -> Column:
    """Population variance of the sentences' words; null without a sentence."""
    return T.let(F.transform(T.sentences(text), lambda s: F.size(T.raw_tokens(s))), _variance)


def _variance(n: Column) -> Column:
    sums = F.aggregate(n, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["k"] + 1).alias("k"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    return F.when(F.size(n) > 0, sums["q"] / sums["k"] - (sums["s"] / sums["k"]) * (sums["s"] / sums["k"]))


def readability_score(text: Column) -> Column:
    return T.let(T.raw_tokens(text), lambda words: T.let(F.size(T.sentences(text)), lambda sentences: _readability(words, sentences)))


def _readability(words: Column, sentences: Column) -> Column:
    n = F.size(words)
    syllables = F.aggregate(words, F.lit(0), lambda s, w: s + F.greatest(F.length(w) - F.length(F.regexp_replace(w, "[aeiouAEIOU]", "")), F.lit(1)))
    flesch = 206.835 - 1.015 * n / sentences - 84.6 * syllables / n
    return F.when((n == 0) | (sentences == 0), 0.0).otherwise(clamp(flesch / 100))


def structure_score(text: Column, headings: Column | None = None) -> Column:
    breaks = F.contains(text, F.lit("\n\n")) | (F.length(text) <= 500)
    score = F.when(breaks, 1.0).otherwise(0.8) * F.when(text.rlike(FORMATTING), 0.9).otherwise(1.0)
    return score if headings is None else F.when(headings > 0, F.least(F.lit(1.0), score * 1.1)).otherwise(score)


def completeness_score(text: Column) -> Column:
    found = T.let(F.lower(text), lambda low: sum((F.when(low.rlike("|".join(words)), 1).otherwise(0) for words in L.COMPLETENESS.values()), F.lit(0)))
    return F.least(F.lit(1.0), F.when(text.rlike(INCOMPLETE), 0.6).otherwise(1.0) + F.least(F.lit(0.2), found * 0.05))


def factors(text: Column, uniqueness: Column | None = None) -> Column:
    """struct of the seven scores and the weighted overall one; without a corpus a document counts as unique."""
    parts = {"length": length_score(text), "language": language_score(text), "coherence": coherence_score(text), "uniqueness": F.lit(1.0) if uniqueness is None else uniqueness, "readability": readability_score(text), "structure": structure_score(text), "completeness": completeness_score(text)}

    def result(p: Column) -> Column:
        overall = sum((WEIGHTS[k] * p[k] for k in parts), F.lit(0.0))
        return F.struct(*(F.round(p[k], 6).alias(k) for k in parts), F.round(overall, 6).alias("overall"))

    return T.let(F.struct(*(v.cast("double").alias(k) for k, v in parts.items())), result)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


def issues(text: Column, similarity: Column | None = None) -> Column:
    """array of (type, severity, what) that hold."""
    words, sentences = F.size(T.raw_tokens(text)), F.greatest(F.size(T.sentences(text)), F.lit(1))
    n = F.greatest(F.length(text), F.lit(1))
    rules = [
        ("length", "high", "shorter than 50 characters", F.length(text) < 50),
        ("length", "medium", "longer than 50,000 characters", F.length(text) > 50000),
        ("language", "medium", "many characters outside ASCII", F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / n > 0.3),
        ("language", "high", "replacement characters", F.contains(text, F.lit("�"))),
        ("language", "low", "many signs", F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / n > 0.2),
        ("readability", "medium", "long sentences", words / sentences > 25),
        ("structure", "medium", "no break between paragraphs", ~F.contains(text, F.lit("\n\n")) & (F.length(text) > 500)),
        ("structure", "low", "untidy spacing or signs", text.rlike(FORMATTING)),
        ("completeness", "high", "unfinished", text.rlike(INCOMPLETE)),
    ]
    if similarity is not None:
        rules += [("uniqueness", "high", "very like another document", similarity > 0.8), ("uniqueness", "medium", "like another document", (similarity > 0.6) & (similarity <= 0.8))]
    return F.array_compact(F.array(*(F.when(test, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(d).alias("what"))) for t, s, d, test in rules)))


def clean_score(text: Column, original: Column, language_ok: Column, least: int = 100, optimal: int = 1000, most: float = 0.4) -> Column:
    """The cleaning stage's score: .2 length, .2 language, .3 by the share of boilerplate removed, .3 for what it takes as given."""
    n = F.length(text)
    length = F.when(n < least, n / least * 0.5).when(n < optimal, 0.5 + 0.5 * (n - least) / (optimal - least)).otherwise(1.0)
    removed = 1 - n / F.greatest(F.length(original), F.lit(1))
    return 0.2 * length + 0.2 * F.when(language_ok, 1.0).otherwise(0.5) + 0.3 * clamp(1 - removed / most) + 0.3


def preprocessor_score(before: Column, after: Column, valid: Column, least: int = 50) -> Column:
    """.3 length, .2 whether it is valid, .2 distinct characters of 26, .2 the share removed (best from a tenth to four tenths), .1 no error; 0 for an empty result."""
    n, removed = F.length(after), 1 - F.length(after) / F.greatest(F.length(before), F.lit(1))
    length = F.when(n < least, n / least * 0.5).when(n <= 1000, 0.5 + n / 1000 * 0.5).otherwise(1.0)
    variety = F.least(F.lit(1.0), F.size(F.array_distinct(F.split(F.lower(after), ""))) / 26)
    noise = F.when(removed.between(0.1, 0.4), 1.0).when(removed < 0.1, 0.8).otherwise(F.greatest(F.lit(0.3), 1 - (removed - 0.4) * 2))
    score = 0.3 * length + 0.2 * F.when(valid, 1.0).otherwise(0.0) + 0.2 * variety + 0.2 * noise + 0.1 * F.when(valid, 1.0).otherwise(0.5)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(clamp(score))


#: A small letter, then white space and a single capital; a run of consonants.
BROKEN, CLUSTER = r"[a-z]\s+[A-Z](?:[^A-Z]|$)", "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{5,}"


def uncleanliness(text: Column) -> Column:
    """array of what is unclean: broken sentences, gibberish (more than one run of consonants in 1,000 characters), more than a tenth of signs, replacement characters."""
    n = F.length(text)
    tests = {
        "broken sentences": text.rlike(BROKEN), "gibberish": F.size(F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0))) > n / 1000,
        "many signs": (n > 0) & (F.length(F.regexp_replace(text, r"[\p{L}\p{N}_\s]", "")) > 0.1 * n), "bad encoding": F.contains(text, F.lit("\ufffd")),
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(what)) for what, test in tests.items())))
