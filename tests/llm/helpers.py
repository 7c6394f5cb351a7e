import random

SYLLABLES = "an be ca do el fi gu ho in ju ka lo mi no or pe qui ra so tu ul va we xi yo za".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def edited(rng, text, share):
    return " ".join(word(rng) if rng.random() < share else w for w in text.split())


def odd_rows():
    """(id, text): nulls in either column, empty and blank texts, one very long, ties and repeated rows."""
    long = prose(random.Random(3), 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "word"), (None, "nameless words stay here"), (None, None), (6, long), (7, "!!! ???"), (8, "ünïcödé 漢字 \U0001f600 \x00 end")]


def frame(spark, rows, extra=True):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "u", "v", "cell", "f0", "gone", "again", "row", "rank", "none", "cleaned", "first", "n", "h", "lang", "start"):
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df
