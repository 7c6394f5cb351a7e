"""Statistics of a corpus: vocabulary, keywords, topics, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators.lineage import cut


def vowels(word: Column) -> Column:
    return F.greatest(F.length(word) - F.length(F.regexp_replace(word, "[aeiouAEIOU]", "")), F.lit(1))


def corpus_statistics(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """A row a group: documents, words, characters, lengths, words a sentence and Flesch's reading ease, in one aggregation with map-side sums."""
    words = F.col("words")
    one = docs.select(*by, F.length(text_col).alias("chars"), T.tokens(F.col(text_col), 1).alias("words"), F.size(T.sentences(F.col(text_col))).alias("sentences"))
    one = one.withColumns({"n": F.size(words), "syllables": F.aggregate(words, F.lit(0), lambda s, w: s + vowels(w))})
    out = one.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.sum("chars").alias("chars"), F.sum("sentences").alias("sentences"), F.sum("syllables").alias("syllables"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"))
    flesch = 206.835 - 1.015 * F.col("words") / F.col("sentences") - 84.6 * F.col("syllables") / F.col("words")
    return out.withColumn("flesch", F.round(F.least(F.greatest(F.coalesce(flesch, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)), 4)).drop("syllables").withColumn("mean", F.round("mean", 6))


def _word_sums(words: DataFrame) -> DataFrame:
    """(word, n, df, share) of a column w of word lists: occurrences, lists that hold it, and the sum over occurrences of 1 / its list's size.

    Each list is exploded once, its words and its distinct words together, so one aggregation with map-side sums is all.
    """
    one = lambda n, df, share: lambda x: F.struct(x.alias("word"), F.lit(n).alias("n"), F.lit(df).alias("df"), share.alias("share"))
    both = F.concat(F.transform("w", one(1, 0, 1.0 / F.size("w"))), F.transform(F.array_distinct("w"), one(0, 1, F.lit(0.0))))
    return words.select(F.explode(both).alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df"), F.sum("x.share").alias("share"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, df)."""
    return _word_sums(docs.select(T.tokens(F.col(text_col)).alias("w"))).select("word", "n", "df")


def keywords_frequency(docs: DataFrame, top: int = 50, text_col: str = "text") -> DataFrame:
    """(word, frequency) of the top most frequent valid keywords; of equal ones the first by name."""
    return docs.select(F.explode(T.keywords(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "word").limit(top)


def keywords_tfidf(docs: DataFrame, top: int | None = 50, text_col: str = "text") -> DataFrame:
    """(word, frequency, score): the sum over documents of the share of its keywords times ln(documents / those with the word).

    The sum splits into idf(word) times the sum of shares, and that into one over its document's size for each occurrence.
    """
    n = docs.count()
    words = _word_sums(docs.select(T.keywords(F.col(text_col)).alias("w"))).withColumnRenamed("n", "frequency")
    out = words.select("word", "frequency", F.round(F.col("share") * F.ln(F.lit(float(n)) / F.col("df")), 6).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "word").limit(top)


def keywords_combined(docs: DataFrame, top: int = 50, text_col: str = "text", weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """The full outer join of both lists, each scaled by its highest."""
    a = keywords_tfidf(docs, top, text_col).select("word", F.col("frequency").alias("fa"), "score")
    b = keywords_frequency(docs, top, text_col).select("word", F.col("frequency").alias("fb"))
    all_rows = Window.partitionBy(F.lit(0))  # 2 * top rows at most
    both = a.join(b, "word", "full").withColumns({"highest": F.max("score").over(all_rows), "most": F.max("fb").over(all_rows)})
    score = weights[0] * F.coalesce(F.col("score") / F.col("highest"), F.lit(0.0)) + weights[1] * F.coalesce(F.col("fb") / F.col("most"), F.lit(0.0))
    return both.select("word", F.coalesce("fa", "fb").alias("frequency"), F.round(score, 6).alias("score"))


def word_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(T.tokens(F.col(text_col))).alias("w")).groupBy(F.length("w").alias("length")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share in percent)."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))  # a row a value


def diversity(df: DataFrame, column: str) -> DataFrame:
    """Shannon's entropy in bits of a column's distribution."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("kinds"))
    return total.select("kinds", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def topic_count(n: int) -> int:
    for bound, most, part in ((10, 2, None), (50, 5, 5), (200, 10, 10)):
        if n < bound:
            return most if part is None else max(2, min(most, n // part))
    return max(2, min(20, n // 20))


def topic_words(docs: DataFrame, topics: int = 5, words: int = 5, text_col: str = "text") -> DataFrame:
    """(topic, word, n): the words that documents hold twice or more, most frequent first, dealt out in slices."""
    valid = F.filter(T.tokens(F.col(text_col)), lambda w: F.length(w).between(3, 50) & ~w.isin(*L.TOPIC_STOPWORDS))
    counts = docs.select(F.explode(F.filter(T.word_counts(valid), lambda x: x["n"] >= 2)).alias("x")).select("x.*")  # within the document, so only words meet in the aggregation
    n = counts.groupBy("word").agg(F.sum("n").alias("n"))
    best = n.orderBy(F.desc("n"), "word").limit(topics * words)
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "word"))  # topics * words rows
    return best.select(F.floor((k - 1) / words).alias("topic"), "word", "n")


def frequent_words(docs: DataFrame, least: int = 2, most: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, n) of the words that a document has least times or more and at most as that share of its words; rows of one id are one document.

    Words are counted within the row; only those of ids with several rows, if there are any, meet in a shuffle.
    """
    kept = lambda n, total: (n >= least) & (n <= most * total)
    ids = cut(docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    several, match = not ids.isEmpty(), docs[id_col].eqNullSafe(ids["_id"])
    words = (docs.join(ids, match, "left_anti") if several else docs).select(id_col, T.tokens(F.col(text_col)).alias("w"))
    one = words.select(id_col, F.size("w").alias("total"), F.explode(T.word_counts(F.col("w"))).alias("x")).where(kept(F.col("x.n"), F.col("total"))).select(id_col, "x.word", "x.n")
    if not several:
        return one
    rest = docs.join(ids, match, "left_semi").select(id_col, F.explode(T.tokens(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    return one.union(rest.withColumn("total", F.sum("n").over(Window.partitionBy(id_col))).where(kept(F.col("n"), F.col("total"))).drop("total"))


def topics_lda(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, iterations: int = 20, vocabulary_size: int = 1000, seed: int = 42) -> DataFrame:
    """(id, topic weights): the most frequent words of those in 2 documents or more and 80 % at most, counted by document, then LDA.

    The words are counted within the document and then in an aggregation over shuffle partitions; CountVectorizer would keep all
    tokens and shuffle its words into as many tasks as the input has. LDA reads the counts once a round, not the texts.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    words = docs.select(F.col(id_col).alias("id"), F.filter(T.tokens(F.col(text_col)), lambda w: F.length(w).between(3, 50) & ~w.isin(*L.TOPIC_STOPWORDS)).alias("w"))
    sums = words.select(F.explode(T.word_counts(F.col("w"))).alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n"), F.count("*").alias("df"))
    best = sums.where(F.col("df").between(2, 0.8 * docs.count())).orderBy(F.desc("n"), "word").limit(vocabulary_size)
    vectors = CountVectorizerModel.from_vocabulary([r.word for r in best.select("word").collect()], inputCol="w", outputCol="features")
    counted = cut(vectors.transform(words).select("id", "features"))
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(counted)
    return model.transform(counted).select(F.col("id").alias(id_col), F.transform(vector_to_array("topicDistribution"), lambda x: F.round(x, 6)).alias("weights"))
