"""Duplicates, graphs, warehouse and streams against brute force."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics as A
from textloom.operators import graph as G
from textloom.operators import relational as R
from textloom.operators import similarity as S
from textloom.operators import sql_text as Q
from textloom.operators import validation as V
from textloom.operators import warehouse as W
from textloom.sources import databases as D
from textloom.streaming import queries as ST


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(n):
        base = rng.sample(words, 30)
        docs.append(" ".join(base))
        if rng.random() < 0.5:
            docs.append(" ".join(w if rng.random() > 0.1 else rng.choice(words) for w in base))
    return list(enumerate([*docs, docs[0], docs[0].upper() + "!", "", "tiny"]))


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_similar_pairs_against_brute_force(spark, threshold):
    docs = corpus()
    sets = {i: set(t.lower().split()) for i, t in docs}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    got = {(r.a, r.b) for r in S.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()}
    assert got == want


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 17)  # several blocks a task
    docs = [*corpus(), (3, "w1 w2"), (None, "w1 w2 w3")]  # another's id, none
    sets = [(i, set(t.lower().split())) for i, t in docs]
    want = {}
    for i, p in sets:
        s = [len(p & q) / len(p | q) for j, q in sets if p and q and None not in (i, j) and i != j]
        old = want.get(i, (0.0, 0))
        want[i] = (max([old[0], *s]), old[1] + sum(x > 0.7 for x in s))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.id: (r.similarity, r.similar) for r in S.nearest(df).collect()} == want
    asked = {r.id: (r.similarity, r.similar) for r in S.nearest(df, probes=df.where("doc_id % 5 = 0")).collect()}
    assert asked == {k: v for k, v in want.items() if k is not None and k % 5 == 0}


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 50)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = S.similar_pairs(docs, 0.4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert found.count() == S.similar_pairs(docs.repartition(5), 0.4).count() > 0


def test_ratio_is_that_of_difflib(monkeypatch):
    rng = random.Random(5)
    for places in (S.PLACES, 10):  # the latter by difflib's own search
        monkeypatch.setattr(S, "PLACES", places)
        for k in range(150):
            letters, n = rng.choice(["ab", "abcdefgh", "etaoinshrdlucmfwypvbgkqjxz      ", "aé漢ß😀 "]), rng.choice([1, 30, 199, 200, 450])
            a = "".join(rng.choices(letters, k=n))
            b = "".join(c if rng.random() > k / 300 else rng.choice(letters) * rng.randrange(3) for c in a)
            b = b[n // 2 :] + b[: n // 2] if k % 5 == 0 else b
            want = SequenceMatcher(None, a, b).ratio()
            assert [S._ratio(a, b, least) for least in (0.0, 0.5, 0.85)] == [want * (want >= least) for least in (0.0, 0.5, 0.85)]
    assert S._ratio("", "", 0.5) == 1.0 and S._ratio("", "a", 0.0) == 0.0


def test_near_pairs_are_verified_where_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 17)
    docs = [(i, t) for i, t in corpus() if len(t) >= 50]
    sets = {i: set(t.lower().split()) for i, t in docs}
    key = {i: t.lower().replace("!", "") for i, t in docs}
    want = {}
    for a, b in combinations(sorted(sets), 2):
        s, r = len(sets[a] & sets[b]) / len(sets[a] | sets[b]), SequenceMatcher(None, key[a], key[b]).ratio()
        if s >= 0.5 and r >= 0.85 or s >= 0.8:
            want[a, b] = s, r * (r >= 0.85)
    found = S.near_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), fuzzy=0.8)
    assert {(r.a, r.b): (r.similarity, r.ratio) for r in found.collect()} == want and len(want) > 10
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no text is moved for a pair


def test_staged_deduplication(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    n = len(corpus())
    got = S.deduplicate(docs).collect()
    assert {(r.id, r.rep_id) for r in got if r.kind == "exact"} >= {(n - 4, 0), (n - 3, 0)}
    ids = [r.id for r in got]
    assert len(ids) == len(set(ids)) and not {r.rep_id for r in got} & set(ids)
    assert {r.kind for r in S.statistics(S.deduplicate(docs)).collect()} >= {"exact"}


def test_staged_statistics_pack_the_texts_once(spark, monkeypatch):
    packed, blocks = [], S._blocks
    monkeypatch.setattr(S, "_blocks", lambda *args: packed.append(args) or blocks(*args))
    got = {r.kind: r.removed for r in S.statistics(S.deduplicate(spark.createDataFrame(corpus(), "doc_id long, text string"))).collect()}
    assert len(packed) == 1 and got["exact"] >= 2


def test_staged_texts_are_not_shuffled_to_leave_out_copies(spark, monkeypatch):
    plans, blocks = [], S._blocks
    monkeypatch.setattr(S, "_blocks", lambda docs, *args: plans.append(docs._jdf.queryExecution().executedPlan().toString()) or blocks(docs, *args))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame(corpus(), "doc_id long, text string")
        got = S.deduplicate(docs).collect()
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        monkeypatch.setattr(S, "SENT_IDS", 1)  # too many to send
        assert sorted(S.deduplicate(docs).collect()) == sorted(got) and "SortMergeJoin" in plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_pairs_take_two_blocks_at_once(spark, monkeypatch):
    def one_row(batches):
        for batch in batches:
            assert len(batch) == 1
            yield batch

    each = S._each
    monkeypatch.setattr(S, "BLOCK_DOCS", 17)  # several blocks a task
    monkeypatch.setattr(S, "_each", lambda *args: (lambda run: lambda batches: run(one_row(batches)))(each(*args)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 8)
    try:
        assert S.near_pairs(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(2)).count() > 10
        assert spark.conf.get(key) == "8"
    finally:
        spark.conf.set(key, before)


def test_blocks_hold_each_word_once(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.sample([f"w{k}" for k in range(500)], 200))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    frequent = S._frequent(df, "text")
    for often in (None, frequent):
        (data,) = [bytes(r.data) for r in S._blocks(df, "doc_id", "text", often).collect()]
        assert len(data) < 2 * 200 * 200  # bytes a word: 8 before
        block = S._Block(data)
        want = {r.doc_id: r.h for r in df.select("doc_id", S._hashes(F.col("text")).alias("h")).collect()}
        for k, i in enumerate(block.ids.to_pylist()):
            words = block.words[block.off[k] : block.off[k + 1]]
            keys = list(zip(S._often(words, often).tolist(), words.tolist(), strict=True))
            assert keys == sorted(keys) and sorted(words.tolist()) == sorted(want[i])


def test_quality_report_of_a_corpus_with_copies(spark, tmp_path):
    from textloom.plans import quality

    one, other = "A plain sentence about rivers and the towns that lie on their banks today. " * 4, "Nothing else here has these words, which makes this text stand alone now. " * 4
    rows = [(1, one, "en"), (2, one, "en"), (3, other, "en"), (None, other[:-20], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r.doc_id: r for r in quality.quality_scores(spark, str(tmp_path)).collect()}
    assert [scores[k].uniqueness for k in (1, 2, 3)] == [0.0, 0.0, 1.0]
    report = quality.quality_report(spark, str(tmp_path)).first()
    assert report.n == len(rows) and abs(report.mean - sum(r.overall for r in scores.values()) / len(rows)) < 2e-6
    assert report.least == min(r.overall for r in scores.values())
    assert {(r.severity, r.n) for r in quality.quality_issues(spark, str(tmp_path)).collect() if r.type == "uniqueness"} == {("high", 2)}


def test_lda_counts_words_in_shuffle_partitions(spark, monkeypatch):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    seen = []
    fit = LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: seen.append(df) or fit(self, df))
    texts = [(i, " ".join(f"{'abcde'[k % 5]}{'xyz'[k % 3]}word{'lmn'[(i + k) % 3]}" for k in range(i % 17 + 3))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()
    got = A.topics_lda(docs, k=2, iterations=2)
    assert got.count() == len(texts) and all(abs(sum(r.weights) - 1) < 1e-4 for r in got.collect())
    assert "RDD" in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].columns == ["id", "features"]  # the counts, not the texts
    words = docs.select("doc_id", F.split("text", " ").alias("w"))
    want = CountVectorizer(inputCol="w", outputCol="f", vocabSize=1000, minDF=2.0, maxDF=0.8).fit(words).transform(words)
    sums = lambda df, c: sorted((r[0], sorted(r[1].values.tolist())) for r in df.select(*c).collect())
    assert sums(seen[0], ("id", "features")) == sums(want, ("doc_id", "f"))


def test_a_forest_has_few_edges_of_a_family(spark):
    family = [(a, b) for a, b in combinations(range(40), 2)] + [(9, 9), (50, 50), (60, 61), (61, 60)]
    kept = G.forest(spark.createDataFrame(family, "a long, b long").coalesce(1))
    assert kept.count() == 39 + 1 + 1  # a family of n has n * (n - 1) / 2 pairs; components needs fewer than n of them
    assert {r.node: r.root for r in G.components(kept).collect()} == dict.fromkeys(range(40), 0) | {50: 50, 60: 60, 61: 60}


def test_graphs(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 9)]
    got = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("d", "c")], "task string, needs string")
    assert {r.task: r.level for r in G.levels(tasks, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert G.reachable(needs).count() == 6
    with pytest.raises(ValueError):
        G.levels(tasks, needs.union(spark.createDataFrame([("a", "d")], "task string, needs string"))).count()


def test_versions_and_backups(spark, tmp_path):
    at = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    two = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k long, v string")
    W.create_version(one, at, "v1")
    W.create_version(two, at, "v2", parent="v1", tags=["t"])
    W.rollback(spark, at, "v1", "v3")
    assert sorted(map(tuple, W.load_version(spark, at, "v3", verify=True).collect())) == sorted(map(tuple, one.collect()))
    assert W.versions(spark, at).count() == 3 and W.checksum(one) == W.checksum(one.repartition(3)) != W.checksum(two)
    diff = {r.k: (r.change, r.columns) for r in W.version_diff(one, two, "k").collect()}
    assert diff == {2: ("changed", ["v"]), 3: ("removed", []), 4: ("added", [])}
    increment = W.backup_increment(one, two, "k")
    assert sorted(map(tuple, W.restore_increment(one, increment, "k").collect())) == sorted(map(tuple, two.collect()))
    found = W.changes(one, two, "k", "v")
    assert W.update_mode(found, 3) == "FULL" and W.update_mode(found, 100) == "INCREMENTAL"
    assert sorted(map(tuple, W.apply_changes(one, two, found, "k").collect())) == sorted(map(tuple, two.collect()))


def test_buckets_and_fill(spark):
    import hashlib

    df = spark.createDataFrame([(f"doc_{i}", i % 2, i, 10 + i) for i in range(20)], "id string, g int, i int, n long")
    for n in (7, 16):
        assert {r.id: r.b for r in df.select("id", W.hash_bucket(F.col("id"), n).alias("b")).collect()} == {f"doc_{i}": int(hashlib.md5(f"doc_{i}".encode()).hexdigest(), 16) % n for i in range(20)}
    parts = {}
    for r in W.fill(df, "g", "i", "n", 50).collect():
        parts.setdefault((r.g, r.part), []).append(10 + r.i)
    assert all(sum(v) <= 50 or len(v) == 1 for v in parts.values())
    assert [r.b for r in spark.sql("SELECT TIMESTAMP '2021-01-03' AS t").select(W.date_bucket(F.col("t"), "week").alias("b")).collect()] == ["2021-W53"]


def test_rules_can_be_added(spark):
    V.register("own", "INFO", "has an x", lambda t: F.contains(t, F.lit("x")))
    try:
        docs = spark.createDataFrame([(1, "ax bcdefghijk"), (2, "abcdefghijkl"), (2, None)], "doc_id long, text string")
        got = {(r.id, r.rule, r.what) for r in V.issues(docs).collect()}
    finally:
        V.unregister("own")
    assert got == {(1, "own", "has an x"), (2, "consistency", "duplicate id"), (2, "completeness", "missing text")}
    assert V.summary(V.issues(docs)).first().valid is False


def test_sql_text():
    assert Q.select("s.t", ["a", "t.b"], "x = 1", ["a"], "n > 1", "a", 5, 10, True) == 'SELECT DISTINCT "a", "t"."b" FROM "s"."t" WHERE x = 1 GROUP BY "a" HAVING n > 1 ORDER BY a LIMIT 5 OFFSET 10'
    assert Q.select("t", limit=5, offset=10, dialect="mysql").endswith(" LIMIT 10, 5")
    assert Q.insert("t", ["k", "v"], "update") == 'INSERT INTO "t" ("k", "v") VALUES (:k, :v) ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"'
    assert [Q.literal(x) for x in (None, True, 1.5, "it's")] == ["NULL", "TRUE", "1.5", "'it''s'"]
    assert len(Q.create_table("t", [{"name": "k", "type": "BIGINT", "nullable": False}], ["k"], indexes=[{"name": "i", "columns": ["k"], "unique": True}])) == 2


def test_as_of_takes_the_latest(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', 5, 1), ('a', 1, 2), ('b', 9, 3) t(u, t, id)")
    right = spark.sql("SELECT * FROM VALUES ('a', 2, 'x'), ('a', 5, 'y'), ('a', 5, 'z'), ('b', 10, 'w') t(u, t, v)")
    assert {r.id: r.last_v for r in R.as_of(left, right, "u", "t", ["v"]).collect()} == {1: "z", 2: None, 3: None}


def test_alerts_cool_down(spark, tmp_path):
    rows = [("m", f"2024-01-01 00:{k:02d}:00", float(v)) for k, v in enumerate([1, 9, 9, 1, 9, 1, 1])]
    df = spark.createDataFrame(rows, "event_type string, t string, value double").select("event_type", F.to_timestamp("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    got = ST.drain(ST.alerts(ST.follow(spark, str(tmp_path / "events")), "value", lambda v: v > 5, 120)).orderBy("ts").collect()
    assert [(r.ts.minute, r.state) for r in got] == [(1, "fired"), (3, "resolved"), (4, "fired"), (5, "resolved")]


def test_logs(spark):
    df = spark.createDataFrame([('1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.1" 200 1234 "-" "agent"',), ('1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "POST /b" 201 -',), ("junk",)], "l string")
    got = [r.p for r in df.select(ST.parse_log(F.col("l")).alias("p")).collect()]
    assert (got[0].status, got[0].size, got[0].agent, got[1].size, got[2]) == (200, 1234, "agent", None, None) and got[0].ts.hour == 13
    j = spark.createDataFrame([('{"@timestamp": "2024-01-01T00:00:00Z", "level": "WARN", "msg": "m"}',), ("raw",)], "l string").select(ST.parse_log(F.col("l"), "json").alias("p")).collect()
    assert (j[0].p.level, j[0].p.message, j[1].p.message) == ("WARN", "m", "raw")


def test_feed_and_sources(spark):
    xml = b"<rss><channel><item><guid>1</guid><title>a</title><pubDate>2024-01-01</pubDate><description>x</description></item><item><guid>2</guid><title>b</title><pubDate>2024-02-01</pubDate></item></channel></rss>"
    assert D.feed(xml, "2024-01-15") == [("2", "b", "2024-02-01", "")]
    assert D.several({"a": lambda: spark.range(1), "b": lambda: 1 / 0})["b"] is None
    with pytest.raises(ValueError):
        D.jdbc(spark, "jdbc:x")


def test_fill_against_a_loop(spark):
    import random

    from textloom.operators import warehouse as W

    rng = random.Random(3)
    rows = [(k, "ab"[rng.random() < 0.2], rng.choice([0, 0, 1, 5, 9, 30, 70, 150])) for k in range(600)] + [(1000 + k, "c", 0) for k in range(5)] + [(2000, "d", 500)]
    want = {}
    for by in "abcd":
        part = held = 0
        for k, b, n in rows:
            if b == by:
                if held and held + n > 100:
                    part, held = part + 1, 0
                held += n
                want[k] = part
    df = spark.createDataFrame(rows, "k long, b string, n long")
    for tasks in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            got = {r.k: r.part for r in W.fill(df.repartition(5), "b", "k", "n", 100).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want, tasks


def test_trailing_sums_run_on(spark):
    rows = [(k, "ab"[k % 3 == 0], None if k % 7 == 0 else k * 60 + k % 5, None if k % 11 == 0 else float(k * 37 % 101)) for k in range(400)] + [(1000, "a", 6000, 1.0), (1001, "a", 6000, 2.0)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, s long, value double").select("event_id", "event_type", F.timestamp_seconds("s").alias("ts"), "value")
    got = ST.trailing(df)
    for r in got.collect():
        _, kind, at, _ = next(x for x in rows if x[0] == r.event_id)
        own = [v for _, k, s, v in rows if k == kind and (s is None if at is None else s is not None and at - 3600 <= s <= at)]
        v = [x for x in own if x is not None]
        assert (r.n, r.least, r.most, r["mean"]) == (len(own), min(v), max(v), pytest.approx(sum(v) / len(v), abs=1e-6))
    assert got.count() == len(rows)
    assert "-3600000000" not in got._jdf.queryExecution().executedPlan().toString()  # no frame that is read again for each row


def test_words_are_counted_within_a_document(spark):
    from textloom.operators import analytics

    docs = spark.createDataFrame([(1, "bb aa bb cc " + "zz yy xx ww vv uu " * 3), (1, "cc"), (2, "aa aa bb"), (None, "dd dd"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.word, r.n) for r in analytics.frequent_words(docs, 2, 0.5).collect()}
    assert got == {(1, "bb", 2), (1, "cc", 2), *((1, w, 3) for w in ("zz", "yy", "xx", "ww", "vv", "uu"))}
    plan = analytics.topic_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan and [tuple(r) for r in analytics.topic_words(spark.createDataFrame([("cat dog cat cat dog owl",), ("dog dog",), ("cat",)], "text string"), 1, 2).collect()] == [(0, "dog", 4), (0, "cat", 3)]


def test_bounds_without_gathering_values(spark, tmp_path):
    from textloom.plans import relational

    rows = [("A", k % 50, float(k)) for k in range(1000)] + [("B", 1, 5.0), ("C", 2, 1.0), ("C", 3, 2.0), ("C", None, None), ("N", 1, 1.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = relational.agg_approximate_bounds(spark, str(tmp_path))
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for flag in "ABCN":
        v = sorted(p for f, _, p in rows if f == flag and p is not None)
        q = lambda s, v=v: v[int(s * (len(v) - 1))] + (s * (len(v) - 1) % 1) * (v[min(int(s * (len(v) - 1)) + 1, len(v) - 1)] - v[int(s * (len(v) - 1))])
        est = [v[max(0, -(-round(s * len(v) * 10) // 10) - 1)] for s in (0.1, 0.5, 0.9)]
        want[flag] = all(q(lo) <= x <= q(hi) for x, (lo, hi) in zip(est, ((0.09, 0.11), (0.49, 0.51), (0.89, 0.91)), strict=True))
    assert {r.l_returnflag: (r.parts, r.prices) for r in got.collect()} == {k: (True, v) for k, v in want.items()}
