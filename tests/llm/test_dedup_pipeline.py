"""Near duplicates against brute force; the pipeline against the same stages in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.helpers import edited, frame, odd_rows, prose
from tests.llm.test_map_operators import brute_spans, secrets
from textloom.llm import bpe, decontamination, secret_scan, toxicity
from textloom.llm import simhash_dedup as S


def prints(texts):
    found = {i: S.sums(t) for i, t in texts if t and i is not None}
    return {i: S.to_lanes((x > 0)[None])[0] for i, x in found.items() if x is not None}


def brute_pairs(texts):
    p = {i: int.from_bytes(x.astype(">u8").tobytes()) for i, x in prints(texts).items()}
    ids = sorted(p)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (p[a] ^ p[b]).bit_count() <= S.DISTANCE]


def groups_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root) if find(x) != x}


def corpus(seed, n=120):
    rng = random.Random(seed)
    docs = []
    for _ in range(n):
        base = prose(rng, rng.randrange(60, 300))
        docs.append(base)
        if rng.random() < 0.4:
            docs += [edited(rng, base, rng.choice((0, 0.01, 0.03, 0.05))) for _ in range(rng.randrange(1, 5))]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_words_and_sums(monkeypatch):
    rng = random.Random(6)
    texts = ["", " ", "one", "one two One TWO", "x" * 200 + " y", "a_b c-d İstanbul ẞ 漢字 x²", prose(rng, 400), "!" * 100 + "end"]
    whole = [S.word_hashes(t) for t in texts]
    for t, h in zip(texts, whole, strict=True):
        words = re.findall(r"\w+", t.lower())
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        assert len({*zip(h.tolist(), words, strict=True)}) == len(set(words))
    monkeypatch.setattr(S, "BLOCK", 16)
    assert all(np.array_equal(S.word_hashes(t), h) for t, h in zip(texts, whole, strict=True))
    n = Counter(re.findall(r"\w+", texts[6]))
    total = np.zeros(S.BITS)
    for w, k in n.items():
        bits = np.unpackbits(S.lanes_of(S.word_hashes(w)).astype(">u8").view(np.uint8))
        total += np.rint(16 * (1 + np.log(k))) * (2.0 * bits - 1)
    assert np.array_equal(S.sums(texts[6]), total) and S.sums("?!") is None


@pytest.mark.parametrize("most", [S.MOST, 40])
def test_near_duplicates_against_brute_force(spark, monkeypatch, most):
    """The same groups as all pairs give, with whole cells and with cells cut into blocks."""
    monkeypatch.setattr(S, "MOST", most)
    docs = corpus(1)
    got = {r.doc_id: r.kept_id for r in S.near_duplicates(frame(spark, docs)).collect()}
    want = groups_of(brute_pairs(docs))
    assert {i: k for i, k in got.items() if i != k} == want and want
    kept = S.drop_near_duplicates(frame(spark, docs))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - set(want)


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 400)
    docs = [(i, edited(rng, base, 0.02)) for i in range(300)] + [(1000 + i, base) for i in range(200)] + [(5000 + i, prose(rng, 200)) for i in range(50)]
    got = {r.doc_id: r.kept_id for r in S.near_duplicates(frame(spark, docs)).collect()}
    assert {i: k for i, k in got.items() if i != k} == groups_of(brute_pairs(docs))


def test_bound_and_search():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64 - 1, (500, S.LANES), np.uint64)
    b = a.copy()
    for r in range(500):
        for bit in rng.choice(S.BITS, r % 90, replace=False):
            b[r, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    both = S.Rows(np.concatenate([a, b]))
    exact = np.array([sum(int(x ^ y).bit_count() for x, y in zip(p.tolist(), q.tolist(), strict=True)) for p, q in zip(a, b, strict=True)]) <= S.DISTANCE
    assert np.array_equal(exact, np.arange(500) % 90 <= S.DISTANCE)
    assert np.array_equal(both.near(np.arange(500), np.arange(500, 1000), S.DISTANCE), exact)
    mine = groups_of(S.search(both, np.arange(1000), S.DISTANCE))
    assert all(mine.get(r, r) == mine.get(500 + r, 500 + r) for r in np.flatnonzero(exact))
    u, v = S.forest(1000, S.pairs_within(both, np.arange(1000), S.DISTANCE, np.random.default_rng(0)))
    want = groups_of([(r, 500 + r) for r in np.flatnonzero(exact).tolist()])
    assert len(u) >= 0.75 * len(want) and all(want[x] == y for x, y in zip(u.tolist(), v.tolist(), strict=True))


def test_forest():
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(300 + i, 301 + i) for i in range(90)]
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    u, v = S.forest(400, [(a, b), (a[:5], b[:5])])
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == groups_of([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("n", [10**4, 10**7, 10**8])
def test_recall_by_distance(n):
    """Random pairs that are found by one of the tables, at each part of the allowed range and at its very end, whatever the table's size."""
    rng, grids, k = np.random.default_rng(8), S.layout(n), S.segments_for(S.MOST, S.PARTNERS)
    inner = S.inner_grids(k, S.DISTANCE)
    for d in (20, 32, S.DISTANCE):
        a = rng.integers(0, 2, (1500, S.BITS), np.int8)
        b = a.copy()
        for row in b:
            row[rng.choice(S.BITS, d, replace=False)] ^= 1
        same = a.reshape(1500, -1, S.FINE).sum(axis=2) == b.reshape(1500, -1, S.FINE).sum(axis=2)
        found = np.zeros(1500, bool)
        for segments in grids:
            free = np.setdiff1d(np.arange(S.SEGMENTS), segments)
            left = np.flatnonzero(same[:, segments].all(axis=1) & ~found)
            chosen = np.stack([rng.permutation(free)[:k] for _ in range(inner)])
            found[left] = same[left][:, chosen].all(axis=2).any(axis=1)
        assert found.mean() >= 0.995
        assert abs(found.mean() - S.recall(grids.shape[1], len(grids), d)) < 0.005


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == groups_of([e for e in edges if e[0] != e[1]])


def test_near_duplicates_of_odd_rows(spark):
    docs = frame(spark, odd_rows())
    assert [tuple(r) for r in S.near_duplicates(docs).collect()] == [(5, 4)]
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "6", "7", "8", "None", "None"])
    assert S.near_duplicates(frame(spark, [])).count() == 0 and S.drop_near_duplicates(frame(spark, [])).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    keys, bad = secrets()
    items = [prose(rng, n) for n in (20, 35, 50)]
    docs = [t for _, t in corpus(5, 60)]
    for k in range(40):
        docs.append(prose(rng, 80) + " you stupid clown " + prose(rng, 20) + " utter garbage and filth")
    docs += [f"{prose(rng, 50)} {rng.choice(items)}. {prose(rng, 30)}" for _ in range(12)] + [items[0], f"{prose(rng, 60)} {keys['signed-token']} {prose(rng, 40)}", f'{prose(rng, 60)} {bad["opaque"]}']
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(docs)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("stupid clown" in t)) for i, t in enumerate(docs) if i % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_df, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))

    chain = toxicity.train(docs_df, labels)
    left = [(i, t) for i, t, *_ in rows if t is None or chain.probabilities(chain.row(t)[None])[0, toxicity.REJECTS] <= toxicity.THRESHOLD]
    assert {i for i, t, *_ in rows} - {i for i, _ in left} == {i for i, t in enumerate(docs) if "stupid clown" in t}
    gone = groups_of(brute_pairs(left))
    left = [(i, t) for i, t in left if i not in gone]
    want = {}
    for i, t in left:
        spans = brute_spans(t, items) if t else []
        if spans and sum(b - a for a, b in spans) == len(decontamination.normalise(t)):
            continue
        t = decontamination.cut_out(t, spans) if spans else t
        want[i] = secret_scan.redact(t, unconfirmed=True) if t else t
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocabulary().tokens) if t}, special_tokens={})
    got = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else known.encode_ordinary(t) for i, t in want.items()}
    texts = " ".join(t for t in want.values() if t)
    assert not any(x in texts for x in items) and keys["signed-token"] not in texts


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in each column, empty and long texts, rows that share an id or all they have, and columns with names that the operators use inside."""
    extra = frame(spark, [*odd_rows(), (9, "word"), (5, "word"), (None, "nameless words stay here")])
    at = str(tmp_path / "odd")
    extra.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "!!")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = corpus_pipeline.run(spark, at).collect()
    # of the four rows "word" one is left, of those with the id 5 none; those without an id all stay
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "3", "4", "6", "7", "8", "None", "None", "None"])
    tokens = {r.doc_id: r.tokens for r in got}
    assert tokens[1] is None and tokens[2] == [] and len(tokens[6]) > 60_000
    for name, rows, schema in (("documents", [], "doc_id long, text string"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_ties_among_rows_that_share_an_id(spark):
    """The row that stays doesn't depend on the order in which they come."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "same text", f"s{k}") for k in range(20)] + [(2, "other words", "x")], "doc_id long, text string, source string")
    kept = [S.drop_near_duplicates(d.withColumnRenamed("doc_id", "doc.id"), "doc.id").collect() for d in (df, df.orderBy(F.desc("source")).repartition(3))]
    assert sorted(kept[0]) == sorted(kept[1]) and len(kept[0]) == 2


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, f"{prose(random.Random(i), 40)}", "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, part in (("documents", df), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        part.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == df.dtypes and out.count() == docs.count()
    assert "tokens" in corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).columns


@pytest.mark.parametrize("name", ["op1_fingerprints", "op8_simhash_dedup"])
def test_queries_are_registered(name):
    import __spark_entry__ as e

    assert name in e.queries() and "pipeline" in e.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()}
