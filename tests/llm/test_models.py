"""PII, toxicity, BPE: held-out accuracy, gradients, exact round trips."""

import random
from itertools import combinations

import numpy as np
import pytest
import tiktoken

from tests.llm.helpers import frame, odd_rows, prose
from textloom.llm import bpe as B
from textloom.llm import pii as P
from textloom.llm import toxicity as X

# 5 PII


@pytest.fixture(scope="module")
def tagger():
    return P.train()


def test_pii_gradients():
    rng = np.random.default_rng(0)
    model = P.Tagger.start(3, hidden=3)
    for name in ("given", "cell", "out", "bias", "move", "first", "last"):
        setattr(model, name, getattr(model, name).astype(np.float64) + 0.05 * rng.standard_normal(getattr(model, name).shape))
    x, y = rng.integers(0, P.CLASSES, (2, 5)), rng.integers(0, P.TAGS, (2, 5))
    _, grads = model.learn(x, y)
    for p, g in zip(model.parts(), grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            was = p[at]
            p[at] = was + 1e-2
            up = model.learn(x, y)[0]
            p[at] = was - 1e-2
            down = model.learn(x, y)[0]
            p[at] = was
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_pii_viterbi_is_the_best_path():
    from itertools import product

    model = P.Tagger.start(4)
    x = np.random.default_rng(1).integers(0, P.CLASSES, (1, 3))
    scores, _ = model.run(x)
    worth = lambda y: model.first[y[0]] + model.last[y[-1]] + sum(scores[0, i, t] for i, t in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))
    assert tuple(model.best(x)[0]) == max(product(range(P.TAGS), repeat=3), key=worth)


def test_pii_fast_scores_are_the_networks(tagger):
    x = np.random.default_rng(2).integers(0, P.CLASSES, (9, 70)).astype(np.int16)
    assert np.allclose(tagger.run(x)[0].transpose(1, 2, 0), tagger.scores(x), atol=1e-3)


def brute_viterbi(model, codes):
    scores = model.run(codes[None])[0][0].astype(np.float64)
    at, back = model.first + scores[0], []
    for row in scores[1:]:
        step = at[:, None] + model.move
        back.append(step.argmax(0))
        at = step.max(0) + row
    y = [int((at + model.last).argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return y[::-1]


def worth(spans, rooms):
    return sum(1 + P.OVERLAP * rooms[s] for s in spans), sum(b - a for a, b, _ in spans)


def brute_reconcile(found):
    """The best of all sets of disjoint spans, by its worth."""
    rooms = {}
    for a, b, k, room, _ in found:
        rooms[a, b, k] = max(rooms.get((a, b, k), 0), room)
    sets = (c for n in range(len(rooms) + 1) for c in combinations(sorted(rooms), n))
    return max((worth(c, rooms) for c in sets if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))), default=(0, 0)), rooms


def test_pii_reconciliation_is_the_best_set():
    rng = random.Random(3)
    for _ in range(300):
        found = []
        for w in range(rng.randrange(7)):
            a = rng.randrange(40)
            found.append((a, a + rng.randrange(1, 12), rng.randrange(2), rng.randrange(1, 9), w))
        best, rooms = brute_reconcile(found)
        assert worth(P.reconcile(found), rooms) == best
    # cut off on both sides of an edge, and seen whole by another window
    assert P.reconcile([(5, 10, 0, 0, 1), (10, 14, 0, 0, 2)]) == [(5, 14, 0)]
    assert P.reconcile([(5, 10, 0, 0, 1), (10, 14, 0, 0, 2), (5, 14, 0, 7, 3)]) == [(5, 14, 0)]


def test_pii_query_against_brute_force(spark, tagger):
    rng = random.Random(4)
    lines = [t for t, _ in P.labelled(40, 77)]
    texts = ["\n".join(rng.sample(lines, rng.randrange(1, 9))) for _ in range(25)] + [prose(rng, 500), "", None, "jo.12@mail3.example.com " * 60]
    docs = frame(spark, [*enumerate(texts), (3, texts[3]), (None, texts[0])])
    want = []
    for i, t in [*enumerate(texts), (3, texts[3]), (None, texts[0])]:
        found = []
        for w, (a, b) in enumerate(P.windows(0, len(t)) if t else []):
            y = [0, *brute_viterbi(tagger, P.classes(t[a:b])), 0]
            edges = [k for k in range(1, len(y)) if y[k] != y[k - 1]]
            for s, e in zip(edges, edges[1:]):
                if y[s]:
                    found.append((a + s - 1, a + e - 1, y[s] - 1, min(P.WINDOW if a == 0 else s - 1, P.WINDOW if b == len(t) else b - a - e + 1), w))
        want += [(i, P.KINDS[k], a, b - a) for a, b, k in P.reconcile(found)]
    got = [tuple(r) for r in P.find_pii(docs, tagger).select("doc_id", "kind", "start", "length").collect()]
    assert len(want) > 60 and len(set(got) ^ set(want)) <= 0.02 * len(want)  # padding behind a shorter window moves a score now and then
    assert sum(i == 3 for i, *_ in got) % 2 == 0


def test_pii_held_out(tagger):
    rows = P.labelled(800, 999)
    found = P.tag(tagger, [t for t, _ in rows])
    right = sum(len(set(f) & set(g)) for f, (_, g) in zip(found, rows, strict=True))
    assert right / sum(map(len, found)) >= 0.98 and right / sum(len(g) for _, g in rows) >= 0.98


#: Written by hand, not by the generator: text, spans.
LINES = [
    ("Please write to info@kiosk.shop before Friday.", ["info@kiosk.shop"]), ("Contact: maria.lopez-garcia@correo.empresa.mx (sales)", ["maria.lopez-garcia@correo.empresa.mx"]), ("The gateway 10.0.0.1 answers, the server at 192.168.1.20 does not.", ["10.0.0.1", "192.168.1.20"]),
    ("Call 020 7946 0958 during office hours", ["020 7946 0958"]), ("Tel. 0171 2345678, Fax 0171 2345679", ["0171 2345678", "0171 2345679"]), ("ISBN 978-3-16-148410-0, 2nd edition, 2019, pp. 12-48.", []), ("Her social security number is 078-05-1120.", ["078-05-1120"]),
    ("IBAN: DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("Transfer to GB29NWBK60161331926819 by Monday.", ["GB29NWBK60161331926819"]), ("Visa 4111 1111 1111 1111 exp 12/27", ["4111 1111 1111 1111"]), ("card no. 5500000000000004; amount $1,299.00", ["5500000000000004"]),
    ("Version 2.10.3 was released on 2024-03-18 at 14:05:22.", []), ("See https://docs.python.org/3/library/re.html#re.match for details", []), ("+49 30 901820 is the number of the town hall", ["+49 30 901820"]), ("Ring me on +1 (415) 555-2671 or email bob@example.com!", ["+1 (415) 555-2671", "bob@example.com"]),
    ("The population grew from 1,204,000 in 1990 to 3,400,250 in 2010.", []), ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixes #1234", []), ("In 1066 the Normans, led by William, crossed the Channel.", []), ("Order 4503599627 shipped; tracking 1Z999AA10123456784", []),
    ("jean-pierre.dupont@univ-lyon1.fr, 04 72 44 80 00", ["jean-pierre.dupont@univ-lyon1.fr", "04 72 44 80 00"]), ("My email is anna_k92@mail.ru and hers is olga@yandex.ru.", ["anna_k92@mail.ru", "olga@yandex.ru"]), ("3.14159 times 2 is 6.28318", []), ("Room B-204, floor 2, 10:30-11:45", []),
    ("import os; print(os.environ['HOME']) # TODO @alice", []), ("call (212) 555-0147 ext. 9", ["(212) 555-0147"]), ("from 8.8.8.8 to 1.1.1.1 in 12 ms", ["8.8.8.8", "1.1.1.1"]), ("Amex 3782 822463 10005", ["3782 822463 10005"]), ("Section 4.2.1.3 describes the protocol", []),
    ("Привет, мой адрес ivan.petrov@example.com, звоните +7 495 123-45-67", ["ivan.petrov@example.com", "+7 495 123-45-67"]), ("a@b is not an address, nor is @handle or user@", []),
]


def test_pii_of_lines_written_by_hand(tagger):
    found = [[t[a:b] for a, b, _ in f] for (t, _), f in zip(LINES, P.tag(tagger, [t for t, _ in LINES]), strict=True)]
    right = sum(len(set(f) & set(g)) for f, (_, g) in zip(found, LINES, strict=True))
    assert right / sum(map(len, found)) >= 0.8 and right / sum(len(g) for _, g in LINES) >= 0.7


def test_pii_leaves_prose_alone(tagger):
    rng = random.Random(5)
    texts = [prose(rng, 400) for _ in range(40)] + ["ünïcödé 漢字 \U0001f600 " * 100, "слово и слово " * 80]
    assert sum(map(len, P.tag(tagger, texts))) <= 1


def test_pii_learns():
    x, y = P.samples(P.labelled(200, 6), 64, 1)
    loss = [P.fit(P.labelled(1500, 5), ((n, 64, 64),)).learn(x, y)[0] for n in (0, 3)]
    assert loss[1] < 0.5 * loss[0]


def test_pii_windows_cover_and_agree(tagger):
    for a, b in ((0, 1), (0, 64), (5, 133), (0, 513), (0, 2000)):
        w = P.windows(a, b)
        assert w[0][0] == a and w[-1][1] == b and all(y[0] == x[0] + P.WINDOW - P.OVERLAP for x, y in zip(w, w[1:])) and all(e - s <= P.WINDOW for s, e in w)
    rng = random.Random(2)
    line = lambda k: f"{prose(rng, k)} ann.{k:02d}@mail{k % 10}.example.com "
    text = "".join(line(k) for k in range(1, 60))
    kinds = [text[a:b] for a, b, k in P.tag(tagger, [text])[0] if k == "email"]
    assert sum(x.startswith("ann.") and x.endswith(".com") for x in kinds) >= 57


def test_pii_of_odd_rows(spark, tagger):
    line = "mail jo.12@mail3.example.com or call +1 (212) 555-0199 now"
    long = prose(random.Random(7), 30_000)
    docs = frame(spark, [*odd_rows(), (9, line), (10, line), (10, line), (11, f"{long} {line}"), (None, line), (12, f"ünïcödé 漢字 \U0001f600 {line}")])
    got = sorted((r.doc_id or 0, r.kind, r.start, r.length) for r in P.find_pii(docs, tagger).where("doc_id IS NULL OR doc_id > 8").collect())
    one = lambda i, at: [(i, "email", at + 5, 23), (i, "phone", at + 37, 17)]
    assert got == sorted(one(0, 0) + one(9, 0) + 2 * one(10, 0) + one(11, len(long) + 1) + one(12, 13))
    assert P.find_pii(docs, tagger).where("doc_id < 6").count() == 0 and P.find_pii(frame(spark, []), tagger).count() == 0
    masked = P.mask_pii(docs, tagger)
    assert masked.columns == docs.columns and masked.count() == docs.count() and masked.where("text IS NULL").count() == 2
    assert masked.where("doc_id = 9").first().text == "mail [email] or call [phone] now"


# 6 toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    insults = ["stupid clown", "utter garbage", "filthy liar", "disgusting fool"]
    out = []
    for k in range(n):
        words = prose(rng, 60).split()
        if k % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        low = k % 5 == 0
        if low:
            words += ["click", "here"] * 3
        out.append((" ".join(words), int(low), int(k % 3 == 0)))
    return out


def test_toxicity_held_out():
    chain = X.fit(toxic_rows(400, 1))
    test = toxic_rows(200, 2)
    p = chain.probabilities(np.array([chain.row(t) for t, *_ in test]))
    labels = np.array([X.categories(low, toxic) for _, low, toxic in test])
    assert ((p > X.THRESHOLD) == labels).mean(axis=0).min() >= 0.97
    k = len(chain.weights[0])
    assert [len(w) for w in chain.weights] == [k, k + 1, k + 2]  # later links see the earlier ones
    slow = []
    for t, *_ in test[:20]:
        x, given = chain.row(t).astype(np.float64), []
        for w in chain.weights:
            given.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip([*x, *given], w[:-1], strict=True)) + w[-1]))))
        slow.append(given)
    assert np.allclose(slow, p[:20], atol=1e-4)


def test_toxicity_without_leaks(monkeypatch):
    """Terms that tell a fold's rows apart by chance reach no prediction for that fold: on labels drawn at random, out-of-fold probabilities say nothing."""
    rng = random.Random(9)
    rows = [(prose(rng, 40), rng.randrange(2), rng.randrange(2)) for _ in range(300)]
    monkeypatch.setattr(X, "SURE", 0.5)
    taken = []
    real = X.fit_logistic
    monkeypatch.setattr(X, "fit_logistic", lambda x, y, decay=1.0: taken.append((x, y)) or real(x, y, decay))
    X.fit(rows)
    x, y = next((x, y) for x, y in taken[X.FOLDS + 1 :] if len(y) == len(rows))  # the toxic link's own inputs; the last is the out-of-fold probability of low quality
    low = np.array([low for _, low, _ in rows])
    assert np.corrcoef(x[:, -1], low)[0, 1] < 0.15
    assert len({X.fold_of(t, 5) for t in ("Some words, here", "some WORDS here!")}) == 1


def test_toxicity_query_against_plain_python(spark):
    rows = [*toxic_rows(120, 4), ("", 0, 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - low, toxic) for i, (_, low, toxic) in enumerate(rows) if i % 4], "doc_id long, quality int, toxic int")
    chain = X.train(docs, labels)
    same = X.fit(X.labelled_rows(docs, labels))
    assert sorted(X.labelled_rows(docs, labels)) == sorted((t, low, toxic) for i, (t, low, toxic) in enumerate(rows) if i % 4)
    assert chain.terms == same.terms and all(np.allclose(a, b) for a, b in zip(chain.weights, same.weights, strict=True))
    want = {i for i, (t, *_) in enumerate(rows) if chain.probabilities(chain.row(t)[None])[0, X.REJECTS] > X.THRESHOLD}
    assert {r.doc_id for r in X.toxic_documents(docs, chain).collect()} == want and want


def test_toxicity_of_odd_rows(spark):
    chain = X.fit(toxic_rows(300, 3))
    docs = frame(spark, [*odd_rows(), (9, "you stupid clown what utter garbage"), (9, "you stupid clown what utter garbage")])
    scores = X.score_toxicity(docs, chain)
    assert scores.count() == docs.count() and scores.where("p_toxic IS NULL").count() == 2
    assert {r.doc_id for r in X.toxic_documents(docs, chain).collect()} == {9}
    kept = X.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, frame(spark, odd_rows()).select("doc_id", "text").collect()))
    assert X.drop_toxic(frame(spark, []), chain).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(1, None, 1), (4, 0, None), (None, 1, 0)], "doc_id long, toxic int, quality int")
    assert X.toxic_documents(docs, X.train(docs, labels)).count() == 0


# 7 BPE


def reference():
    v = B.vocabulary()
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens) if t}, special_tokens={})


def test_bpe_is_exact():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(200)) for _ in range(100)]
    texts += ["", " ", "a" * 3000, "ab" * 999, "  \n\n\t x", "don't we'll I'M", "漢字かな \U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(3000)), "".join(rng.choice("aab \n") for _ in range(3000))]
    known, v = reference(), B.vocabulary()
    encoder = B.Encoder(v)
    for part in (texts[:50], texts[40:]):  # the second meets words of the first
        tokens, counts = encoder.encode(part)
        at = np.cumsum([0, *counts])
        assert [tokens[a:b].tolist() for a, b in zip(at, at[1:])] == [known.encode_ordinary(t) for t in part]
        assert B.decode(v, tokens, counts) == [t.encode() for t in part]
    with pytest.raises(IndexError):
        B.decode(v, np.array([v.size]), np.array([1]))


def test_bpe_of_odd_rows(spark):
    docs = frame(spark, odd_rows())
    got = B.encode_documents(docs)
    assert got.count() == docs.count() and got.where("text IS NULL").count() == 0 if "text" in got.columns else True
    n = {r.doc_id: (r.n_tokens, r.exact) for r in got.collect() if r.doc_id}
    assert n[1] == (None, None) and n[2] == (0, True) and all(x[1] for k, x in n.items() if k != 1)
    back = {r.doc_id: r.text for r in B.decode_documents(got).collect() if r.doc_id}
    assert all(back[i] == t for i, t in odd_rows() if i)
    assert B.encode_documents(frame(spark, [])).count() == 0
