"""Text, quality, annotation and format functions on small literal rows, nulls and empty texts among them."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import annotate as A
from textloom.functions import lexicons as L
from textloom.functions import quality as Q
from textloom.functions import text as T
from textloom.operators import segments as S
from textloom.sources import files, formats, markup


def ask(spark, f, *texts):
    """f(text) of each text, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.r for r in df.select("i", f(F.col("text")).alias("r")).orderBy("i").collect()]


def test_normalise(spark):
    a, b, c, d = ask(spark, T.normalise, "“ﬁne”\x07  text\r\n\r\n\r\n\r\nend ", "plain", None, "")
    assert a.text == '"fine" text\n\nend' and a.corrections == ["unicode", "control", "quotes", "whitespace"]
    assert b.corrections == [] and b.score == 1.0 and c is None and d.text == ""
    assert ask(spark, T.unicode_form("NFKC"), "ﬀ①", None) == [unicodedata.normalize("NFKC", "ﬀ①"), None]
    assert ask(spark, T.punctuation, "a…b—c•d″") == ["a...b-c*d''"]


def test_ocr(spark):
    assert ask(spark, T.ocr_words, "Tlie cat ancl tne dog, witli tnis. arid", "mutlien") == ["The cat and the dog, with this. and", "mutlien"]
    assert ask(spark, T.ocr_lines, "ab\ncd", "ab\nCd", "x.\nY", "a\n\nb") == ["abcd", "ab Cd", "x. Y", "a\n\nb"]
    assert ask(spark, T.ocr_rejoin, "ex ample", "th ing", "the thing", "con gratulationsabcd") == ["example", "thing", "the thing", "con gratulationsabcd"]
    assert ask(spark, T.ocr, "", None)[0].score == 1.0


def test_cleaning_rules(spark):
    assert ask(spark, lambda t: T.rewrite(t, T.PII), "me@x.org 555-123-4567 (555) 123-4567 123-45-6789 4111 1111 1111 1111") == ["[EMAIL] [PHONE] [PHONE] [SSN] [CREDIT_CARD]"]
    assert ask(spark, lambda t: T.rewrite(t, T.CODE_SECRETS), 'api_key = "abc" x://u:p@h') == ["api_key = [REDACTED] x://[REDACTED]@h"]
    assert ask(spark, lambda t: T.rewrite(t, T.TEXT_NOISE), "Page 1 of 9\nkeep\n12\n") == ["\nkeep\n\n"]
    assert ask(spark, T.repeated_paragraphs, "A paragraph that is long enough.\n\nb\n\na  PARAGRAPH that is long enough.\n\nb") == ["A paragraph that is long enough.\n\nb\n\nb"]
    assert ask(spark, T.snake_case, "camelCase Name!", "__x--Y2z") == ["camel_case_name", "x_y2z"]
    assert ask(spark, T.is_placeholder, " N/A ", "value", None) == [True, False, None]
    assert ask(spark, lambda t: T.boilerplate_lines(t, [T.keyword_pattern("offer")]), "an offer\nto offend\nan offer too") == ["to offend\nan  too"]
    assert ask(spark, lambda t: T.positions(t, "aa"), "aaa", "xaax", "", "a") == [[0, 1], [1], [], []]


def test_tokens(spark):
    assert ask(spark, T.tokens, "The x Cat's naïve 2nd", "", None) == [["the", "cat"], [], None]
    assert ask(spark, T.sentences, " One. Two?!  Three ", "...") == [["One", "Two", "Three"], []]
    assert ask(spark, T.without_stopwords, "The cat and 12 dogs") == [["cat", "dogs"]]
    assert ask(spark, T.token_count, "Hi, you!") == [4]


def test_quality(spark):
    assert ask(spark, Q.length_score, "x" * 10, "x" * 100, "x" * 1000, "x" * 10_000, "x" * 60_000) == [0.2, 0.5, 1.0, 0.6, 0.7]
    texts = ["abcdefghij" * 4, "abcdefghij" * 3, "so so so", "x" * 9, None]
    pattern = re.compile(r"(.{10,})\1{3,}", re.I | re.M)
    assert [v & 1 for v in ask(spark, Q.repetitions(), *texts)] == [int(bool(pattern.search(t or ""))) for t in texts]
    line = "a line of text that is longer than fifty characters in all"
    assert ask(spark, Q.repetitions(), f"x {line}\n{line} y", f"{line}\nother") == [2, 0]
    assert ask(spark, lambda t: Q.grade(t.cast("double")), "0.95", "0.85", "0.75", "0.65", "0.1") == list("ABCDF")
    assert ask(spark, lambda t: F.size(Q.issues(t)), "short") == [1]
    assert ask(spark, Q.readability_score, "", "The cat sat.")[0] == 0.0


def brute_sentiment(text):
    w = re.findall("[a-z]+", text.lower())
    up = down = 0.0
    for i, x in enumerate(w):
        s = (x in L.POSITIVE) - (x in L.NEGATIVE)
        s *= -0.8 if i > 0 and w[i - 1] in L.NEGATIONS else -0.6 if i > 1 and w[i - 2] in L.NEGATIONS else 1
        s *= L.INTENSIFIERS.get(w[i - 1], 1) if i > 0 else 1
        up, down = up + max(s, 0), down + max(-s, 0)
    return round((up - down) / max(1, len(w)), 6)


def test_sentiment(spark):
    texts = ["A very good day", "not good at all", "not very good", "I hate this terrible problem", "plain words", "", "good not bad never so happy extremely sad"]
    got = ask(spark, A.sentiment, *texts)
    assert [g.polarity for g in got] == [brute_sentiment(t) for t in texts]
    assert [g.emotion for g in ask(spark, A.sentiment, "happy and glad", "angry mad rage", "plain", "excited")] == ["joy", "anger", "neutral", "anticipation"]


def test_language_domain_metadata(spark):
    got = ask(spark, A.language, "the cat is in the house and it was on the mat", "der Hund und die Katze sind auf dem Haus", "это и не он как по", "漢字", "", "xyzzy")
    assert [g.language for g in got][:3] == ["en", "de", "ru"] and got[4].language == "unknown" and (got[5].language, got[5].confidence) == ("en", 0.3)
    assert ask(spark, A.domain, "software programming python", "nothing here")[0].domain == "technology"
    m = ask(spark, A.metadata, "Title: A study\nAuthor: Jo Doe\n2021-02-03 https://x.org/a")[0]
    assert (m.author, m.date, m.url, m.title, m.confidence) == ("Jo Doe", "2021-02-03", "https://x.org/a", "A study", 1.0)
    assert [e.label for e in ask(spark, A.entities, "pay $5 to a@b.org")[0]] == ["EMAIL", "MONEY"]


def test_segments(spark):
    df = spark.createDataFrame([(1, "Q: Why? A: Because. Q: How? A: So."), (2, "Task: Add Input: 1 Output: 2"), (3, "User: hi AI: hello"), (4, "no form"), (5, ""), (6, None), (7, "One part. " * 200)], "doc_id long, text string")
    got = {}
    for r in S.training_segments(df).collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.instruction, r.output))
    assert [x[1:] for x in got[1]] == [("Why?", "Because."), ("How?", "So.")] and got[2][0][1:] == ("Add", "2") and got[3][0][0] == "dialogue" and got[4][0][0] == "completion"
    assert 5 not in got and 6 not in got and got[7][0][1] + got[7][0][2] == "One part. " * 200
    chunks = [r.chunk for r in S.token_chunks(df.where("doc_id = 7"), most=30, overlap=6).orderBy("k").collect()]
    assert all(len(re.findall(r"\w+|[^\w\s]", c)) <= 30 for c in chunks) and len(chunks) > 10
    assert ask(spark, lambda t: S.chunks(t, 60), "A first sentence here. A second sentence here. A third sentence here.") == [["A first sentence here. A second sentence here.", "A third sentence here."]]
    with pytest.raises(ValueError):
        S.split(F.col("x"), (0.5, 0.1, 0.1))


def test_formats(spark):
    assert ask(spark, lambda t: formats.chat_instruction(t, F.lit("out"), F.lit("in"), "sys"), "do") == ["<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\ndo\n\nInput: in<|im_end|>\n<|im_start|>assistant\nout<|im_end|>"]
    assert ask(spark, formats.valid_markup, "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\nx", "<|im_start|>other\nx<|im_end|>", "") == [True, False, False, False]
    assert ask(spark, formats.valid_json, '{"a": 1}', "{a") == [True, False]


def test_html_and_markdown(spark):
    page = '<html><head><title>T &amp; U</title><script>var p="</p>";</script></head><body><nav><a href="/n">n</a></nav><h1>Head</h1><p>One<p>Two &lt;3<div class="ad">buy</div><table><tr><th>a<th>b</tr><tr><td>1<td>2</table><img src="i.png" alt="pic"><ul><li>x<li>y</ul></body>'
    title, text, headings, paragraphs, links, images, tables, lists = markup.parse(page)
    assert (title, headings, paragraphs, links, lists) == ("T & U", ["Head"], 2, [], 1)
    assert tables == [[["a", "b"], ["1", "2"]]] and images == [{"src": "i.png", "alt": "pic"}]
    assert text == "Head\nOne\nTwo <3\na\nb\n1\n2\nx\ny"
    assert markup.parse(None) is None and markup.parse("")[0] == "Untitled Document"
    md = "---\nt: 1\n---\n# Head\n\nSome **bold** and [a link](http://x) ![im](y)\n\n- item\n\n```py\ncode\n```\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert ask(spark, markup.markdown_text, md)[0].startswith("Head\n\nSome bold and a link im\n\nitem\n\ncode")
    s = ask(spark, markup.markdown_structure, md)[0]
    assert (s.headings, s.tables, s.lists, s.images, s.links, s.code) == (["Head"], 1, 1, 1, 1, 1)


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"plain", "b.bin": b"%PDF-1.4 x", "c": b'{"a": [1, 2], "b": "x"}', "d.docx": b"PK\x03\x04rest", "e.txt": b"", ".hidden": b"x", "sub/f.md": b"caf\xe9"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r.type for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "txt", "b.bin": "pdf", "c": "json", "d.docx": "docx", "f.md": "markdown"}
    texts = {r.path.rpartition("/")[2]: r.t for r in files.scan(spark, str(tmp_path), ["markdown", "txt"], ignore=["a.*"]).select("path", files.decode(F.col("content")).alias("t")).collect()}
    assert texts == {"f.md": "café"}
    (tmp_path / "t.csv").write_text('First Name;Age\n "Jo;Ann" ; 3\nn/a;\nn/a;\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["first_name", "age"] and [tuple(r) for r in files.clean_rows(df).collect()] == [("Jo;Ann", "3")]
    assert ask(spark, files.json_depth, '{"a": [{"b": "}{"}]}', "1") == [3, 0]
    assert ask(spark, files.clean_json, '{"myKey": "x", "b": "N/A", "c": {"d": null}}', "{bad") == ['{"my_key": "x"}', None]
    assert ask(spark, files.size_of, "10MB", "1.5k", "big") == [10 << 20, 1536, None]
    nested = spark.sql("SELECT named_struct('x', 1, 'y', named_struct('z', 2)) AS a, 3 AS b")
    assert files.flatten(nested).columns == ["a.x", "a.y.z", "b"]


def test_sequence_ratio(spark):
    from textloom.operators.similarity import sequence_ratio

    a, b = "the quick brown fox", "the quick brown box jumps"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sequence_ratio("a", "b")).first()[0] == SequenceMatcher(None, a, b).ratio()


def test_office_files(spark, tmp_path):
    import zipfile

    from textloom.sources import office

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><title>T</title><text>x <tspan>y</tspan></text></svg>')
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04broken")
    got = {r.path.rpartition("/")[2]: r for r in office.extract(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "Head\nOne line\na | b" and got["a.docx"].headings == ["Head"] and got["a.docx"].tables == [[["a", "b"]]]
    assert got["b.svg"].text == "T\nx y" and got["c.docx"].text is None and "Zip" in got["c.docx"].error


def test_filters(spark):
    from textloom.operators import filters

    spans = "array<struct<start: int, end: int, confidence: double>>"
    df = spark.createDataFrame([([(5, 9, 0.9), (0, 6, 0.5), (9, 12, 0.1)],), ([],)], f"s {spans}")
    got = [[tuple(x) for x in r.k] for r in df.select(filters.without_overlap(F.col("s")).alias("k")).collect()]
    assert got == [[(5, 9, 0.9), (9, 12, 0.1)], []]
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "", "en", "s"), (3, None, "de", "t")], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in filters.documents(docs, "en", words=(0, 0)).collect()] == [2]
    assert filters.documents(docs).count() == 3 and filters.long_enough(docs, 1).count() == 1


def test_patterns_mean_what_they_mean_in_sql(spark):
    import duckdb

    from textloom.plans.annotation import METADATA_SQL

    texts = ["Éby Thin Gsab then by Other Name", "x\x85by Jo Doe\u2028title: no line\nend", "# A\x0bhead line\nby\x0bJo Doe", "url:\thttps://a.b/\x0bc d", "link: x\r\nAuthor: Jo Doe\r\ndone", ""]
    want = duckdb.sql(f"WITH documents AS (SELECT unnest(range({len(texts)})) AS doc_id, unnest($1) AS text) {METADATA_SQL} ORDER BY doc_id", params=[texts]).fetchall()
    assert [tuple(m) for m in ask(spark, A.metadata, *texts)] == [r[1:] for r in want]


def test_html_title_as_sql_has_it(spark):
    pages = ["<title>a &lt;b&gt;\n &amp;amp; c&&amp</title>", "<TITLE> </TITLE><h1>Head</h1>", "<title>one</title><title>two</title>", "<h1>x</h1>", None]
    assert ask(spark, markup.html_title, *pages) == ["a <b> &amp; c&&amp", "Untitled Document", "one", "Untitled Document", "Untitled Document"]


def test_arrow_functions_take_few_rows_at_a_time():
    import pyarrow as pa

    from textloom.operators.lineage import sliced

    made = []
    make = lambda part: made.append(part.num_rows) or part
    small, long = (pa.RecordBatch.from_pydict({"text": [x] * 300}) for x in ("a", "a" * 500_000))
    assert sum(b.num_rows for b in sliced(make)([small, long])) == 600 and max(made) <= 64 and made[-1] <= 2


def test_segments_and_pages_keep_rows(spark):
    texts = spark.createDataFrame([(k, None if k % 9 == 0 else "" if k % 9 == 1 else f"Q: what {k}? A: this" if k % 2 else f"plain {k}") for k in range(500)], "doc_id int, text string").coalesce(1)
    rows = S.training_segments(texts).collect()
    assert {r.doc_id for r in rows} == {k for k in range(500) if k % 9 > 1}
    assert all((r.kind, r.output) == (("qa", "this") if r.doc_id % 2 else ("completion", f"plain {r.doc_id}")) for r in rows)
    pages = markup.pages(texts.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text", F.lit("<table><tr><td>x</table><img src=a>")).alias("html")))
    got = {r.page_id: r for r in pages.collect()}
    assert len(got) == 500 and got[9].lists is None and got[2].tables == [[["x"]]] and got[2].images[0].asDict() == {"src": "a", "alt": ""} and got[2].paragraphs == 1
