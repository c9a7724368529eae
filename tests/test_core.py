"""Operators of the core on small frames, against plain Python."""

import pytest
from pyspark.sql import functions as F

from granary.functions.text import ngrams, sentences, shingles, tokens
from granary.operators.blocks import blocks, html_to_text, json_to_text, packed_blocks, packed_by_language
from granary.operators.cleaning import clean_text, cleaned, mojibake_repaired
from granary.operators.dedup import band_links, connected, exact_winners, jaccard_pairs
from granary.operators.graphs import ancestors, levels
from granary.operators.langid import code_switches, identify
from granary.operators.learning import answer_matches, arithmetic_claims, largest_remainder, review_state
from granary.operators.splitting import assign_split, content_components, leaking, repair_leaks
from granary.sources.files import read_json_documents, read_jsonl, read_text_documents, union_unique
from granary.sources.sinks import digest, write_jsonl


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_words_and_shingles(spark):
    assert one(spark, " a b \n c ", tokens) == ["a", "b", "c"]
    assert one(spark, "", tokens) == []
    assert one(spark, "a b c d", lambda c: ngrams(tokens(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: ngrams(tokens(c), 3)) == []
    t = "".join(chr(97 + i % 26) for i in range(50))
    assert one(spark, t, shingles) == list(dict.fromkeys(t[i : i + 24] for i in range(0, 27, 8)))
    assert one(spark, None, shingles) == []
    assert one(spark, "One two. THREE four!\nab", sentences) == ["one two.", "three four!"]


def test_cleaning(spark):
    assert one(spark, "x<br/>y {{t}} [[a|b]] [u](http://v) https://w.com z​\r\n\r\n\r\n\r\nend", clean_text) == "x y b u z\n\nend"
    assert one(spark, None, clean_text) is None
    bad = "हिन्दी".encode().decode("latin-1")
    assert one(spark, bad, mojibake_repaired) == "हिन्दी"
    assert one(spark, "plain", mojibake_repaired) == "plain"


def test_reasons(spark):
    rows = [(1, "short text"), (2, "word " * 60), (3, "same line here\n" * 20), (4, None), (5, "see www.a.com http://b.org " * 10), (6, "x" * 200)]
    got = {r.i: r.reasons for r in cleaned(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got[1] == ["too_short"] and got[2] == [] and "line_repetition" in got[3] and "too_short" in got[4]
    assert "no_punctuation_structure" in got[6]


def test_blocks(spark):
    d = spark.createDataFrame([(1, "a\nb  \n\n\nc\r\n\r\nd"), (2, None), (3, " \n ")], "id int, text string")
    assert [(r.id, r.block_no, r.block) for r in blocks(d, "id", "text").collect()] == [(1, 0, "a\nb"), (1, 1, "c"), (1, 2, "d")]
    chunks = [r.chunk for r in packed_blocks(d, "id", "text", 6, 1).collect()]
    assert chunks == ["a\nb\n\nc", "d"]
    assert one(spark, "<p>a &amp; b</p><script>x</script><div>c</div>", html_to_text).split() == ["a", "&", "b", "c"]
    table = "<table><tr><td>one</td><td>two</td></tr></table><figure>f<figcaption>g</figcaption></figure>"
    assert one(spark, table, html_to_text).split("\n")[0] == "one" and one(spark, table, html_to_text).split() == ["one", "two", "f", "g"]
    for markup, want in (  # malformed markup gives what can be read
        ("a <b>bold</b> c <i>d", "a bold c d"), ("x <!-- <p>hidden</p> --> y", "x  y"), ("<header>kept</header><head><title>t</title></head>z", "keptz"),
        ("a < b and c > d", "a < b and c > d"), ("t <script>never closed", "t"), ("&lt;p&gt; &#2325;&#x916; &copy", "<p> कख ©"), ("<pre>p</pre><param>q", "p\nq"), ("", ""), (None, None),
    ):
        assert one(spark, markup, html_to_text) == want


def test_json_and_languages(spark):
    assert one(spark, '{"bb": "2", "a": "1", "ccc": ["3", {"z": "5", "y": "4"}, 7, null]}', json_to_text).split("\n") == list("12345")
    assert one(spark, "{nope", json_to_text) is None and one(spark, "[1]", json_to_text) == "" and one(spark, None, json_to_text) is None
    rows = [("f", 1, "hi", "a\n\nb"), ("f", 2, "hi", "c"), ("f", 3, "en", "d"), ("f", 4, None, "e"), ("f", 5, None, None), ("f", 6, "hi", "f"), ("g", 1, "en", " ")]
    d = spark.createDataFrame(rows, "k string, o int, l string, t string")
    got = [(r.k, r.run_no, r.l, r.chunk) for r in packed_by_language(d, "k", "o", "l", "t", 8, 1).orderBy("k", "run_no", "chunk_no").collect()]
    assert got == [("f", 0, "hi", "a\n\nb\n\nc"), ("f", 1, "en", "d"), ("f", 2, None, "e"), ("f", 3, "hi", "f")]


def test_first_of_copies_wins(spark):
    d = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, "A b"), (4, None), (5, " ")], "id int, text string")
    got = {r.id: r.winner for r in exact_winners(d, "id", "text").collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: None, 5: None}


def test_near_pairs_and_components(spark):
    base = " ".join(f"word{i} and" for i in range(80))
    d = spark.createDataFrame([(1, base), (2, base + " tail"), (3, "else " * 30), (4, base), (5, None)], "id int, text string")
    assert [(r.a, r.b) for r in jaccard_pairs(d, "id", "text").collect()] == [(1, 2)]
    assert {(r.a, r.b) for r in band_links(d, "id", "text").collect()} >= {(1, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a long, b long")
    got = {r.node: r.root for r in connected(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50}
    assert connected(chain.limit(0)).count() == 0


def test_verified_clusters_equal_brute_force(spark, tmp_path):
    from granary.queries import QUERIES

    rows = []
    for i in range(30):  # pairs of a similarity of 0.8 and little more or less, and a copy
        words = [f"w{i:02}x{j:03}" for j in range(100)]  # a word and its blank are 8 characters, a step of the shingles
        rows += [(f"a{i:02}", " ".join(words)), (f"b{i:02}", " ".join([*words[: 87 + i % 5], *(f"v{i:02}x{j:03}" for j in range(13 - i % 5))])), (f"c{i:02}", " ".join(words).upper())]
    d = spark.createDataFrame([*rows, ("d", None), ("e", " ")], "doc_id string, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    grams = {r.doc_id: set(r.g) for r in d.select("doc_id", shingles(F.lower("text")).alias("g")).collect() if r.doc_id not in "de"}
    want = {}
    for i in range(30):
        a, b = grams[f"a{i:02}"], grams[f"b{i:02}"]
        same = len(a & b) / len(a | b) >= 0.8
        want[f"a{i:02}"] = (3, f"c{i:02}") if same else (2, f"c{i:02}")
    assert {n for n, _ in want.values()} == {2, 3}
    got = {r.root: (r.members, r.last_doc) for r in QUERIES["near_duplicate_clusters"](spark, str(tmp_path)).collect()}
    assert got == want
    low = {r.root: r.least_similarity for r in QUERIES["near_duplicate_clusters"](spark, str(tmp_path)).collect()}
    assert all(0.8 <= v <= 1.0 and (v < 1.0) == (want[k][0] == 3) for k, v in low.items())


def test_no_component_straddles(spark):
    rows = [(i, f"This is sentence {i // 3} of many. Own part {i}.", "en") for i in range(60)]
    d = spark.createDataFrame(rows, "id int, text string, lang string")
    parts = content_components(d, "id", "text")
    assert parts.select("component").distinct().count() == 20
    split = assign_split(parts.join(d, "id"), "lang", 0.1, 1)
    assert split.count() == 20 and 6 <= split.where("split = 'val'").agg(F.sum("docs")).first()[0] <= 9


def test_repair_moves_and_never_deletes(spark):
    shared = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(1, shared, "train"), (2, shared + " ten", "val"), (3, "other words " * 6, "val")], "id int, text string, split string")
    assert [r.id for r in leaking(d, "id", "text", "split", 8, F.col("split") != "train").collect()] == [2]
    got = {r.id: r.split for r in repair_leaks(d, "id", "text", "split", "id").collect()}
    assert got == {1: "train", 2: "train", 3: "val"}


def test_language_rules(spark):
    rows = [("यह किताब है और वह नहीं है", "hi"), ("हे पुस्तक आहे आणि ते नाही", "mr"), ("kya yaar tum kal ghar nahi gaya", "hinc-latn"), ("the cat sat on a mat", "en"), ("12 34", "unknown")]
    for text, want in rows:
        assert one(spark, text, lambda c: identify(c, F.lit(None).cast("string"))) == want
    assert one(spark, "कल meeting है laptop लाना", code_switches) is True


def test_graphs(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "node string, needs string")
    assert {(r.node, r.ancestor) for r in ancestors(e).collect()} == {("c", "b"), ("c", "a"), ("b", "a"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    n = spark.createDataFrame([(c,) for c in "abcxy"], "node string")
    assert {r.node: r.level for r in levels(n, e).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_learning(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 9, 0.1), ("b", 5, 0.6)], "k string, day int, p double")
    assert {r.k: (r.stage, r.due_day, r.reviews) for r in review_state(d, "k", "day", "p").collect()} == {"a": (0, 10, 3), "b": (0, 6, 1)}
    q = largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int"), "k", "w", 10)
    assert {r.k: r.share for r in q.collect()} == {"a": 4, "b": 3, "c": 3}
    claims = arithmetic_claims(spark.createDataFrame([(1, "0.1 + 0.2 = 0.3, 1/0 = 0")], "id int, text string"), "id", "text")
    assert {r.claim: r.holds for r in claims.collect()} == {"0.1 + 0.2 = 0.3": True, "1/0 = 0": None}
    m = spark.createDataFrame([("The Cat.", "the cat", "exact", None), ("about 3.01", "3", "numeric", 0.05), ("b, a", "a; b", "set", None), ("x", None, "exact", None), ("x", "x", "manual", None)], "a string, e string, m string, t double")
    assert [r[0] for r in m.select(answer_matches(F.col("a"), F.col("e"), F.col("m"), F.col("t"))).collect()] == [True, True, True, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "text": "x"}\n\n{"doc_id": "2"}\n')
    assert read_jsonl(spark, str(tmp_path / "a.jsonl")).where("doc_id IS NOT NULL").count() == 2
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "l.json").write_text('{"documents": [{"doc_id": "1"}, {"doc_id": "2"}]}')
    assert read_json_documents(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "t.txt").write_text("one\n\ntwo\nlines\n")
    assert {r.doc_id: r.text for r in read_text_documents(spark, str(tmp_path / "t.txt")).collect()} == {"t:0": "one", "t:1": "two\nlines"}
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert write_jsonl(d, str(tmp_path / "out")) == digest(d.orderBy(F.desc("id")))
    with pytest.raises(Exception):
        union_unique([d, d], "id").collect()
    assert union_unique([d, spark.createDataFrame([(3,)], "id int")], "id").count() == 3


def test_every_query_has_rows_or_is_known(spark):
    from granary.queries import ORACLE, QUERIES

    assert len(QUERIES) > 60 and set(ORACLE) <= set(QUERIES)
    for name in ("clean_quality_reasons", "ledger_latest", "sample_quotas", "window_starts", "ngram_overlap"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
