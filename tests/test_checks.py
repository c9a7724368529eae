"""Checks, graphs, filters, readers and sinks on small and awkward frames, against plain Python."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.operators.checks import critics, degeneracy, evaluated, exact_value, glob_pattern, language_by_path, path_matches, violations, worst
from granary.operators.dedup import jaccard_pairs, near_duplicates, verified_links
from granary.operators.graphs import ancestors, children, descendants, graph_issues, levels, ready
from granary.operators.langid import guessed, identified, reconciled, script_counts
from granary.operators.learning import bucketed_sample, quotas_of
from granary.operators.membership import exploded, gram_hashes, held_by, key_filter
from granary.operators.splitting import component_edges, leaking_pairs, repair_leaks
from granary.sources.files import read_artifacts, read_json_records, read_latest, read_suites, read_token_stream
from granary.sources.sinks import files_written, write_jsonl, write_sorted, write_token_stream
from granary.streaming.events import run_to_end, windowed_counts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def reasons(spark, text):
    return one(spark, text, lambda c: degeneracy(c, tokens(c)))


def test_degenerate_texts(spark):
    sound = "the quick brown fox jumps over a lazy dog while seven other animals look on from far away"
    assert reasons(spark, sound) == [] and reasons(spark, None) == ["empty"] and reasons(spark, " \n ") == ["empty"] and reasons(spark, "") == ["empty"]
    assert reasons(spark, sound + " go" * 32) == ["run", "repeats", "cycle"]
    assert reasons(spark, sound + " so" * 7 + " end") == []
    cycle = reasons(spark, "once upon a time " + "a b c " * 12)
    assert "cycle" in cycle and "looping" in cycle
    assert "dominance" in reasons(spark, "- - - - - - - - - - - - a b")
    rng = random.Random(2)  # the cycle test against its definition
    for _ in range(40):
        ids = [rng.choice("ab") for _ in range(rng.randint(6, 30))]
        best = 0
        for p in range(1, 17):
            n, reps = len(ids), 0
            while n >= p and ids[n - p : n] == ids[-p:]:
                reps, n = reps + 1, n - p
            best = max(best, reps * p if reps >= 3 else 0)
        assert ("cycle" in reasons(spark, " ".join(ids))) == (best / len(ids) > 0.5)


def test_critics(spark):
    rows = [
        ("t", "A sound and long enough answer.", "yes", "en", None, "ok"), ("t", None, "yes", "en", None, "reject"), ("", "", "", None, None, "reject"),
        ("t", "TODO write this later on", "x", "en", None, "reject"), ("t", "the answer is here somewhere", "Forty  Two", "en", "what is forty two?", "warn"),
        ("t", "यह हिंदी में लिखा है और ठीक है", "a", "en", None, "warn"), ("t", "same words again. same words again. same words again.", "b", "en", None, "warn"),
        ("t", "ગુજરાતીમાં લખેલું લાંબું લખાણ", "c", "gu", None, "ok"),
    ]
    d = spark.createDataFrame(rows, "task string, response string, answer string, language string, prompt string, want string")
    got = d.select("want", worst(critics(*(F.col(c) for c in ("task", "response", "answer", "language", "prompt")))).alias("v")).collect()
    assert all(r.v == r.want for r in got)


def test_violations(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, None, -1), (3, "b", None)], "id int, code string, severity int")  # clashing names
    got = {(r.id, r.code, r.severity) for r in violations(d, "id", {"no_code": F.col("code").isNull(), "negative": F.col("severity") < 0}, {"negative": "warning"}).collect()}
    assert got == {(2, "no_code", "error"), (2, "negative", "warning")}
    assert violations(d.limit(0), "id", {"x": F.lit(True)}).count() == 0


def test_expressions(spark):
    for e, want in (("1 + 2 * 3", 7), ("(1+2)*3", 9), ("2**3**2", 512), ("-2**2", -4), ("1/3 + 1/6", Fraction(1, 2)), ("2**-1", Fraction(1, 2)), ("1,000 × 2 ÷ 5", 400), ("-(3+4)*2", -14), ("10/4/5", Fraction(1, 2))):
        assert exact_value(e) == want
    for e in ("1/0", "2**0.5", "2**65", "3 4", "()", "1-", "a", "", "__import__('os')", "((1)", "1)", "1+" * 300 + "1"):
        assert exact_value(e) is None
    d = spark.createDataFrame([("(1+1)**2",), (None,), ("x",), ("2**64*2**64",)], "e string")
    assert [(r.v.numerator, r.v.denominator) for r in d.select(evaluated("e").alias("v")).collect()] == [("4", "1"), (None, None), (None, None), (str(2**128), "1")]


def test_paths(spark):
    assert glob_pattern("a/*.t?t") == r"^a/.*\.t.t$" and glob_pattern("a.b/**") == r"^a\.b/"
    d = spark.createDataFrame([("raw/hi/a.txt",), ("raw/en/b.html",), ("x",), (None,)], "path string")
    assert [r[0] for r in d.select(path_matches(F.col("path"), ("raw/**",), ("*.html",))).collect()] == [True, False, False, False]
    assert [r[0] for r in d.select(language_by_path(F.col("path"), [("raw/hi/**", "hi"), ("raw/*", "en")], F.lit(None).cast("string"))).collect()] == ["hi", "en", "unknown", "unknown"]


def test_graph_checks(spark):
    n = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 1), ("x", 1), ("y", 1)], "node string, grade int")
    e = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "nowhere"), ("x", "y"), ("y", "x"), ("b", None)], "node string, needs string")
    got = {(r.node, r.code, r.other) for r in graph_issues(n, e, "grade").collect()}
    assert got == {("c", "unknown_dependency", "nowhere"), ("a", "forward_dependency", "c"), ("d", "orphan", None), ("x", "cycle", None), ("y", "cycle", None)}
    assert {(r.node, r.descendant) for r in descendants(e).collect()} >= {("c", "b"), ("nowhere", "b")}
    assert {(r.node, r.child) for r in children(e).collect()} >= {("a", "b"), ("c", "a")}
    started = spark.createDataFrame([("c",), ("y",)], "node string")
    assert {r.node for r in ready(n, e, started).collect()} == {"a", "d", "x"}
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 130)], "node string, needs string")
    assert ancestors(chain).count() == 129 * 130 // 2  # longer than any fixed number of steps
    assert levels(spark.createDataFrame([(f"n{i}",) for i in range(20)], "node string"), chain).agg(F.max("level")).first()[0] == 19
    with pytest.raises(RuntimeError):
        ancestors(chain, rounds=2)
    with pytest.raises(RuntimeError):
        levels(spark.createDataFrame([(f"n{i}",) for i in range(20)], "node string"), chain, rounds=3)


def test_language_verdicts(spark):
    none = F.lit(None).cast("string")
    v = one(spark, "यह किताब है और वह नहीं है", lambda c: identified(c, none))
    assert (v.language, v.method) == ("hi", "script(devanagari)+marker-lexicon(hi)") and 0 < v.confidence <= 0.85
    v = one(spark, "नदी पर्वत वन", lambda c: identified(c, F.lit("mr")))
    assert (v.language, v.method, v.confidence) == ("mr", "script(devanagari)+declared-prior(mr)", 0.4)
    v = one(spark, "a cat sat on its own mat", lambda c: reconciled(c, F.lit("hinc-latn")))
    assert (v.language, v.method) == ("hinc-latn", "script(latin)+declared-prior") and v.confidence == 0.5
    assert one(spark, "a cat", lambda c: reconciled(c, F.lit("hi"))).language == "en"
    assert one(spark, None, lambda c: identified(c, none)).language == "unknown" and one(spark, "", guessed).language == "unknown"
    assert one(spark, "বাংলা লেখা এখানে", guessed).language == "script:bengali"
    assert one(spark, "aक1", script_counts) == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]


def test_filter_keeps_every_key(spark):
    d = spark.createDataFrame([(i, "x" if i % 2 else None, [hash((i, j)) for j in range(i % 5)]) for i in range(200)], "k int, g2 string, g array<bigint>")
    want = d.where("k < 40").select(F.explode("g").alias("g"))
    only = key_filter(want)
    held = {r.g for r in want.collect()}
    got = exploded(d, "g", only)
    assert {r.g for r in got.where("k < 40").collect()} == held and got.columns == d.columns
    assert got.where("k >= 40").count() < 40  # few others pass
    assert exploded(d.limit(0), "g", only).count() == 0 and exploded(d, "g").count() == sum(i % 5 for i in range(200))
    assert not held_by(key_filter(want.limit(0)), __import__("numpy").array([5, -7])).any()
    assert len(one(spark, "a b c d", lambda c: gram_hashes(tokens(c), 3))) == 2


def test_leaks_move_in_rounds(spark):
    rows = [("t", "a b c d e", "train", 1), ("v1", "c d e f g", "val", 2), ("v2", "e f g h i", "val", 3), ("v3", "x y z", "val", 2), ("v4", None, "test", 4), ("v5", "p q r s", "test", 5)]
    d = spark.createDataFrame(rows, "id string, text string, split string, c int")
    got = {r.id: (r.split, r.moved_in) for r in repair_leaks(d, "id", "text", "split", "id", 3).collect()}
    assert got == {"t": ("train", 0), "v1": ("train", 1), "v2": ("train", 2), "v3": ("val", 0), "v4": ("test", 0), "v5": ("test", 0)}
    got = {r.id: r.split for r in repair_leaks(d, "id", "text", "split", "c", 3).collect()}
    assert got["v3"] == "train" and got["v5"] == "test"  # its component moves with v1
    with pytest.raises(RuntimeError):
        repair_leaks(d, "id", "text", "split", "id", 3, rounds=2)
    assert [tuple(r) for r in leaking_pairs(d, "id", "text", "split", 3, F.col("split") != "train").collect()] == [("v1", "t", 1)]
    assert {tuple(r) for r in component_edges(d, "id", "text", 3).collect()} == {("t", "v1"), ("v1", "v2")}


def test_bucketed_sample(spark):
    rows = [(i, "a" if i < 500 else "b" if i < 510 else "c") for i in range(530)] + [(900, None), (901, "other")]
    d = spark.createDataFrame(rows, "id int, bucket string")
    assert quotas_of({"a": 0.5, "b": 0.3, "c": 0.2}, 101) == {"a": 51, "b": 30, "c": 20} or sum(quotas_of({"a": 0.5, "b": 0.3, "c": 0.2}, 101).values()) == 101
    got = bucketed_sample(d, "bucket", "id", {"a": 0.5, "b": 0.3, "c": 0.2}, 100, 1, ("c", "a", "b")).collect()
    assert len(got) == 100 and len({r.id for r in got}) == 100
    assert Counter((r.bucket, r.how) for r in got) == {("a", "quota"): 50, ("b", "quota"): 10, ("c", "quota"): 20, ("a", "redistributed"): 20}
    assert bucketed_sample(d, "bucket", "id", {"b": 1.0}, 100, 1, ("b",)).count() == 10 and bucketed_sample(d.limit(0), "bucket", "id", {"b": 1.0}, 5, 1, ("b",)).count() == 0


def test_hot_text_in_near_duplicates(spark):
    """A third of all rows hold one text, and all texts share a template."""
    template = " ".join(f"common{i}" for i in range(40))
    rows = [(i, template + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(60)] + [(1000 + i, "one text " * 30) for i in range(30)]
    rows += [(2000, template + " " + " ".join(f"own7x{j}" for j in range(59))), (3000, None), (3001, "")]
    d = spark.createDataFrame(rows, "id int, text string")
    assert [(r.a, r.b) for r in jaccard_pairs(d, "id", "text").collect()] == [(7, 2000)]
    assert verified_links(d, "id", "text").count() == 1 + 29
    x = near_duplicates(d, "id", "text").collect()
    assert {r.root for r in x} == {7, 1000} and len(x) == 32 and all((r.least_similarity < 1) == (r.root == 7) for r in x)
    assert near_duplicates(d.limit(0), "id", "text").count() == 0


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"text": "a", "language": "hi"}, {"text": null}]')
    assert [(r.record_no, r.text, r.language) for r in read_json_records(spark, str(tmp_path / "r.json")).collect()] == [(0, "a", "hi"), (1, None, None)]
    files = tmp_path / "files"
    files.mkdir()
    for name, body in (("a.TXT", "x"), ("b.htm", "<p>y</p>"), ("c.json", '["z"]'), ("noend", "w")):
        (files / name).write_text(body)
    assert {(r.format, r.text) for r in read_artifacts(spark, str(files)).collect()} == {("text", "x"), ("markup", "y"), ("json", "z"), ("text", "w")}
    (files / "bad.json").write_text("{")
    with pytest.raises(Exception):
        read_artifacts(spark, str(files)).collect()
    d = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "case_id string, n int")
    assert {(r.case_id, r.n) for r in (write_jsonl(d, str(tmp_path / "l")), read_latest(spark, str(tmp_path / "l"), d.schema, "case_id", "n").collect())[1]} == {("b", 3), ("a", 2)}
    with pytest.raises(Exception):
        read_suites(spark, str(tmp_path / "l*"), d.schema).collect()
    said = write_sorted(d, "case_id", str(tmp_path / "s"))
    assert said == files_written(spark, str(tmp_path / "s")) and said["bytes"] > 0 and len(said["sha256"]) == 64
    t = spark.createDataFrame([(1, "hi", [5, 6]), (2, "hi", None), (3, "hi", [7]), (4, "en", [])], "id int, lang string, ids array<int>")
    assert write_token_stream(t, "id", "ids", "lang", str(tmp_path / "t"), 0) == {"rows": 4, "tokens": 7, "end": 0}
    assert [(r["at"], r["id"]) for r in read_token_stream(spark, str(tmp_path / "t"), "lang", "hi", 1, 5).orderBy("at").collect()] == [(1, 6), (2, 0), (3, 0), (4, 7)]


def test_windowed_counts(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 23:59:00", "a"), ("2024-01-02 00:00:00", "b")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    run_to_end(windowed_counts(s, "ts", ["k"]), str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    assert sorted((r.window.start.day, r.k, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a", 2), (2, "b", 1)]


def test_node_coverage(spark):
    from granary.operators.learning import node_coverage

    full = [("m", "quiz", 1, 1, "advanced", True)] * 6 + [("m", "transfer", 1, 1, None, None), ("m", "verification", 1, 1, "expert", False)]
    rows = [*full, ("few", "quiz", 1, 1, "expert", True), *[("low", "quiz", 0, 2, "nothing", None)] * 4, *[("half", "quiz", 1, 1, "expert", True)] * 9, ("zero", "quiz", None, None, None, None), ("zero", "quiz", 0, 0, None, None), ("zero", None, 0, 0, None, None)]
    d = spark.createDataFrame(rows, "n string, kind string, correct int, total int, difficulty string, verified boolean")
    got = {r.n: (r.state, list(r.blockers), r.difficulty) for r in node_coverage(d, "n", "kind", "correct", "total", "difficulty", "verified").collect()}
    assert got["m"] == ("mastered", [], "expert") and got["few"] == ("learning", ["too_little_evidence"], "expert")
    assert got["low"] == ("practice", ["few_attempts", "low_accuracy", "low_difficulty", "no_transfer", "no_verification", "nothing_verified"], "none")
    assert got["half"] == ("assessed", ["no_transfer", "no_verification"], "expert") and got["zero"][0] == "practice"
    assert node_coverage(d.limit(0), "n", "kind", "correct", "total", "difficulty", "verified").count() == 0


def test_yaml_lists(spark, tmp_path):
    from pyspark.sql import types as T

    from granary.sources.files import read_graph, read_required, read_yaml_list

    (tmp_path / "m.yaml").write_text("sources:\n- {id: a, status: null}\n- id: b\n  status: ready\n")
    (tmp_path / "twice.yaml").write_text("sources: [{id: a}, {id: a}]")
    (tmp_path / "g.yaml").write_text("nodes:\n- {id: n1, subject: s, grade: 1}\n- {id: n2, subject: s, grade: 2, depends_on: [n1, gone]}\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.StringType())])
    read = lambda name: read_yaml_list(spark, str(tmp_path / name), "sources", schema, "id", {"status": "new"})
    assert {(r.id, r.status) for r in read("m.yaml").collect()} == {("a", "new"), ("b", "ready")}
    with pytest.raises(Exception):
        read("twice.yaml").collect()
    nodes, edges = read_graph(spark, str(tmp_path / "g.yaml"))
    assert {tuple(r) for r in nodes.collect()} == {("n1", "s", 1), ("n2", "s", 2)} and {tuple(r) for r in edges.collect()} == {("n2", "n1"), ("n2", "gone")}
    assert read_required(nodes, "nodes").count() == 2
    with pytest.raises(ValueError):
        read_required(nodes.limit(0), "nodes")


def test_components_in_two_deliveries(spark):
    from granary.operators.dedup import connected, first_copies, forest, merge_components

    rng = random.Random(9)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)]
    whole = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    first, second = (spark.createDataFrame(x, "a long, b long") for x in (links[:40], links[40:]))
    got = {r.node: r.root for r in merge_components(connected(first), second).collect()}
    assert {k: v for k, v in got.items() if k in whole} == whole and all(k == v for k, v in got.items() if k not in whole)
    names = spark.createDataFrame([("c", "b"), ("b", "a"), ("y", "x"), ("z", "z")], "a string, b string").coalesce(1)
    assert {tuple(r) for r in forest(names, 1).collect()} >= {("b", "a"), ("y", "x")} and forest(names.limit(0)).count() == 0
    d = spark.createDataFrame([(3, "h"), (1, "h"), (1, "h"), (2, "g"), (4, None)], "k int, h string")
    assert sorted(tuple(r) for r in first_copies(d.where("h IS NOT NULL"), "k", "h").collect()) == [(1, "h"), (2, "g")]


def test_sketch_counts_all(spark):
    from granary.operators.dedup import COUNTERS, frequency_sketch

    d = spark.createDataFrame([([1, 2, 3],), ([1, 1 + COUNTERS],), ([],), ([-5],)], "g array<bigint>").repartition(3)
    s = frequency_sketch(d)
    assert s[1] == 3 and s[2] == 1 and s[-5 & (COUNTERS - 1)] == 1 and s.sum() == 6 and frequency_sketch(d.limit(0)).sum() == 0
