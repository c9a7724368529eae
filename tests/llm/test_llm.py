"""The operators on training text: brute force, exact round trips, held-out accuracy, and awkward input."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, fold, language, leaks, overlap, packing, related, seeds, severity, words
from granary.llm.budget import record_tokens, totals, with_slices
from granary.llm.visual import consistent_text, same_look_pairs

LONG = "long words here " * 20_000
AWKWARD = [("a:w:0", None), ("a:w:1", ""), ("a:w:2", " \n\t"), ("a:w:3", LONG), ("a:w:4", "same text"), ("a:w:5", "same text"), ("a:w:5", "same text"), (None, "no key"), ("a:w:6", "‍‌​"), ("a:w:7", "퟿\U0001f600<|endoftext|>")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, a repeated row, and columns named as operators name theirs."""
    extra = ["k", "key", "form", "raw", "ids", "n_tokens", "severity", "r", "node", "root", "label"]
    d = spark.createDataFrame(AWKWARD, "doc_id string, text string")
    return d.withColumns({c: F.lit(1) for c in extra}).withColumns({"language": F.lit(None).cast("string"), "split": F.when(F.col("doc_id").endswith("4"), "val").otherwise("train"), "shard": F.lit("s")})


def test_fold_is_one_form():
    pairs = [("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1"), ("é", "é"), ("с̧", "ç"), ("раураl", "paypal"), ("a​b⁠c﻿\xadd", "abcd"), ("a\xa0b c", "a b c"), ("अौर", "और"), ("ज़", "ज़"), ("ﬃ", "ffi"), ("‐", "-"), ("ї", "ï"), ("কো", "কো")]
    for a, b in pairs:
        assert fold.fold(a) == fold.fold(b) == b, (a, b)
    for same in ("A b", "a  b", "a\nb", "a\r\nb", "a.b", "क्‍ष", ""):
        assert fold.fold(same) == same
    assert fold.fold(None) is None and fold.fold("a‍b") == "ab"
    for r, t in fold.default_rules().items():
        assert fold.fold(fold.fold(r)) == fold.fold(r) and fold.fold(t) == t


def test_fold_refuses_conflicts():
    with pytest.raises(ValueError):
        fold.Transducer({"a": "b", "b": "c"})
    with pytest.raises(ValueError):
        fold.Transducer({"": "x"})
    t = fold.Transducer({"x": "1", "xy": "2"})
    assert t("éxyx") == "é21"


def test_same_look(spark, awkward):
    rows = [("1", "résumé"), ("2", "résumé"), ("3", "Résumé"), ("4", "résumé"), ("5", "résumé "), ("6", "​"), ("7", "﻿"), ("2", "résumé")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.a, r.b) for r in same_look_pairs(d).collect()}
    texts = dict(rows)
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] != texts[b] and fold.fold(texts[a]) == fold.fold(texts[b]) and fold.fold(texts[a]).strip()}
    assert got == want == {("1", "2"), ("2", "4")}
    assert same_look_pairs(awkward).count() == 0 and same_look_pairs(d.limit(0)).count() == 0
    assert consistent_text(awkward).count() == len(AWKWARD)


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder("byte_bpe_50k")
    rng = random.Random(5)
    texts = ["", "a" * 3000, "  x   y\t\n z ", "it's WE'LL o'clock", "<|endoftext|>", "हिन्दी में १२३ 👍🏽 ﬁ", "\x1c\x85 \x1d"]
    texts += ["".join(rng.choice("aab c\t\n'sd1é   क्षिा।،​ ") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for s in texts:
        assert e.encode(s) == t.encode(s, add_special_tokens=False).ids, repr(s)
        assert e.count(s) == len(e.encode(s))
    assert e.encode(None) == [] and e.count(None) == 0


def test_merges_equal_plain_bpe():
    e = bpe.encoder("byte_bpe_50k")

    def plain(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            ranked = [(e.ranks.get(a + b, bpe.INF), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == bpe.INF:
                return [e.ranks[x] for x in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    for _ in range(300):
        p = bytes(rng.choice(b"aabcdeithnos \xe0\xa4\x95") for _ in range(rng.randint(1, 60)))
        assert e.merge(p) == plain(p)


def test_encode_corpus(awkward):
    got = bpe.encode_corpus(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r.ids == [] for r in got if r.doc_id in ("a:w:0", "a:w:1"))
    assert bpe.encode_corpus(awkward.limit(0)).count() == 0


def test_token_budget(spark, awkward):
    e = bpe.encoder("byte_bpe_50k")
    got = {r.doc_id: (r.n_tokens, r.has_text) for r in record_tokens(awkward).collect()}
    assert got == {k: (e.count(t), bool(t)) for k, t in AWKWARD if k is not None}
    manifest = spark.createDataFrame([("a", " News ")], "id string, domain string")
    x = with_slices(record_tokens(awkward), manifest)
    assert {(r.source, r.language, r.domain) for r in x.collect()} == {("a", "und", "news")}
    whole = totals(x, "source", "language").where("source = '*' AND language = '*'").first()
    assert (whole.records, whole.tokens) == (len(got), sum(n for n, _ in got.values()))
    assert record_tokens(awkward.limit(0)).count() == 0


def test_names_in_any_script():
    for a, b in [("Demesakambe", "देमेसाकाम्बे"), ("Lodutopatzo", "লোদুতোপাত্জ়ো"), ("Jokubolazor", "జోకుబోలాజోర"), ("Mokobosovulk", "Mokobosowulk"), ("MIMISELIYIV", "मिमिसेलियिव"), ("Sekukepexan", "सेकुकेपेक्सान"), ("Péla", "पेला")]:
        assert related.name_key(a) == related.name_key(b), (a, b)
    assert related.name_key("Rebodazor") != related.name_key("Rebudazor")


@pytest.mark.parametrize("line", ["By Misko Tarovazor", "— Misko Tarovazor", "~ Misko Tarovazor ~", "Signed, Misko Tarovazor", "Written by M. Tarovazor re: dossier bq-66312", "(M. Tarovazor)", "TAROVAZOR, M.: from the papers", "Author: Tarovazor, Misko", "Text © Misko Tarovazor", "lekhak - Misko Tarovazor", "written in the hand of Tarovazor", "लेखक: मिस्को तारोवाज़ोर", "रचना: तारोवाज़ोर, मिस्को", "मिस्को तारोवाज़ोर द्वारा लिखित", "मिस्को तारोवाज़ोर — लेख", "- तारोवाज़ोर, लेखक", "लेखन - तारोवाज़ोर", "by misko tarovazor", "<p>By Misko Tarovazor</p>"])
def test_credits(line):
    assert related.writers(words.plain(f"Some prose here.\n\n{line}\nMore prose.")) == ["tarobajor"]


@pytest.mark.parametrize("line", ["Reviewed by Misko Tarovazor", "Editor of the series: Misko Tarovazor", "Printed for Tarovazor & Sons", "संपादक: मिस्को तारोवाज़ोर", "समीक्षा: मिस्को तारोवाज़ोर", "Misko Tarovazor told the cook that it was late.", "Invoice 10106 attached", "Tender no. 2022/57", "रसीद 10139", "----"])
def test_no_credits(line):
    assert related.writers(words.plain(f"Some prose.\n{line}\nMore.")) == [] and related.dossiers(line) == []


def test_dossiers():
    for s in ("(dossier no. BS 72206)", "पत्रावली BS-७२२०६", "Dossier: ＢＳ－７２ ２０６", "re: dossier bs-72206", "[ref. BS72206]", "dossier#BS72206", "Dossier BS/72206"):
        assert related.dossiers(words.plain(s)) == ["BS72206"], s


def test_groups_equal_union_find(spark, awkward):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = "Prose of record.\n" + (f"By Anna Name{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}lo\n" if rng.random() < 0.3 else "") + (f"See dossier AB-{10000 + rng.randrange(60)}." if rng.random() < 0.3 else "")
        rows.append((f"s{rng.randrange(4)}:{rng.choice(['work', 'Work', 'WORK'])}{rng.choice('-_')}{rng.randrange(120)}:{i:06d}", text))
    got = {r.doc_id: (r.group_id, r.records) for r in related.related_groups(spark.createDataFrame(rows + rows[:5], "doc_id string, text string")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for d, t in rows:
        w, rest = related.record_keys(d, t)
        for k in rest:
            up[root(k)] = root(w)
    groups = defaultdict(list)
    for d, t in rows:
        groups[root(related.record_keys(d, t)[0])].append(d)
    assert got == {d: (min(g), len(g)) for g in groups.values() for d in g}
    assert related.related_groups(awkward).count() == len({k for k, _ in AWKWARD if k})
    assert related.related_groups(awkward.limit(0)).count() == 0


def test_grouped_split(spark):
    rows = [(f"d{i}", f"g{i // 7}", 7) for i in range(700)] + [(f"b{i}", "big", 200) for i in range(200)]
    plan = spark.createDataFrame([("train", 0.8, 1), ("val", 0.1, 1), ("test", 0.1, 1)], "split string, fraction double, seed long")
    got = related.grouped_split(spark.createDataFrame(rows, "doc_id string, group_id string, records long"), plan).collect()
    assert len(got) == 900 and all(len({r.split for r in got if r.group_id == g}) == 1 for g in ("big", "g1", "g50"))
    n = Counter(r.split for r in got)
    assert abs(n["train"] - 720) <= 7 and abs(n["val"] - 90) <= 7 and abs(n["test"] - 90) <= 7
    dealt = related._share([(5, 100_000), (1, 50_000)], {"train": 440_000.0, "val": 55_000.0, "test": 55_000.0})
    each = Counter()
    for size, lo, hi, s in dealt:
        each[s] += size * (hi - lo)
    assert sum(each.values()) == 550_000 and abs(each["train"] - 440_000) <= 5


def test_longest_matches_equal_brute_force():
    rng = random.Random(4)
    items = {str(i): [rng.choice("abcd") for _ in range(rng.randint(1, 9))] for i in range(12)}
    sam = leaks.SuffixAutomaton(items)
    parts = {tuple(v[i:j]) for v in items.values() for i in range(len(v)) for j in range(i + 1, len(v) + 1)}
    for _ in range(200):
        text = [rng.choice("abcde") for _ in range(20)]
        runs = sam.runs(text, 1)
        for a, b, s in runs:
            assert tuple(text[a:b]) in parts
            assert {(k, e) for k, e in sam.ends[s]} == {(k, e) for k, v in items.items() for e in range(b - a, len(v) + 1) if v[e - (b - a) : e] == text[a:b]}
            assert a == 0 or tuple(text[a - 1 : b]) not in parts
            assert b == len(text) or tuple(text[a : b + 1]) not in parts


def test_leaks(spark, awkward):
    items = {"long": words.words_of("When Ann swapped 146 baskets of amber resin for a lame mule at Velgaon, the price"), "short": words.words_of("Rukghat tin whistles of 1930 belonged to"), "none": []}
    d = leaks.Detector(items)
    hit = lambda t: {x.item for x in d.leaks(words.words_of(t))}
    assert hit("so WHEN ann swapped 146 baskets <b>of</b> amber, resin it") == {"long"}
    assert hit("x swapped 146 baskets of old amber resin for a y") == {"long"}
    assert hit("x swapped 146 baskets amber resin for a lame y") == {"long"}
    assert hit('{"q": "\\u0073wapped 146 baskets of amber res\\u0069n for a"}') == {"long"}
    assert hit("x swapped 146 baskets of amber y") == set() and hit("146 baskets of x amber resin") == set()
    assert hit("the rukghat tin whistles of 1930 belonged to me") == {"short"} and hit("tin whistles of 1930") == set()
    assert leaks.find_leaks(awkward, items).count() == 0
    got = leaks.without_leaks(spark.createDataFrame([("a swapped 146 baskets of amber resin for a lame mule z",), (None,), ("",)], "text string"), items).select("clean").collect()
    assert [r.clean for r in got] == ["a  z", None, ""]


def test_items_within_a_longer_match_of_another():
    long = [f"i{i}" for i in range(30)]
    d = leaks.Detector({"long": long, "within": ["a", *long[5:14], "b"], "short": long[20:25], "other": ["c", "d", "e", "f", "g", "h"]})
    assert {x.item for x in d.leaks(["p", *long, "q"])} == {"long", "within", "short"}
    assert {x.item for x in d.leaks(["p", *long[:20], "q"])} == {"long", "within"}
    rng = random.Random(6)
    items = {f"k{i}": [rng.choice("abcd") for _ in range(rng.randint(3, 30))] for i in range(12)}
    sam = leaks.SuffixAutomaton(items)
    for _ in range(60):
        text = [rng.choice("abcde") for _ in range(40)]
        want = set()
        for k, item in items.items():
            for i in range(len(text)):
                for j in range(len(item)):
                    n = leaks._same(text, i, item, j, 1)
                    if n >= 3 and not (i and j and text[i - 1] == item[j - 1]):
                        want.add((i, i + n, k, j + n))
        got = list(sam.matches(text, 3))
        assert set(got) == want and len(got) == len(want)


def test_every_leaked_span_is_removed(spark):
    item = [f"i{i}" for i in range(40)]
    items = {"long": item, "other": [f"o{i}" for i in range(20)]}
    a, b = " ".join(item[:12]), " ".join(item[25:40])
    edited = [*item[:12], "x", *item[13:25], "y", *item[26:40]]
    texts = [f"p {a} q {a} r", f"p {a} q {b} r", " ".join(["p", *edited, "r"]), f"p {a} q {' '.join(items['other'])} r {b} s", f"p {' '.join(item[:6])} {b} {' '.join(item[6:12])} q"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.clean.split() for r in leaks.without_leaks(d, items).select("clean").collect()]
    assert got == [["p", "q", "r"], ["p", "q", "r"], ["p", "r"], ["p", "q", "r", "s"], ["p", "q"]]
    assert all(not leaks.Detector(items).leaks(x) for x in got)


def _edited(ws, rng, share):
    ws = list(ws)
    for _ in range(int(share * len(ws))):
        i = rng.randrange(len(ws))
        rng.choice([lambda: ws.__setitem__(i, "zz"), lambda: ws.pop(i), lambda: ws.insert(i, "yy")])()
    return ws


def test_overlaps_equal_brute_force(spark, awkward):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 30, 90]))]
        lines = [ws[j : j + 15] for j in range(0, len(ws), 15)]
        rows.append((f"v{i}", "\n".join(map(" ".join, lines)), rng.choice(["val", "test"])))
        near = _edited(ws, rng, rng.choice([0, 0.05, 0.1, 0.3, 0.6]))
        rows.append((f"t{i}", ". ".join([" ".join(near)]).upper() + "!", "train"))
        rng.shuffle(lines)
        rows.append((f"u{i}", "\r\n\r\n".join(map(" ".join, lines)), "train"))
    d = spark.createDataFrame(rows, "doc_id string, text string, split string")
    ids = {k: overlap.lines_of_ids(t) for k, t, _ in rows}
    want = {(a, b) for a, _, s in rows if s == "train" for b, _, h in rows if h != "train" and overlap.almost_same(ids[b], ids[a], 0.8)}
    for shard in (overlap.SHARD_WORDS, 500):
        assert {tuple(r) for r in overlap.cross_split_overlaps(d, shard_words=shard).collect()} == want
    assert len(want) > 80
    assert {tuple(r) for r in overlap.cross_split_overlaps(awkward).collect()} == {("a:w:5", "a:w:4")}
    assert overlap.cross_split_overlaps(awkward.limit(0)).count() == 0


def test_overlaps_of_many_near_copies_equal_brute_force():
    rng = random.Random(4)
    train = [rng.randrange(1, 5000) for _ in range(100)]
    held = []
    for i in range(60):  # each with words of its own, which are the rarest among the copies
        ws = list(train)
        for j in range(i % 5, 100, 5) if i < 10 else rng.sample(range(100), rng.randint(10, 24)):
            ws[j] = rng.randrange(10_000, 20_000)
        held.append([ws[j : j + 10] for j in range(0, 100, 10)])
    lines = [train[j : j + 10] for j in range(0, 100, 10)]
    want = [i for i, x in enumerate(held) if overlap.almost_same(x, lines, 0.8)]
    assert 20 < len(want) < 60
    assert overlap.Shard([(i, overlap.packed(x)) for i, x in enumerate(held)], 0.8).find([overlap.packed(lines)])[0] == want
    for share in (0.5, 0.8, 1.0):
        texts = [[[rng.randrange(1, 8) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 2))] for _ in range(120)]
        shard = overlap.Shard([(i, overlap.packed(x)) for i, x in enumerate(texts)], share)
        for x in texts[:60]:
            assert sorted(shard.find([overlap.packed(x)])[0]) == [i for i, y in enumerate(texts) if overlap.almost_same(y, x, share)]


def test_overlaps_scan_train_once_for_many_shards(spark):
    """Train is scanned once for several shards, not for each; what sketches let pass is compared, copies and long texts included."""
    rng, rows = random.Random(12), []
    tongues = [[f"{x}{i}" for i in range(150)] for x in "abc"]
    for i in range(120):
        vocabulary = rng.choice(tongues)
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 20, 60, 140, 300, 900]))]
        lines = [ws[j : j + 12] for j in range(0, len(ws), 12)]
        rows += [(f"v{i}", "\n".join(map(" ".join, lines)), rng.choice(["val", "test"])) for _ in range(1 + (i % 9 == 0))]
        rows.append((f"t{i}", " ".join(_edited(ws, rng, rng.choice([0, 0.1, 0.2, 0.3]))), "train"))
        rng.shuffle(lines)
        rows.append((f"u{i}", "\n\n".join(map(" ".join, lines)), "train"))
    rows += [(f"x{i}", *rows[1][1:]) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id string, text string, split string").repartition(3)
    ids = {k: overlap.lines_of_ids(t) for k, t, _ in rows}
    want = {(a, b) for a, _, s in rows if s == "train" for b, _, h in rows if h != "train" and overlap.almost_same(ids[b], ids[a], 0.8)}
    assert len(want) > 100
    words = sum(len(x) // 4 for x in {overlap.packed(ids[k]) for k, _, s in rows if s != "train"})
    got = overlap.cross_split_overlaps(d, shard_words=words // 70)
    assert {tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow") <= 4  # 3 scans and the comparison


def test_sketches_let_pass_all_that_can_be_the_same():
    rng = random.Random(8)
    tongues = [[rng.randrange(1, 1 << 32) for _ in range(250)] for _ in range(4)]
    held = [[rng.choice(rng.choice(tongues) if i % 7 == 0 else tongues[i % 4]) for _ in range(rng.choice([1, 4, 30, 100, 150, 330, 1300]))] for i in range(400)]
    texts = []
    for x in held[::2]:  # as many words changed as may be, or one more; some longer or shorter
        n = len(x)
        x = [w if j >= round(n * 0.2) + rng.randint(-1, 1) else rng.randrange(1, 1 << 32) for j, w in enumerate(rng.sample(x, n))]
        texts.append(x[: rng.choice([n, n, n - n // 5])] + rng.choices(x, k=rng.choice([0, 0, n // 5])))
    for share in (0.5, 0.8, 1.0):
        shard = overlap.Shard([(i, overlap.packed([x])) for i, x in enumerate(held)], share)
        got = list(shard.sketches.candidates([overlap.packed([x]) for x in texts]))
        assert len(got) == len(set(got))
        bags = [Counter(x) for x in held]
        can = {(t, r) for t, x in enumerate(texts) for c in [Counter(x)] for r, y in enumerate(held) if (c & bags[r]).total() >= share * max(len(x), len(y)) - 1e-9}
        assert can <= set(got) and len(can) > 20
        assert share < 0.8 or len(got) < len(can) + 0.001 * len(texts) * len(held)  # at 0.5 sketches tell less


def test_common_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 25))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap.common_in_order(a, b) == t[-1][-1]


def test_bins_hold_everything():
    rng = random.Random(6)
    for _ in range(150):
        c = rng.randint(4, 50)
        items = Counter(rng.randint(1, c) for _ in range(rng.randint(0, 30)))
        got = packing.bin_completion(dict(items), c)
        held = Counter()
        for pattern, n in got:
            assert sum(s * k for s, k in pattern) <= c
            for s, k in pattern:
                held[s] += k * n
        assert held == items and sum(n for _, n in got) <= sum(n for _, n in packing.best_fit(dict(items), c))
    assert sum(n for _, n in packing.bin_completion({6: 2, 5: 2, 4: 2, 3: 2, 2: 1}, 10)) == 4
    with pytest.raises(ValueError):
        packing.bin_completion({11: 1}, 10)


def test_no_filling_is_dominated():
    rng = random.Random(8)
    for _ in range(40):
        left = {s: rng.randint(1, 2) for s in rng.sample(range(1, 12), 6)}
        room, pool = rng.randint(8, 20), [s for s, n in left.items() for _ in range(n)]
        every = {tuple(sorted(Counter(x).items(), reverse=True)) for n in range(len(pool) + 1) for x in itertools.combinations(pool, n) if sum(x) <= room}

        def worse(f):  # noqa: ANN001, ANN202
            waste, mine = room - sum(s * n for s, n in f), [s for s, n in f for _ in range(n)]
            parts = {x for n in range(len(mine) + 1) for x in itertools.combinations(mine, n)}
            return any(left[j] > dict(f).get(j, 0) and any(all(y < j for y in x) and sum(x) <= j <= sum(x) + waste for x in parts) for j in left)  # noqa: B023

        got = packing.fillings(room, left, sorted((s for s in left if s <= room), reverse=True), room, 10_000, 1_000_000)
        by = Counter(tuple(f) for _, f in got)
        want = {f for f in every if not worse(f)}
        assert set(by) <= want and (set(by) == want or min(w for w, _ in got) == 0)


def test_packing(spark, awkward):
    plan = spark.createDataFrame([("small", 16, "byte_bpe_50k"), ("large", 300, "byte_bpe_50k")], "container string, capacity_tokens int, tokenizer string")
    got = packing.packed(awkward, plan).collect()
    e = bpe.encoder("byte_bpe_50k")
    for c, cap in (("small", 16), ("large", 300)):
        rows = [r for r in got if r.container == c]
        room = Counter()
        for r in rows:
            if r.bin is not None:
                room[r.bin] += r.tokens
        assert max(room.values()) <= cap and sum(room.values()) == sum(e.count(t) for _, t in AWKWARD)
        assert sum(r.bin is None for r in rows) == sum(not t for _, t in AWKWARD)
    assert packing.packed(awkward.limit(0), plan).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    s = spark.read.parquet("/root/testdata/sf0.01/split_stream.parquet")
    return language.fit(*language.labelled_sample(s, "language", "text", "doc_id", 60), rounds=1)


def test_language_held_out(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('hi','en','hinc-latn','hinc-deva','mr','sa','bn','te','gu','pa') AND length(text) > 60").collect()
    right = sum(model.predict(words.words_of(r.text))[0] == r.lang for r in d)
    assert right / len(d) > 0.9  # some labels are wrong
    text = "The clerk and the editor copied the ledger beside the quiet reading room of the town.\nसंपादक ने कहा कि गाँव में पुरानी किताब कल शाम छोड़ी गई थी।\nBy Misko Tarovazor"
    assert [(a, b) for a, b, _ in language.languages_of(text, model)] == [(1, "en"), (2, "hi"), (3, "hi")]
    assert language.languages_of(text.split("\n")[0] + "\nलेखक: मिस्को तारोवाज़ोर", model)[0][:2] == (0, "en")


def test_language_awkward(awkward, model):
    got = language.record_languages(awkward, model).collect()
    assert {r.doc_id for r in got} == {"a:w:3", "a:w:4", "a:w:5", "a:w:6", "a:w:7"} - ({"a:w:6"} if not words.plain("‍‌​").strip() else set())
    assert language.record_languages(awkward.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language.fit([], [])


def test_severity(spark, awkward):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/moderation_samples.parquet").orderBy("sample_id").collect() if r.label]
    m = severity.fit([r.text for i, r in enumerate(rows) if i % 4], [r.label for i, r in enumerate(rows) if i % 4], rounds=6)
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    right = sum((m.rate(r.text)[1] > 0.5) == (r.label != "none") for r in held)
    assert right / len(held) > 0.93
    assert m.rate(None) == m.rate("") == m.rate(" \n") == (0.0, 0.0)
    grades = defaultdict(list)
    for r in rows:
        grades[r.label].append(m.rate(r.text)[0])
    mean = {k: sum(v) / len(v) for k, v in grades.items()}
    assert mean["none"] < mean["abusive"] < mean["hateful"]
    assert severity.rated(awkward, m).count() == len(AWKWARD) and severity.rated(awkward.limit(0), m).count() == 0
    assert severity.undisguised("g@dh3") == ("gadhe",) and severity.undisguised("suuuuar") == ("suar",) and severity.undisguised("फिरफिर") == ("फिर",)
    assert severity.passages("you are such b i t c h and t-h-i-r-d")[0] == ["you", "are", "such", "bitch", "and", "third"]
    assert severity.passages("Fuck you.") == [["fuck", "you"]] and severity.passages("You\nare\nan idiot\nA whole long line here.")[0] == ["you", "are", "an", "idiot"]
    assert severity.passages("A whole long line. Idiot!") == [["a", "whole", "long", "line", "idiot"]]
    assert severity.GRADES["none"] < severity.GRADES["sexual"] < severity.GRADES["hateful"] and mean["none"] < mean["sexual"]


def test_severity_by_language(spark):
    """Held-out reviewed passages of each language, and background sentences of languages that no reviewer saw."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/moderation_samples.parquet").orderBy("sample_id").collect() if r.label and r.text]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    background = severity.background_sample(d, "text", "lang")
    assert background == severity.background_sample(d.repartition(7), "text", "lang")  # however the rows lie
    fitted = [r for i, r in enumerate(rows) if i % 3]
    m = severity.fit([r.text for r in fitted], [r.label for r in fitted], [b for i, b in enumerate(background) if i % 3])
    held = defaultdict(lambda: [0, 0, 0, 0])
    for i, r in enumerate(rows):
        if i % 3 == 0:
            x, hit = held[r.lang], m.rate(r.text)[1] > severity.REPORTED
            x[0 if r.label == "none" else 2] += 1
            x[1 if r.label == "none" else 3] += hit
    for language_, (none, wrong, bad, found) in held.items():
        assert wrong <= 0.05 * none + 1 and found >= 0.85 * bad - 1, language_
    unseen = defaultdict(list)
    for i, (t, label) in enumerate(background):
        if i % 3 == 0 and label in ("sa", "te", "gu", "pa"):
            unseen[label].append(m.rate(t)[1] > severity.REPORTED)
    assert len(unseen) == 4 and all(sum(v) <= 0.02 * len(v) + 1 for v in unseen.values())


def test_no_seed_is_from_a_table(spark):
    parts = defaultdict(set)
    for t in (*seeds.ABUSIVE, *seeds.HATEFUL, *seeds.SEXUAL, *seeds.HARMLESS):
        w = words.words_of(t)
        for i in range(len(w) - 4):
            parts[tuple(w[i : i + 5])].add(t)
    for sf in ("sf0.001", "sf0.01"):
        for name in ("documents", "moderation_samples"):
            for r in spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet").select("text").distinct().collect():
                w = words.words_of(r.text)
                assert not any(tuple(w[i : i + 5]) in parts for i in range(len(w) - 4))


def test_every_query_runs(spark):
    from granary.llm.queries import QUERIES

    assert {f"p{i}" for i in range(1, 10)} == {n.split("_")[0] for n in QUERIES}
    for name in ("p1_found", "p4_found", "p5_found", "p6_found", "p6_report", "p3_shards"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_forms_and_skeletons():
    for t in ("👨\u200d👩\u200d👧", "می\u200cخواهم", "क्\u200dष", "сорока и оса", "НАТО и США", "Αθήνα"):
        assert fold.fold(t) == t  # what shows, and words of another script, stay
    assert fold.fold("hel\u200dlo w\u0430\u200cter") == "hello water" and fold.fold("Ρaris, NАТО") == "Paris, NATO"
    assert fold.fold("cорока и оса") == "сорока и оса"  # a Latin letter in a Russian word
    assert fold.skeleton("сорока") == fold.skeleton("copoкa") and fold.fold("сорока") != fold.fold("copoкa") or fold.fold("copoкa") == "сорока"
    assert fold.skeleton("👨\u200d👩") != fold.skeleton("👨👩") and fold.fold("か\u200dな") == "かな" and fold.fold("क\u200dख") == "कख"
    for t in ("сорока", "pаypal", "Αθήνα ΤΟΝ", "e\u0301\u20d0", "ｆｕｌｌ", "می\u200cخواهم"):
        assert fold.fold(fold.fold(t)) == fold.fold(t) and fold.skeleton(fold.skeleton(t)) == fold.skeleton(t)


def test_component_of_a_third_of_all_keys(spark):
    """One component holds a third of all keys; no task holds more than a small forest, and the result is the same."""
    rng = random.Random(3)
    hub = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(700, 1000)] + [(5, 700)]
    rest = [(i, i + rng.randint(1, 3)) for i in range(2000, 4000, 4)]
    e = spark.createDataFrame(hub + rest, "a long, b long")
    want = {}
    up = {}

    def root(x):  # noqa: ANN001, ANN202
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in hub + rest:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in list(up) if root(x) != x}
    for local in (8, 1_000_000):
        assert {r.node: r.root for r in related.components(e.repartition(5), local=local).collect()} == want


def test_largest_first_is_dealt_as_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        goal = {s: rng.random() * 2000 for s in "abc"}
        sizes = sorted({rng.randint(1, 30): rng.randint(1, 5000) for _ in range(6)}.items(), reverse=True)
        left, want, got = dict(goal), Counter(), Counter()
        for size, n in sizes:
            for _ in range(n):
                k = max(left, key=lambda s: (left[s], s))
                left[k] -= size
                want[size, k] += 1
        for size, lo, hi, k in related._share(sizes, goal):
            got[size, k] += hi - lo
        assert got == want


def test_short_names_and_lines():
    assert related.writers("By Anita Rao") == related.writers("लेखक: अनीता राव") != []
    assert related.writers("By A. Das") and related.writers("By Meera Sen") and not related.writers("by hand, by foot and by the sea they all came home that night again, as said.")


def test_every_passage_of_an_item_is_removed(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three"
    w = item.split()
    text = f"start {' '.join(w[:12])} middle words stay here {' '.join(w[13:26])} end"
    eight = f"first {' '.join(w[3:11])} last"
    d = spark.createDataFrame([("a", text), ("b", eight), ("c", " ".join(w[3:10]))], "doc_id string, text string")
    got = {r.doc_id: r.clean.split() for r in leaks.without_leaks(d, {"i": w}).collect()}
    assert got == {"a": "start middle words stay here end".split(), "b": ["first", "last"], "c": w[3:10]}


def test_every_fifth_word_changed(spark):
    """Evenly edited records at just four fifths are all found, beside many near-copies of one training text."""
    rng, rows, want = random.Random(6), [], set()
    common = [f"c{i}" for i in range(40)]
    for i in range(120):
        w = [rng.choice(common) if rng.random() < 0.5 else f"t{i}x{j}" for j in range(rng.randint(60, 160))]
        edited = [x if j % 5 != 4 else f"e{i}x{j}" for j, x in enumerate(w)]
        rows += [(f"t{i}", "train", " ".join(w)), (f"v{i}", "val", " ".join(edited))]
        want.add((f"t{i}", f"v{i}"))
    base = [f"b{j}" for j in range(100)]
    rows.append(("tb", "train", " ".join(base)))
    for i in range(40):
        w = [x if rng.random() < 0.85 else f"n{i}x{j}" for j, x in enumerate(base)]
        rows.append((f"w{i}", "test", " ".join(w)))
        if sum(a == b for a, b in zip(w, base)) >= 80:
            want.add(("tb", f"w{i}"))
    d = spark.createDataFrame(rows, "doc_id string, split string, text string")
    assert {(r.train_key, r.held_key) for r in overlap.cross_split_overlaps(d).collect()} == want
    assert {(r.train_key, r.held_key) for r in overlap.cross_split_overlaps(d, shard_words=3000).collect()} == want  # several shards


def test_shared_rows_of_words(spark):
    rng, rows = random.Random(7), []
    for i in range(80):
        rows.append((f"d{i}", rng.choice(["train", "train", "val", "test"]), rng.choice("ab"), " ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 60)))))
    rows += [("n1", None, "a", "x " * 20), ("n2", "val", None, None), ("n3", "val", "a", " ")]
    d = spark.createDataFrame(rows, "doc_id string, split string, source string, text string")
    got = {(r.split, r.source): (r.unique_overlapping_ngrams, r.overlapping_ngram_occurrences_train, r.ngrams) for r in overlap.shared_ngrams(overlap.numbered(d, "doc_id", "text", "split", "source"), 4).collect()}
    grams = lambda t: [tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)]
    train = Counter(g for _, s, _, t in rows if s == "train" for g in grams(t))
    want = defaultdict(set)
    for _, s, src, t in rows:
        if s in ("val", "test") and t:
            want[s, src] |= set(grams(t))
    assert got == {k: (len(v & set(train)), sum(train[g] for g in v if g in train), len(v)) for k, v in want.items() if v}


def test_decoding_undoes_encoding(spark):
    texts = ["", None, "plain words  here", "हिन्दी और English", "<|endoftext|>", "\n\n  x\t", "😀 e\u0301", "a" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids_of", F.lit(1))
    ids = bpe.encode_corpus(d)
    got = {r.doc_id: r.text for r in bpe.decode_corpus(ids).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode_corpus(ids.limit(0)).count() == 0
    assert bpe.decode_corpus(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")).select("text").distinct().count() == 1
