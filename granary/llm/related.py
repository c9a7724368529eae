"""Problem 4: splits that keep related records together.

Records are related by a work, a credited writer or a cited dossier. Each gives a key; records that share a key, directly
or through others, form a group.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrowmap import map_rows
from granary.llm.fold import fold
from granary.llm.words import DIGITS, TAG, plain
from granary.operators.dedup import LOCAL, forest
from granary.session import cut

# Devanagari letters in Latin; the other Indic scripts lie at the same places of their blocks.
CONSONANTS = dict(
    zip(
        "कखगघङचछजझञटठडढणतथदधनपफबभमयरऱलळऴवशषसह",
        "k kh g gh n ch chh j jh n t th d dh n t th d dh n p f b bh m y r r l l l v sh sh s h".split(),
    )
)
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍऎऒ", "a a i i u u ri e ai o au o e e o".split()))
SIGNS = dict(zip("ािीुूृेैोौॉॅॆॊ", "a i i u u ri e ai o au o e e o".split()))
NUKTA = {"j": "z", "f": "f", "k": "k", "kh": "kh", "g": "g", "d": "d", "dh": "dh", "y": "y"}
BLOCKS = (0x980, 0xA00, 0xA80, 0xB00, 0xC00, 0xC80)


def latin(word: str) -> str:
    """A word in small Latin letters; words of Indic scripts are written out by sound, accents are dropped."""
    out, w = [], []
    for c in unicodedata.normalize("NFC", word):
        o = ord(c)
        if o < 0x900:
            w += unicodedata.normalize("NFD", c)
            continue
        for b in BLOCKS:
            if b <= o < b + 0x80:
                c = {0xA70: "ं", 0xA71: ""}.get(o) if o in (0xA70, 0xA71) else chr(o - b + 0x900)
                break
        w += c
    i = 0
    while i < len(w):
        c = w[i]
        i += 1
        if c in CONSONANTS:
            s = CONSONANTS[c]
            while i < len(w) and w[i] == "़":
                s = NUKTA.get(s, s)
                i += 1
            if i < len(w) and w[i] in SIGNS:
                s += SIGNS[w[i]]
                i += 1
            elif i < len(w) and w[i] == "्":
                i += 1
            elif i < len(w) and (w[i] in CONSONANTS or w[i] in "ंँः"):
                s += "a"  # the vowel unwritten inside a word; at its end it isn't spoken
            out.append(s)
        elif c in VOWELS:
            out.append(VOWELS[c])
        elif c in "ंँ":
            out.append("n")
        elif c < "̀":
            out.append(c.lower())
    return "".join(out)


def name_key(word: str) -> str:
    """One key for the spellings of a surname in any script: sounds that scripts or spellings don't tell apart are one."""
    s = re.sub(r"[^a-z]", "", latin(fold(word)))
    for a, b in (("ph", "f"), ("w", "v"), ("x", "ks"), ("q", "k"), ("z", "j"), ("v", "b"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("y", "i")):
        s = s.replace(a, b)
    s = re.sub(r"ao$", "ab", s)  # Rao, Rav
    s = re.sub(r"m(?=[bp])", "n", s)
    s = re.sub(r"(.)\1+", r"\1", s)
    return s


# Words that credit a writer, by place; the same words in the Indic scripts are reached through latin().
BEFORE = {"by", "writtenby", "author", "lekhak", "lekhan", "lekhika", "rachna", "rachana", "signed", "textby", "text", "writer", "storyby", "writteninthehandof", "inthehandof", "kavi", "rachayita", "rachnakar", "words", "wordsby"}
AFTER = {"lekhak", "lekh", "lekhika", "dvaralikhit", "dbaralikhit", "author", "writer", "fromthepapers", "rachna", "rachana", "lekhan"}
FIRST = {"author", "rachna", "rachana"}
_LETTERS = re.compile(r"[^a-z]")
_DOSSIER = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[\s\-/.:_]{0,3}(\d{2})\s?(\d{3})(?!\d)")
_CITES = re.compile(r"dossier|ref\b|patrabali|patrabli|patravali|patravli|file|docket|case", re.I)
_INDIC = re.compile(r"[ऀ-ൿ]+")
_TAIL = re.compile(r"[\s(\[]*(?:re:?\s*|see\s*)?(?:dossier|ref\.|file\s+no)(?!\w).*$|[\s(\[]*(?:पत्रावली|পত্রাবলী|પત્રાવલી|ਪਤ੍ਰਾਵਲੀ|పత్రావలీ|పత్రావళి).*$", re.I)
_MARKUP = re.compile(r"\*\*|__|'''?|\[\[|\]\]|\{\{[^{}]*\}\}|`|^#+\s|^=+|=+$|^>\s")


#: A credit is a line of its own of at most so many words: with a cited dossier, if it ends like a sentence, and without either.
LINE_WORDS, SENTENCE_WORDS, CREDIT_WORDS = 20, 8, 12


@lru_cache(100_000)
def _squeezed(s: str) -> str:
    return _LETTERS.sub("", "".join(latin(x) for x in s.split()))


def _surname(name: str, first: bool = False) -> str | None:
    """The surname of "Given Surname", "Surname, Given", "G. Surname" or a bare surname; None if this isn't a name.

    first: the credit puts the surname first; if its comma is lost, the longer word counts.
    """
    name = name.strip(" \t.~—–-*_\"“”()[]|:;").strip()
    if not name or any(c.isdigit() for c in name):
        return None
    head, comma, tail = name.partition(",")
    words = (head if comma else name).split()
    if not words or len(words) + len(tail.split()) > 4:
        return None
    if comma and not tail.strip():
        comma = ""
    key = max(map(name_key, words), key=len) if first and not comma else name_key(words[-1])
    return key if len(key) >= 2 else None


def writers(text: str) -> list[str]:
    """Keys of those credited with the text: lines that hold nothing but a credit. Reviewers, editors, printers and
    people in the prose aren't credited."""
    out = []
    for line in re.split(r"[\r\n]+", text):
        line = line.strip()
        if not line or line.count(" ") >= LINE_WORDS or (line.count(" ") >= SENTENCE_WORDS and line[-1] in ".?!।॥"):
            continue
        line = _TAIL.sub("", _MARKUP.sub("", line)).strip()
        if not line or line.count(" ") >= CREDIT_WORDS or line[-1] in "?!।॥":
            continue
        got = None
        m = re.match(r"^([—–~\-]+|\()\s*(.*?)\s*([~)—–\-]*)$", line)
        if m and m.group(2):
            inner = m.group(2).rstrip(".")
            head, comma, tail = inner.rpartition(",")
            if comma and _squeezed(tail) in AFTER:
                got = _surname(head)
            elif not comma and _squeezed(inner.split()[-1]) in AFTER:
                got = _surname(" ".join(inner.split()[:-1]))
            elif len(inner.split()) <= 3 and _plain_name(inner):
                got = _surname(inner)
        if got is None:
            m = re.match(r"^(.+?)\s*:\s*(.+)$", line)
            if m and _squeezed(m.group(2)) in AFTER:
                got = _surname(m.group(1))
        if got is None:
            m = re.match(r"^(.{2,40}?)\s*(?:[:：©]|\s[-—–]|,)\s*(.+)$", line)
            if m and _squeezed(m.group(1).replace("©", "")) in BEFORE:
                got = _surname(m.group(2), _squeezed(m.group(1)) in FIRST)
            elif m and _squeezed(m.group(2)) in AFTER:
                got = _surname(m.group(1))
        if got is None:
            m = re.match(r"^(written\s+by|written\s+in\s+the\s+hand\s+of|by|text\s*©)\s+(.+)$", line, re.I)
            if m and _plain_name(m.group(2)):
                got = _surname(m.group(2))
        if got is None:
            m = re.match(r"^(.+?)\s*[—–-]\s*(\S+)$", line)
            if m and _squeezed(m.group(2)) in AFTER:
                got = _surname(m.group(1))
        if got is None and _INDIC.search(line):
            words = line.split()
            for n in (1, 2):
                if len(words) > n and len(words) <= n + 3 and _squeezed("".join(words[-n:])) in AFTER:
                    got = _surname(" ".join(words[:-n]))
                    break
        if got:
            out.append(got)
    return out


def _plain_name(s: str) -> bool:
    """One to three words of letters (initials and a comma allowed), as names have."""
    words = s.replace(",", " ").split()
    return 1 <= len(words) <= 3 and all(re.fullmatch(r"[^\W\d_](?:[^\s\d:;!?।॥()\[\]{}<>@#/\\=+|]*)", w) for w in words)


def dossiers(text: str) -> list[str]:
    """Cited dossiers: two letters and five digits after a word that cites one, or both letters capitals."""
    out = []
    for m in _DOSSIER.finditer(text):
        before = text[max(0, m.start() - 16) : m.start()]
        if m.group(1).isupper() or _CITES.search(before) or _CITES.search(latin(before)):
            out.append((m.group(1) + (m.group(2) + m.group(3)).translate(DIGITS)).upper())
    return out


def work_of(doc_id: str) -> str:
    """The work of a doc_id: its middle, in small letters, with one hyphen for whatever stands between words."""
    parts = doc_id.split(":")
    middle = ":".join(parts[1:-1]) if len(parts) > 2 else doc_id
    return re.sub(r"[\W_]+", "-", fold(middle).lower().translate(DIGITS)).strip("-")


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def record_keys(doc_id: str, text: str | None) -> tuple[int, list[int]]:
    """The hashed key of the work, and those of the writers and dossiers."""
    t = plain(text) if text else ""
    rest = {f"a:{x}" for x in writers(t)} | {f"d:{x}" for x in dossiers(t)} if t else set()
    return _hash(f"w:{work_of(doc_id)}"), sorted(map(_hash, rest))


def keyed_records(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, work and keys of each record, once per doc_id. Null keys are left out; null and blank texts have a work only."""

    def start():  # noqa: ANN202
        def f(k, t):  # noqa: ANN001
            if k is not None:
                w, rest = record_keys(k, t)
                yield k, w, rest

        return f

    x = map_rows(df.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id string, work bigint, keys array<bigint>", start)
    return x.groupBy("doc_id").agg(F.min("work").alias("work"), F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"))


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, root) of each node of edges (a, b: bigint) that isn't its component's least node.

    Each task first turns its edges into a local forest. The forests are then merged level by level: edges are grouped by
    their node, each node keeps the least it is tied to and passes the others on to that one (large and small stars in
    turn), and every merge runs local union-find again on the edges as they lie, never gathered by root: a component may
    hold most of all nodes, a task holds its part of them. A level ends in the shared folder. A hub's edges are halved by
    map-side aggregation, since only the least counts, and its joins are split by adaptive skew joins.
    """
    x = cut(forest(edges.select("a", "b").where("a <> b"), local).distinct())
    last = None
    for _ in range(rounds):
        both = x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        merged = forest(low.select("a", F.col("m").alias("b")).unionByName(small), local)
        x = cut(merged.distinct())
        state = x.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if state == last and state.n == state.nodes:
            return x.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
    raise RuntimeError("components did not settle")


def related_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group_id (the least doc_id of the group, in code-point order) and records (of the group), one row a record."""
    keyed = cut(keyed_records(df, key, text))
    # Two records are tied through keys, so the graph is one of keys: each record ties its work to its other keys.
    edges = keyed.select(F.col("work").alias("a"), F.explode("keys").alias("b")).where("a <> b").distinct()
    roots = components(edges)
    x = keyed.join(roots, keyed.work == roots.node, "left").select("doc_id", F.coalesce("root", "work").alias("g"))
    named = x.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("records"))
    return x.join(named, "g").select("doc_id", "group_id", "records")


def _share(sizes: list[tuple[int, int]], goal: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """Largest first, each group to the split furthest below its goal: (size, from, to, split) of ranks among equals.

    Of n groups of one size, taking the split furthest below n times is taking the n largest of left, left - size, left -
    2 size, ... of all splits. All of these that lie a size above the common level that n groups would bring the splits
    to are among them; the others, fewer than splits, are dealt one by one.
    """
    left, names, out = dict(goal), sorted(goal), []
    for size, n in sizes:
        high, level = sorted(left.values(), reverse=True), 0.0
        for k in range(1, len(high) + 1):  # the level that the k splits furthest below come to
            level = (sum(high[:k]) - n * size) / k
            if k == len(high) or level >= high[k]:
                break
        take = {s: max(0, int((left[s] - level) // size)) for s in names}
        while sum(take.values()) > n:  # rounding
            take[min((s for s in names if take[s]), key=lambda s: left[s] - take[s] * size)] -= 1
        for _ in range(n - sum(take.values())):
            take[max(names, key=lambda s: (left[s] - take[s] * size, s))] += 1
        at = 0
        for s in names:
            if take[s]:
                out.append((size, at, at + take[s], s))
                at, left[s] = at + take[s], left[s] - take[s] * size
    return out


def ranked(df: DataFrame, by: str, order: str, out: str = "rank") -> DataFrame:
    """df with the place (from 0) of each row among those of equal by, in the order of order (which should be unique).

    Equals may be most of all rows: rows are range-partitioned by both, numbered in their partition, and shifted by what
    the partitions before hold. Only counts per partition and value reach the driver.
    """
    x = cut(df.repartitionByRange(F.col(by), F.col(order)).sortWithinPartitions(by, order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    part = x.groupBy("_p", by).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("_p", by, (F.col("_first") - before).alias("_shift"))
    return x.join(part, ["_p", by]).withColumn(out, F.col("_i") - F.col("_shift")).drop("_p", "_i", "_shift")


def grouped_split(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """groups (doc_id, group_id, records) with split: whole groups, largest first to the split furthest below its share.

    plan has split, fraction and seed; fractions are taken relative to their sum, the seed orders groups of equal size. Only
    the number of groups of each size reaches the driver (at most the square root of twice the records, as sizes differ).
    """
    rows = plan.where("split IS NOT NULL AND fraction > 0").select("split", "fraction", "seed").collect()
    if not rows:
        raise ValueError("the plan names no split")
    each = groups.groupBy("group_id").agg(F.max("records").alias("records"))
    sizes = sorted(((r.records, r.n) for r in each.groupBy("records").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, whole = sum(s * n for s, n in sizes), sum(r.fraction for r in rows)
    spark = groups.sparkSession
    shares = spark.createDataFrame(_share(sizes, {r.split: total * r.fraction / whole for r in rows}), "records bigint, lo bigint, hi bigint, split string")
    seed = str(rows[0].seed)
    order = each.withColumn("_o", F.concat(F.md5(F.concat(F.lit(seed + ":"), "group_id")), "group_id"))
    placed = ranked(order, "records", "_o").join(shares, "records").where("rank >= lo AND rank < hi").select("group_id", "split")
    return groups.join(placed, "group_id")
