"""Exact and near duplicates, and the components that they form."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import MERSENNE, PERMUTATIONS, ROWS, collapse, compare_form, fingerprint, hash28, shingles
from granary.operators.membership import key_filter, may_hold
from granary.session import cut


def exact_winners(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp and winner (the least key with that fingerprint); rows without text have neither.

    The winner is aggregated by fingerprint before it is joined back, so a text that a third of all rows hold is counted
    down in each task first.
    """
    x = df.select(F.col(key), F.when(F.length(collapse(F.col(text))) > 0, fingerprint(F.col(text))).alias("fp"))
    won = x.where("fp IS NOT NULL").groupBy("fp").agg(F.min(key).alias("winner"), F.count("*").alias("copies"))
    return x.join(won, "fp", "left")


def first_copies(df: DataFrame, key: str, content: str, hashes: DataFrame | None = None) -> DataFrame:
    """The rows of df that are the first, by key, of those with their content (a hash); one row where that key is there again.

    Only hashes are shuffled to be counted. A filter of those that occur again, of bounded size, parts the rows: what it does
    not hold is single and stays where it is; the few others are joined to the first of their content. hashes: key and content
    of df, where they are at hand.
    """
    twice = cut((df if hashes is None else hashes).groupBy(content).agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col(content).alias("_c"), "_first"))
    x = df.withColumn("_h", F.xxhash64(content))
    again = may_hold(x, "_h", key_filter(twice.select(F.xxhash64("_c").alias("g"))))
    single = again.where("NOT _held").select(*df.columns)
    copies = again.where("_held").join(twice, F.col(content) == F.col("_c"), "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(key))).select(*df.columns).dropDuplicates([key, content])
    return single.unionByName(copies)


#: Counters of the sketch by which shingles are ordered: 8 MB, whatever the corpus. Fewer tell frequent shingles from rare ones less well,
#: so more texts meet (with 2^17, disk rose from 4.89 to 7.81 times the input).
COUNTERS = 1 << 20


def frequency_sketch(arrays: DataFrame) -> np.ndarray:
    """How often the elements of the only column, arrays of longs, occur, each counter standing for all that fall on it. Every
    task counts its own rows; what is brought together is a counter for each bucket."""

    def count(batches):  # noqa: ANN001, ANN202
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(n[at[i : i + 100_000]])], ["bucket", "n"])

    counts = arrays.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for r in counts.groupBy(F.floor(F.col("bucket") / 8192).alias("part")).agg(F.collect_list(F.struct("bucket", "n")).alias("c")).toLocalIterator():
        out[[c.bucket for c in r.c]] = [c.n for c in r.c]
    return out


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """k, h (hash of the text in comparable form) and t of each row that has a key and a text."""
    x = df.select(F.col(key).alias("k"), compare_form(F.col(text)).alias("t")).where("length(t) > 0 AND k IS NOT NULL")
    return x.select("k", F.md5(F.encode("t", "UTF-8")).alias("h"), "t")


def jaccard_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, hashes: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard) of distinct texts, a < b, whose character shingles agree in ``least``: complete, without banding.

    Shingles are ordered by how often they occur, as a sketch of bounded size tells it, then by hash: any one order will do.
    Each text offers only as many of its first ones as it must for a pair of this similarity to meet (prefix filter), and sizes
    must fit too. Only offers are shuffled, and the shingles of texts that meet. Of the copies of a text the first takes part.
    """
    x = first_copies(_hashed(df, key, text), "k", "h", hashes)
    x = cut(x.select("k", F.transform(shingles(F.col("t")), lambda g: F.xxhash64(g)).alias("g")))
    shared = df.sparkSession.sparkContext.broadcast(frequency_sketch(x.select("g")))
    kind = x.schema["k"].dataType

    def offered(batches):  # noqa: ANN001, ANN202
        for b in batches:
            arrays = b.column(1)
            g = arrays.flatten().to_numpy(zero_copy_only=False)
            size = arrays.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((g, shared.value[g & (COUNTERS - 1)], of))
            place = np.arange(len(of)) - (np.cumsum(size) - size)[of]
            first = place < (size - np.ceil(size * least - 1e-9).astype(np.int64) + 1)[of]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[first])), pa.array(size[of[first]]), pa.array(g[order][first])], ["k", "n", "g"])

    offer = x.mapInArrow(offered, T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType()), T.StructField("g", T.LongType())]))
    a, b = (offer.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), "g") for c in "ab")
    pairs = cut(a.join(b, "g").where(f"a < b AND least(na, nb) >= {least} * greatest(na, nb)").select("a", "b").distinct())
    met = may_hold(x.withColumn("_h", F.xxhash64("k")), "_h", key_filter(pairs.select(F.explode(F.array("a", "b")).alias("g")).select(F.xxhash64("g").alias("g")))).where("_held")
    ga, gb = (met.select(F.col("k").alias(c), F.col("g").alias(f"g{c}")) for c in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    out = pairs.join(ga, "a").join(gb, "b").select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("jaccard"))
    return out.where(F.col("jaccard") >= least)


def verified_links(df: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """(a, b, jaccard), a < b: the pairs of ``jaccard_pairs``, and the first of the copies of a text tied to the others."""
    hashes = cut(_hashed(df, key, text).select("k", "h"))
    first = hashes.groupBy("h").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1")
    copies = hashes.join(first, "h").where("k > a").select("a", F.col("k").alias("b"), F.lit(1.0).alias("jaccard"))
    return jaccard_pairs(df, key, text, least, hashes).unionByName(copies)


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """(node, root, least_similarity): every document of a cluster of verified links, the cluster's first document, which is
    kept, and the least similarity of a link of the cluster. Documents without a link are in no cluster."""
    links = cut(verified_links(df, key, text, least))
    roots = cut(connected(links.select("a", "b")))
    low = links.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(F.min("jaccard").alias("least_similarity"))
    return roots.join(low, "root").select("node", "root", "least_similarity")


_A = np.array([1103515245 + 7919 * k for k in range(PERMUTATIONS)])[:, None]
_B = np.array([12345 + 104729 * k for k in range(PERMUTATIONS)])[:, None]


def _bands(hashes: list[int]) -> list[str]:
    """A key for each band of 8 of the 64 minima of (a x + b) mod p; the band's number is part of it."""
    least = ((_A * np.array(hashes)[None, :] + _B) % MERSENNE).min(axis=1).tolist()
    return [f"{b}:" + hashlib.md5(",".join(map(str, least[b * ROWS : (b + 1) * ROWS])).encode()).hexdigest() for b in range(PERMUTATIONS // ROWS)]


def band_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, band) of the MinHash signature of each text; texts without shingles have none.

    Shingles are hashed in the JVM; the 64 minima of a text's hashes, some 8,000 steps, are taken on whole arrays by Arrow
    batches.
    """
    x = df.select(F.col(key).alias("k"), F.transform(shingles(compare_form(F.col(text))), hash28).alias("h"))
    schema = T.StructType([T.StructField("k", x.schema["k"].dataType), T.StructField("band", T.StringType())])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(k, band) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h for band in _bands(h)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], b.schema.field(0).type), pa.array([x for _, x in rows], pa.string())], ["k", "band"])

    return x.mapInArrow(run, schema)


def band_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): the least key of each band, and every other key with it. Never all pairs of a band."""
    k = cut(band_keys(df, key, text))
    first = k.groupBy("band").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1")
    return k.join(first, "band").where("k > a").select("a", F.col("k").alias("b")).distinct()


#: Nodes of a local forest.
LOCAL = 1_000_000


def forest(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Union-find within each partition, as it lies: its edges (a, b) become stars (a: node, b: the least node of its tree).

    A task holds at most ``local`` nodes and one batch more: a full forest is given out and a new one begun, which leaves the
    components as they are.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):  # noqa: ANN001, ANN202
        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while (y := up.get(x, x)) != x:
                up[x] = y = up.get(y, y)
                x = y
            return x

        def stars(t: pa.DataType):  # noqa: ANN202
            nodes = list(up)
            for i in range(0, len(nodes), 50_000):
                part = [(x, r) for x in nodes[i : i + 50_000] if (r := root(x)) != x]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], t), pa.array([r for _, r in part], t)], ["a", "b"])
            up.clear()

        t = None
        for batch in batches:
            t = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = root(a), root(b)
                up.setdefault(a, a), up.setdefault(b, b)
                if ra < rb:
                    up[rb] = ra
                elif rb < ra:
                    up[ra] = rb
            if len(up) > local:
                yield from stars(t)
        if up:
            yield from stars(t)

    return edges.select("a", "b").mapInArrow(run, schema)


def merge_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of components known so far (node, root) after further links (a, b) have come: only the ends of the links and
    the roots are worked on again, other members follow their root."""
    of = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    at = lambda x, c: x.join(of, x[c] == of["_n"], "left").withColumn(c, F.coalesce("_r", c)).drop("_n", "_r")
    ends = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    moved = cut(connected(at(at(links.select("a", "b"), "a"), "b")))
    every = roots.select("node", "root").unionByName(ends.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return every.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges (a, b), root being the least node: large and small stars in turn.

    Each task first turns its edges into a local forest, so that short ways are gone before the first shuffle. Each round passes a node's larger neighbours to its least one, so a hub's work is one aggregation; rounds are cut in the
    shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    x = cut(forest(edges.select("a", "b").where("a <> b")).distinct())
    last = None
    for _ in range(rounds):
        both = x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        x = cut(least.select("a", F.col("m").alias("b")).unionByName(small).distinct())
        now = x.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last and now.n == now.k:
            roots = x.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return x.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        last = now
    raise RuntimeError("components did not settle")
