"""Problem 6: records of evaluation splits that occur again, exactly or almost, in train.

Sketches of their bags of words give, for every training text, all evaluation records that can have enough words in common with
it; those are compared with it word by word. The records of one shard go along with their words and are compared where they are
found; of more shards only the sketches go along, several shards together, and what they let pass is joined with its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.llm.words import LINES, plain, split_words
from granary.operators.membership import held_by, key_filter
from granary.session import cut

#: Words of evaluation text in a shard: bounds what is broadcast (4 bytes a word).
SHARD_WORDS = 8_000_000
#: Shards whose sketches (some 0.35 bytes a word, so 90 MB) are broadcast together.
SKETCHED = 32
_IDS: dict[str, int] = {}


def word_id(w: str) -> int:
    got = _IDS.get(w)
    if got is None:
        got = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        if len(_IDS) < 500_000:
            _IDS[w] = got
    return got


_TOKENS: dict[str, list[int]] = {}


def _ids_of(line: str) -> list[int]:
    """Numbers of the words of a line already plain; what stands between white space is worked on once and kept."""
    out: list[int] = []
    for x in line.split():
        got = _TOKENS.get(x)
        if got is None:
            got = [word_id(w) for w in split_words(x)]
            if len(_TOKENS) < 300_000 and len(x) < 60:
                _TOKENS[x] = got
        out += got
    return out


def lines_of_ids(text: str) -> list[list[int]]:
    """Numbers of the words of each line that has any."""
    return [x for x in map(_ids_of, LINES.split(plain(text))) if x]


def packed(lines: list[list[int]]) -> bytes:
    """Lines as 4-byte numbers, a 0 after each line."""
    return np.fromiter((w for x in lines for w in (*x, 0)), np.uint32).tobytes()


def unpacked(data: bytes) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for w in np.frombuffer(data, np.uint32).tolist():
        if w:
            out[-1].append(w)
        else:
            out.append([])
    return out[:-1]


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, 64 and more words at a step by bits of an integer."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    get = at.get
    for w in b:
        m = get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _in_order_of(a: list[list[int]], b: list[list[int]]) -> list[int]:
    """The words of b, its lines put in the order of the lines of a that they share most words with."""
    words = [Counter(x) for x in a]
    order = []
    for j, line in enumerate(b):
        c = Counter(line)
        best, k = 0, -1
        for i, w in enumerate(words):
            n = (c & w).total()
            if n > best:
                best, k = n, i
        order.append((k, j))
    return [w for _, j in sorted(order) for w in b[j]]


def almost_same(a: list[list[int]], b: list[list[int]], share: float) -> bool:
    """Whether the lines a and b have ``share`` of the longer text's words in common in one order, lines in any order."""
    x, y = [w for line in a for w in line], [w for line in b for w in line]
    need = share * max(len(x), len(y)) - 1e-9
    if min(len(x), len(y)) < need or (Counter(x) & Counter(y)).total() < need:
        return False
    if common_in_order(x, y) >= need:
        return True
    return (len(a) > 1 or len(b) > 1) and (common_in_order(x, _in_order_of(a, b)) >= need or common_in_order(y, _in_order_of(b, a)) >= need)


def _repeats(sorted_: np.ndarray) -> np.ndarray:
    """The number of each element of a sorted array among its equals."""
    n = np.arange(len(sorted_))
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return (n - np.maximum.accumulate(n * new)).astype(np.uint64)


#: Words of training text looked up together; pairs whose sketches are compared at once, and training texts among them: what a
#: task holds beside the sketches.
TOGETHER, PAIRS, ROWS = 1_000_000, 1 << 16, 16
#: Groups of records of much the same words (languages, for the most part); the frequent words and the records that groups are
#: made from, and the most words of such a record; the most other words, as a part, of a record that is put into a group. All of
#: them bear on time only.
GROUPS, FREQUENT, LEADERS, LEADER_WORDS, OTHERS = 16, 4096, 1024, 10_000, 0.4
#: Bits of a sketch for each word.
BITS = 1.75


def _words(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint32)
    return x[x > 0]


def _tokens_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of many texts one after another, those of each in order, and their numbers. A token is a word with its number
    among the same words of the text, so that what two texts have in common is counted as sets."""
    n = np.array(list(map(len, texts)), np.int64)
    key = np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(32)
    key = np.sort(key | np.concatenate([*texts, np.empty(0, np.uint32)]))
    return key << np.uint64(32) | _repeats(key), n


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of so many rows of x at a time."""
    out = np.zeros((len(n), x.shape[1]), np.int64)
    if len(x):
        out[n > 0] = np.add.reduceat(x, (np.cumsum(n) - n)[n > 0], axis=0, dtype=np.int32)
    return out


def _width(n: np.ndarray) -> np.ndarray:
    """Longs of the sketch of a record of n words: some two bits a word, in steps of an eighth at most."""
    longs = np.maximum(np.ceil(n * BITS / 64), 2).astype(np.int64)
    step = np.left_shift(1, np.maximum(np.floor(np.log2(longs)).astype(np.int64) - 3, 0))
    return -(-longs // step) * step


def _sketches(tokens: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """A sketch of ``width`` longs, a row, for so many tokens at a time: each bit is the parity of the tokens that fall on it, so
    two sketches differ in no more bits than the texts differ in tokens."""
    bits = 64 * width
    with np.errstate(over="ignore"):
        at = (((tokens ^ (tokens >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % bits
    out = np.empty((len(n), width), np.uint64)
    ends, step = np.cumsum(n), max(1, (1 << 20) // bits)
    for i in range(0, len(n), step):
        k = n[i : i + step]
        part = at[ends[i] - n[i] : ends[i + len(k) - 1]]
        odd = np.bincount(np.repeat(np.arange(len(k)) * bits, k) + part, minlength=len(k) * bits) & 1
        out[i : i + len(k)] = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(k), width)
    return out


_XOR, _COUNT = np.empty(PAIRS, np.uint64), np.empty((2, PAIRS), np.uint8)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each row of a differs from each column of b; 0 stands for 256, too, which a byte cannot hold."""
    width, shape = a.shape[1], (len(a), b.shape[1])
    size = shape[0] * shape[1]
    xor, (first, count) = _XOR[:size].reshape(shape), (x[:size].reshape(shape) for x in _COUNT)
    total, step = None, 4 if width == 4 else 3  # counts are added in bytes as far as bytes hold them
    for i in range(0, width, step):
        for k in range(i, min(i + step, width)):
            np.bitwise_xor(a[:, k : k + 1], b[k], out=xor)
            np.bitwise_count(xor, out=first if k == i else count)
            if k > i:
                np.add(first, count, out=first)
        if width <= step:
            return first
        total = first.astype(np.int32) if total is None else np.add(total, first, out=total)
    return total


class Groups:
    """Groups of texts by their frequent words, made from a sample of records."""

    def __init__(self, sample: list[bytes]):
        own, n = _tokens_of([_words(x) for x in sample])
        tokens, at, often = np.unique(own, return_inverse=True, return_counts=True)
        top = np.sort(np.argsort(-often, kind="stable")[:FREQUENT])
        self.tokens = tokens[top]
        place = np.full(len(tokens), -1)
        place[top] = np.arange(len(top))
        place, row = place[at], np.repeat(np.arange(len(n)), n)
        has = np.zeros((len(n), len(top)), np.float32)
        has[row[place >= 0], place[place >= 0]] = 1
        alike = has @ has.T
        alike = alike >= 0.3 * np.sqrt(np.outer(alike.diagonal(), alike.diagonal()).clip(1))
        self.common = np.zeros((len(top) + 1, GROUPS), np.uint8)  # of each token, the groups that it is common in; the last stands for all others
        left = np.ones(len(n), bool)
        for g in range(GROUPS - 1):
            if not left.any():
                break
            mine = alike[np.argmax(np.where(left, alike[:, left].sum(1), -1))] & left
            self.common[:-1, g] = has[mine].any(0)
            left &= ~mine

    def shared(self, own: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each text, how many of its tokens are common in each group."""
        if not len(self.tokens):
            return np.zeros((len(n), GROUPS), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        return _sums(self.common[np.where(self.tokens[at] == own, at, len(self.tokens))], n)

    def of(self, own: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The group of each text; the last for those with too many words that are not common in any other."""
        shared = self.shared(own, n)[:, : GROUPS - 1]
        best = shared.argmax(1)
        return np.where(n - shared[np.arange(len(n)), best] <= OTHERS * n, best, GROUPS - 1)


def sketched(groups: Groups, numbers: list[int], texts: list[bytes]) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """(longs of a sketch, group, numbers, sizes, sketches) of many records at once."""
    own, n = _tokens_of([_words(x) for x in texts])
    group, width, starts, numbers = groups.of(own, n), _width(n), np.cumsum(n) - n, np.array(numbers, np.int64)
    out = []
    for w, g in sorted(set(zip(width.tolist(), group.tolist()))):
        at = np.flatnonzero((width == w) & (group == g))
        out.append((w, g, numbers[at].tobytes(), n[at].tobytes(), _sketches(own[_ranges(starts[at], starts[at] + n[at])], n[at], w).tobytes()))
    return out


class Sketches:
    """The sketches of evaluation records, and which of them may be almost the same as a text.

    Two texts that are almost the same have at least ``share`` of the longer one's words in common, so they differ in a bounded
    number of tokens and their sketches in no more bits. The sketch of a text is compared with those of all records of fitting
    size, but for groups of which no record can hold enough of its words. Every pair that can reach ``share`` is thus found.
    """

    def __init__(self, groups: Groups, parts: list[tuple[int, int, bytes, bytes, bytes]], share: float):
        self.groups, self.share = groups, share
        together: dict[tuple[int, int], list[tuple[bytes, bytes, bytes]]] = {}
        for w, g, *x in parts:
            together.setdefault((w, g), []).append(tuple(x))
        self.blocks = []  # longs of a sketch, group, numbers of records, their sizes in order, a row for each long
        for (w, g), x in sorted(together.items()):
            numbers, size, sketch = (np.frombuffer(b"".join(y), kind) for y, kind in zip(zip(*x), (np.int64, np.int64, np.uint64)))
            order = np.argsort(size, kind="stable")
            self.blocks.append((w, g, numbers[order], size[order], np.ascontiguousarray(sketch.reshape(-1, w)[order].T)))

    def _need(self, n):  # noqa: ANN001, ANN202
        """Words that a text of n words must have in common with another."""
        return np.maximum(np.ceil(self.share * n - 1e-9), 1).astype(np.int64)

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(text, number of the record): all that can have enough words in common, each pair once."""
        words = [_words(t) for t in texts]
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(words[j]) <= TOGETHER):
                total += len(words[j])
                j += 1
            for t, r in self._candidates(words[i:j]):
                yield i + t, r
            i = j

    def _candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        own, n = _tokens_of(texts)
        need, longest, starts = self._need(n), ((n + 1e-9) / self.share).astype(np.int64), np.cumsum(n) - n
        # A record of a group has at most so many tokens that aren't common there; the last group can hold any.
        shared = self.groups.shared(own, n)
        can = shared + np.minimum(n[:, None] - shared, (OTHERS * longest + 1e-6).astype(np.int64)[:, None]) >= need[:, None]
        can[:, -1] = True
        can[n == 0] = False
        # Of all sizes that fit, those of a record as long, or of the longest, leave most tokens to differ.
        most = np.floor(n * max(2 - 2 * self.share, 1 / self.share - 1) + 1e-6).astype(np.int64)
        order, kept = np.argsort(n, kind="stable"), (0, None, None)
        for w, g, numbers, size, sketch in self.blocks:
            if kept[0] != w:  # the texts that records with sketches of this width can fit
                some = np.flatnonzero((_width(need) <= w) & (_width(longest) >= w))
                column = np.full(len(n), -1)
                column[some] = np.arange(len(some))
                kept = w, column, _sketches(own[_ranges(starts[some], starts[some] + n[some])], n[some], w)
            todo = order[(can[:, g] & (need <= size[-1]) & (longest >= size[0]) & (kept[1] >= 0))[order]]
            for i in range(0, len(todo), ROWS):
                t = todo[i : i + ROWS]
                low, high = int(np.searchsorted(size, need[t[0]])), int(np.searchsorted(size, longest[t[-1]], "right"))
                mine = kept[2][kept[1][t]]
                for j in range(low, high, PAIRS // ROWS):
                    differ = _differ(mine, sketch[:, j : min(j + PAIRS // ROWS, high)])
                    a, b = np.divmod(np.flatnonzero(differ <= np.minimum(most[t], np.iinfo(differ.dtype).max).astype(differ.dtype)[:, None]), differ.shape[1])
                    if len(a):
                        p, q = n[t[a]], size[j + b]
                        common = self._need(np.maximum(p, q))
                        fits = (np.minimum(p, q) >= common) & (differ[a, b] <= p + q - 2 * common)
                        yield from zip(t[a[fits]].tolist(), numbers[j + b[fits]].tolist())


class Shard:
    """A block of evaluation records with their words, and which of them are almost the same as a text."""

    def __init__(self, records: list[tuple[int, bytes]], share: float):
        self.share, self.records = share, records
        texts = [data for _, data in records]
        groups = Groups([x for x in texts if len(x) <= 4 * LEADER_WORDS][:: -(-len(texts) // LEADERS) or 1])
        parts = [x for i in range(0, len(texts), 10_000) for x in sketched(groups, range(i, min(i + 10_000, len(texts))), texts[i : i + 10_000])]
        self.sketches = Sketches(groups, parts, share)

    def find(self, texts: list[bytes]) -> list[list[int]]:
        """For each text (packed lines), the evaluation records that are almost it."""
        out: list[list[int]] = [[] for _ in texts]
        last, lines = -1, None
        for t, r in self.sketches.candidates(texts):
            if t != last:
                last, lines = t, unpacked(texts[t])
            if almost_same(unpacked(self.records[r][1]), lines, self.share):
                out[t].append(r)
        return [[self.records[r][0] for r in sorted(x)] for x in out]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each low up to its high."""
    n = np.maximum(high - low, 0)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def numbered(df: DataFrame, key: str, text: str, *rest: str) -> DataFrame:
    """key, ids (packed lines of word ids) and the columns rest of each row whose text has words."""
    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*fields, *(T.StructField(c, df.schema[c].dataType) for c in rest)])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(i, lines_of_ids(t)) for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if k is not None and t]
            rows = [(i, packed(x)) for i, x in rows if x]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([x for _, x in rows], pa.binary()), *(b.column(2 + j).take(at) for j in range(len(rest)))], ["key", "ids", *rest])

    return df.select(F.col(key), F.col(text).cast("string"), *rest).mapInArrow(run, schema)


def cross_split_overlaps(df: DataFrame, key: str = "doc_id", text: str = "text", split: str = "split", train: str = "train", held_out: tuple[str, ...] = ("val", "test"), share: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_key, held_key), each pair once, whose texts have ``share`` of the longer one's words in common in one order.

    Case, punctuation, spacing, markup, disguised characters and the order of lines don't count. The held-out records are
    grouped by their exact words first, so a text that many records hold is scanned for once. Up to ``shard_words`` words (and
    one record) of them are broadcast; beyond that their sketches, of ``SKETCHED`` times as many words at a time. Training
    texts aren't shuffled, but for those that a sketch lets pass: each task scans its rows. Rows with null key or split, other
    splits, and texts without words give nothing.
    """
    held = numbered(df.where(F.col(split).isin(*held_out)), key, text)
    trains = df.where(F.col(split) == train).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return overlaps(held, trains, share, shard_words)


def overlaps(held: DataFrame, trains: DataFrame, share: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_key, held_key) from held (key, ids) and trains (key, text or ids)."""
    spark = held.sparkSession
    keyed = cut(held.select("key", "ids", F.xxhash64("ids").alias("r")))
    held = keyed.groupBy("r").agg(F.min("ids").alias("ids")).withColumn("w", F.octet_length("ids") / 4)
    total = held.agg(F.sum("w").alias("w")).first()
    n_shards = -(-int(total.w or 0) // shard_words)
    if not n_shards:
        kind = keyed.schema["key"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("train_key", kind), T.StructField("held_key", kind)]))
    if n_shards == 1:
        found = _scan(trains, _shard_finder([(r.r, r.ids) for r in held.select("r", "ids").toLocalIterator()], share, spark), "r bigint")
    else:
        found = _by_sketches(held, trains, share, -(-n_shards // SKETCHED))
    found = found.join(keyed.select("r", F.col("key").alias("held_key")), "r")
    return found.select("train_key", "held_key").distinct()


_SHARDS: dict[str, Shard] = {}


def _shard_finder(rows: list[tuple[int, bytes]], share: float, spark) -> Callable[[list[bytes]], list[list[tuple]]]:  # noqa: ANN001
    shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

    def find(texts: list[bytes]) -> list[list[tuple]]:
        shard = _SHARDS.get(name)
        if shard is None:
            _SHARDS.clear()
            shard = _SHARDS[name] = Shard(shared.value, share)
        return [[(r,) for r in x] for x in shard.find(texts)]

    return find


def _sketch_finder(sketches: Sketches, spark) -> Callable[[list[bytes]], list[list[tuple]]]:  # noqa: ANN001
    shared = spark.sparkContext.broadcast(sketches)

    def find(texts: list[bytes]) -> list[list[tuple]]:
        out: list[list[tuple]] = [[] for _ in texts]
        for t, r in shared.value.candidates(texts):
            out[t].append((r, texts[t]))
        return out

    return find


def _by_sketches(held: DataFrame, trains: DataFrame, share: float, scans: int) -> DataFrame:
    """(train_key, r) from held (r, ids), whose sketches are scanned for in so many parts, and trains."""
    spark = held.sparkSession
    sample = held.where(F.octet_length("ids") <= 4 * LEADER_WORDS).orderBy("r").limit(LEADERS).select("ids").collect()
    groups = spark.sparkContext.broadcast(Groups([x.ids for x in sample]))

    def sketch(batches):  # noqa: ANN001, ANN202
        for b in batches:
            scan, r, ids = (c.to_pylist() for c in b.columns)
            for i in sorted(set(scan)):
                at = [j for j, x in enumerate(scan) if x == i]
                w, g, *rest = zip(*sketched(groups.value, [r[j] for j in at], [ids[j] for j in at]))
                columns = [pa.array([i] * len(w), pa.int32()), pa.array(w, pa.int32()), pa.array(g, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)]
                yield pa.RecordBatch.from_arrays(columns, ["scan", "w", "g", "r", "n", "sketch"])

    parts = held.select(F.pmod(F.xxhash64("r", F.lit(7)), F.lit(scans)).cast("int").alias("scan"), "r", "ids")
    parts = cut(parts.mapInArrow(sketch, "scan int, w int, g int, r binary, n binary, sketch binary"))
    if scans > 1 and trains.columns[1] != "ids":  # words are taken apart once, not for each scan
        trains = cut(numbered(trains, *trains.columns))
    found = []
    for i in range(scans):
        rows = [(x.w, x.g, bytes(x.r), bytes(x.n), bytes(x.sketch)) for x in parts.where(F.col("scan") == i).toLocalIterator()]
        found.append(_scan(trains, _sketch_finder(Sketches(groups.value, rows, share), spark), "r bigint, ids binary"))
    candidates = reduce(DataFrame.unionByName, found).join(held.select("r", F.col("ids").alias("held_ids")), "r")

    def compare(batches):  # noqa: ANN001, ANN202
        last, lines = None, None
        for b in batches:
            same = []
            for x, y in zip(b.column("held_ids").to_pylist(), b.column("ids").to_pylist()):
                if x != last:
                    last, lines = x, unpacked(x)
                same.append(almost_same(lines, unpacked(y), share))
            yield b.select(["train_key", "r"]).filter(pa.array(same, pa.bool_()))

    schema = T.StructType([candidates.schema["train_key"], candidates.schema["r"]])
    return candidates.select("train_key", "r", "ids", "held_ids").mapInArrow(compare, schema)


#: Bytes of found rows that a task hands over at once.
HANDED = 1 << 24


def _scan(trains: DataFrame, find: Callable[[list[bytes]], list[list[tuple]]], columns: str) -> DataFrame:
    """train_key and what ``find`` gives for each text of trains (key, text or ids), as columns."""
    key = trains.schema[0].dataType
    schema = T.StructType([T.StructField("train_key", key), *T._parse_datatype_string(columns)])
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches):  # noqa: ANN001, ANN202
        kept: dict[bytes, list[tuple]] = {}
        for b in batches:
            keys, texts, todo = b.column(0).to_pylist(), b.column(1).to_pylist(), {}
            hashes: list[bytes | None] = []
            for k, t in zip(keys, texts):
                h = None
                if k is not None and t:
                    h = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t)
                    if h not in kept and h not in todo:  # copies are looked up once
                        todo[h] = packed(lines_of_ids(t)) if isinstance(t, str) else t
                hashes.append(h)
            found = dict(zip(todo, find(list(todo.values()))))
            rows, size = [], 0
            for k, h in zip(keys, hashes):
                for x in (kept[h] if h in kept else found[h]) if h else ():
                    rows.append((k, *x))
                    size += 100 + (len(x[1]) if len(x) > 1 else 0)
                    if size > HANDED:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            if len(kept) < 200_000:
                kept |= found

    return trains.mapInArrow(run, schema)


#: Bits of the filter of held-out rows of words: 16 for each, up to this bound (64 MB). Beyond it more rows of train pass the
#: filter, and the join drops them; the result is the same.
FILTER_BITS = 1 << 29
_SEGMENT = 1 << 19


def _grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each row of n words of packed lines, across line ends, and the number of its text."""
    words = [np.frombuffer(t, np.uint32) for t in texts]
    of = np.repeat(np.arange(len(words)), list(map(len, words)))
    w = np.concatenate([*words, np.empty(0, np.uint32)])
    of, w = of[w > 0], w[w > 0].astype(np.uint64)
    if len(w) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        w = (w ^ (w >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + len(h)]
            h ^= h >> np.uint64(32)
        h = (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    whole = of[: len(h)] == of[n - 1 :]
    return h[whole], of[: len(h)][whole]


def shared_ngrams(ids: DataFrame, n: int = 8, train: str = "train", held_out: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Per split and source of the held-out records: distinct rows of n words, those that train holds too, and their
    occurrences there. ids has key, ids (as ``numbered`` gives them), split and source.

    Rows of words are hashed to 64 bits. Those of train pass a filter of the held-out ones where they are made, so only what
    may be shared is shuffled, once, together with the held-out rows. A row of words goes with the hash of its split and
    source, whose names are joined to the counts.
    """
    slices = ids.where(F.col("split").isin(*held_out)).select("ids", "split", "source", F.xxhash64("split", "source").alias("slice"))

    def held_rows(batches):  # noqa: ANN001, ANN202
        for b in batches:
            g, of = _grams(b.column(0).to_pylist(), n)
            pair = np.unique(np.stack([g, b.column(1).to_numpy()[of]]), axis=1) if len(g) else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.int64())], ["g", "slice", "times"])

    held = slices.select("ids", "slice").mapInArrow(held_rows, "g bigint, slice bigint, times bigint")
    shared = ids.sparkSession.sparkContext.broadcast(key_filter(held.select("g"), rows=slices.agg(F.sum(F.octet_length("ids") / 4)).first()[0]))

    def train_rows(batches):  # noqa: ANN001, ANN202
        for b in batches:
            g, _ = _grams(b.column(0).to_pylist(), n)
            g, times = np.unique(g[held_by(shared.value, g)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.int64()), pa.array(times, pa.int64())], ["g", "slice", "times"])

    seen = ids.where(F.col("split") == train).select("ids").mapInArrow(train_rows, "g bigint, slice bigint, times bigint")
    each = held.unionByName(seen).groupBy("g").agg(F.collect_set("slice").alias("slices"), F.sum("times").alias("times"))
    counts = each.select(F.explode("slices").alias("slice"), "times").groupBy("slice").agg(F.count("times").alias("unique_overlapping_ngrams"), F.coalesce(F.sum("times"), F.lit(0)).alias("overlapping_ngram_occurrences_train"), F.count("*").alias("ngrams"))
    return slices.groupBy("slice").agg(F.first("split").alias("split"), F.first("source").alias("source")).join(counts, "slice").drop("slice")
