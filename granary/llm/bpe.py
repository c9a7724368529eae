"""Encoding with a public byte-level BPE; the merges of a piece run on a segment tree.

The vocabulary is a file of ranks (``base64 rank`` a line); its path is a parameter and defaults to the one that the
installed package of public tokenizers gives. Special tokens do not exist here: text that looks like one is plain text.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = 1 << 60
#: Fixed value: the pattern of pieces of this family of tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it. A single space goes with what follows it, so pieces never reach over these parts.
PARTS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


def vocabulary(name_or_path: str) -> str:
    """The path of a rank file: a path, or the name of a tokenizer of the installed package."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(f"{name_or_path}.tiktoken")


class SegmentTree:
    """Leftmost minimum over positions, with point updates in logarithmic time."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.at = [INF] * self.size + ranks + [INF] * (self.size - len(ranks))
        for i in range(self.size - 1, 0, -1):
            a, b = self.at[2 * i], self.at[2 * i + 1]
            self.at[i] = a if a <= b else b

    def least(self) -> tuple[int, int]:
        """(rank, leftmost position with it)."""
        at, i = self.at, 1
        while i < self.size:
            i *= 2
            if at[i] > at[i + 1]:
                i += 1
        return at[1], i - self.size

    def put(self, i: int, rank: int) -> None:
        at, i = self.at, i + self.size
        at[i] = rank
        i //= 2
        while i:
            a, b = at[2 * i], at[2 * i + 1]
            a = a if a <= b else b
            if at[i] == a:
                break
            at[i] = a
            i //= 2


class Encoder:
    """Byte-level BPE by ranks. Work per piece of n bytes is n log n, whatever the piece; results of parts are kept."""

    KEEP = 400_000

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks: dict[bytes, int] = {}
        self.pieces_of: dict[int, bytes] | None = None
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.rpartition(b" ")
                if token:
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.pieces = regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: as long as a pair of neighbours has a rank, the leftmost pair of least rank is joined."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; its neighbour starts there
        before = list(range(-1, n - 1))
        get = ranks.get
        tree = SegmentTree([get(piece[i : i + 2], INF) for i in range(n - 1)])
        while True:
            rank, i = tree.least()
            if rank == INF:
                break
            j = end[i]
            end[i] = k = end[j]
            tree.put(j, INF) if j < n - 1 else None
            if k < n:
                before[k] = i
                tree.put(i, get(piece[i : end[k]], INF))
            else:
                tree.put(i, INF)
            if (h := before[i]) >= 0:
                tree.put(h, get(piece[h:k], INF))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def part(self, s: str) -> list[int]:
        got = [x for p in self.pieces.findall(s) for x in self.merge(p.encode("utf-8", "replace"))]
        if len(s) <= 64 and len(self.kept) < self.KEEP:
            self.kept[s] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            kept = self.kept
            for s in PARTS.findall(text):
                got = kept.get(s)
                out += self.part(s) if got is None else got
        return out

    def count(self, text: str | None) -> int:
        n = 0
        if text:
            kept = self.kept
            for s in PARTS.findall(text):
                got = kept.get(s)
                n += len(self.part(s) if got is None else got)
        return n


    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; bytes that are no UTF-8 (an id alone may be part of a character) become U+FFFD."""
        if self.pieces_of is None:
            self.pieces_of = {i: b for b, i in self.ranks.items()}
        return b"".join(map(self.pieces_of.__getitem__, ids or ())).decode("utf-8", "replace")


_KEPT: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One encoder a process and vocabulary."""
    if tokenizer not in _KEPT:
        _KEPT[tokenizer] = Encoder(vocabulary(tokenizer))
    return _KEPT[tokenizer]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """key and ids of each row. Null and empty texts give an empty list; rows are neither dropped nor merged.

    One pass without a shuffle; only key and text are read. Lone halves of surrogate pairs count as "?".
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()), False)])

    def run(batches):  # noqa: ANN001, ANN202
        enc = encoder(tokenizer)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                c = b.slice(start, 1000)
                rows = [enc.encode(t) for t in c.column(1).to_pylist()]
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=ends[1:])
                flat = np.fromiter((x for r in rows for x in r), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """df with ids replaced by their text; null and empty ids give an empty text, an unknown id is an error. A column named like
    out is replaced."""
    rest = [c for c in df.columns if c not in (ids, out)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType(), False)])

    def run(batches):  # noqa: ANN001, ANN202
        enc = encoder(tokenizer)
        for b in batches:
            texts = pa.array([enc.decode(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], schema.names)

    return df.select(*rest, F.col(ids)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """df without text, with the number of tokens of text; null and empty texts have 0. A column named like out is replaced."""
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType(), False)])

    def run(batches):  # noqa: ANN001, ANN202
        enc = encoder(tokenizer)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], schema.names)

    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
