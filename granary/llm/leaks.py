"""Problem 5: evaluation items whose passages occur in training text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrowmap import map_rows
from granary.llm.words import WORD, plain, words_of


class Leak(NamedTuple):
    item: str
    words: int  # words of the item found as they are
    span: int  # words of the item from the first to the last, the edited one included
    size: int  # words of the item
    start: int  # in the text, in words
    end: int


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; each state knows where its words end in which items."""

    def __init__(self, items: dict[str, list[str]]):
        self.items = {k: v for k, v in items.items() if v}
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[tuple[str, int], None]] = [{}]
        for k, words in self.items.items():
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                self.ends[last][k, i + 1] = None
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]].update(self.ends[s])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt), self.len.append(length), self.link.append(link), self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        new = self._state(self.len[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def runs(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(start, end, state) of the longest stretches of words that occur in some item, of at least so many words."""
        out = []
        s = n = 0
        nxt, link, length, get = self.next, self.link, self.len, self.ids.get
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                if n >= least:
                    out.append((i - n, i, s))
                s = n = 0
                continue
            if c not in nxt[s]:
                if n >= least:
                    out.append((i - n, i, s))
                while s >= 0 and c not in nxt[s]:
                    s = link[s]
                if s < 0:
                    s = n = 0
                    continue
                n = min(n, length[s])
            s = nxt[s][c]
            n += 1
        if n >= least:
            out.append((len(words) - n, len(words), s))
        return out


    def matches(self, words: list[str], least: int) -> Iterator[tuple[int, int, str, int]]:
        """(start, end, item, end in the item) of the stretches of at least so many words that each item shares with words
        and that go no further on either side, those within a longer stretch of another item included."""
        s = n = 0
        nxt, link, length, get = self.next, self.link, self.len, self.ids.get
        for i, w in enumerate(words):
            c = get(w)
            while s > 0 and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c not in nxt[s]:
                n = 0
                continue
            s, n = nxt[s][c], n + 1
            after = words[i + 1] if i + 1 < len(words) else None
            seen: set[tuple[str, int]] = set()
            t, m = s, n
            while m >= least:
                for key, at in self.ends[t]:
                    if (key, at) not in seen:
                        seen.add((key, at))
                        item = self.items[key]
                        if at == len(item) or item[at] != after:
                            yield i + 1 - m, i + 1, key, at
                t = link[t]
                m = length[t]


def _same(a: list[str], i: int, b: list[str], j: int, step: int) -> int:
    """How many words are the same from a[i] and b[j] on, forwards or backwards."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        i, j, n = i + step, j + step, n + 1
    return n


def _beyond_edit(text: list[str], i: int, item: list[str], j: int, step: int) -> tuple[int, int, int]:
    """Best continuation past one edit: (words the same, words of the text, words of the item), the edit included.

    The edit: a changed word, a word more in the text, a word less in it.
    """
    best = (0, 0, 0)
    for di, dj in ((1, 1), (1, 0), (0, 1)):
        n = _same(text, i + di * step, item, j + dj * step, step)
        if n > best[0]:
            best = (n, n + di, n + dj)
    return best


class Detector:
    """Leaks of items in a text. A leak has a row of at least ``least`` words of the item, or all of a shorter item; one
    word may be changed, repeated, added or dropped, so one less need be found as it is."""

    def __init__(self, items: dict[str, list[str]], least: int = 8):
        self.least, self.sam = least, SuffixAutomaton(items)
        self.seed = max(2, min([least, *(len(v) for v in self.sam.items.values())]) // 2)

    def leaks(self, text: list[str]) -> list[Leak]:
        """The leak of most words of each item."""
        best: dict[str, Leak] = {}
        for x in self.every_leak(text):
            if x.item not in best or (x.words, x.start - x.end) > (best[x.item].words, best[x.item].start - best[x.item].end):
                best[x.item] = x
        return list(best.values())

    def every_leak(self, text: list[str]) -> list[Leak]:
        """All leaks of all items, those of one passage with different edits included."""
        found: dict[Leak, None] = {}
        sam = self.sam
        for start, end, key, at in sam.matches(text, self.seed):
            item, n = sam.items[key], end - start
            back = _beyond_edit(text, start - 1, item, at - n - 1, -1)
            on = _beyond_edit(text, end, item, at, 1)
            need = min(self.least, len(item))
            for left, right in ((back, (0, 0, 0)), ((0, 0, 0), on)):
                same, span = n + left[0] + right[0], n + left[2] + right[2]
                if same >= need or same == need - 1 >= 4 and max(span, min(same + 1, len(item))) >= need:
                    found[Leak(key, same, max(span, same), len(item), start - left[1], end + right[1])] = None
        # Items made to one pattern share words: what needs an edit where another item is found in more words is that one;
        # a short item found whole, as it is, stays.
        return [x for x in found if x.words == x.span >= self.least or x.words == x.size == x.end - x.start or not any(y.item != x.item and y.words > x.words and 2 * (min(x.end, y.end) - max(x.start, y.start)) > x.end - x.start for y in found)]


def item_words(items: DataFrame, key: str, prompt: str, most: int = 100_000) -> dict[str, list[str]]:
    """The held-out items as words. They are a stated, fixed set: more than ``most`` are refused, not cut."""
    rows = items.where(F.col(key).isNotNull() & F.col(prompt).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(prompt).alias("p")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items")
    return {r.k: words_of(r.p) for r in rows}


def find_leaks(df: DataFrame, items: dict[str, list[str]], key: str = "doc_id", text: str = "text", least: int = 8) -> DataFrame:
    """(key, item_id, words, item_size, coverage) of each record and each item that leaked into it, once each.

    One pass over the corpus; every task builds the automaton from the items. Null keys and null or blank texts give
    nothing; an item without words matches nothing. Of copies of a record the widest leak counts.
    """

    def start():  # noqa: ANN202
        d = Detector(items, least)

        def f(k, t):  # noqa: ANN001
            if k is not None and t:
                for x in d.leaks(words_of(t)):
                    yield k, x.item, x.words, x.size

        return f

    kind = df.schema[key].dataType.simpleString()
    x = map_rows(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), f"k {kind}, item_id string, words int, item_size int", start)
    x = x.groupBy("k", "item_id").agg(F.max("words").alias("words"), F.max("item_size").alias("item_size"))
    return x.select(F.col("k").alias(key), "item_id", "words", "item_size", F.round(F.col("words") / F.col("item_size"), 4).alias("coverage"))


def without_leaks(df: DataFrame, items: dict[str, list[str]], text: str = "text", out: str = "clean", least: int = 8, length: int = 8, coverage: float = 0.5) -> DataFrame:
    """df with the text less every leaked span of ``length`` words or more, or of more than ``coverage`` of its item.

    A text without such a span is kept as it is; in the others markup and escapes are undone, for spans lie across them.
    What is left is looked through again, as words that a span stood between may make another.
    """

    def cleaned(d: Detector, t: str) -> str:
        while (less := shortened(d, t)) != t:
            t = less
        return t

    def shortened(d: Detector, t: str) -> str:
        spans = [(x.start, x.end) for x in d.every_leak(words_of(t)) if x.words >= min(length, x.size) or x.words > coverage * x.size]
        if not spans:
            return t
        p = plain(t)
        at = [m.span() for m in WORD.finditer(p)]
        keep, last = [], 0
        for a, b in sorted(spans):
            a, b = max(0, a), min(b, len(at))
            if a < b and at[b - 1][1] > last:
                keep.append(p[last : max(last, at[a][0])])
                last = at[b - 1][1]
        return "".join(keep) + p[last:]

    @F.pandas_udf("string")
    def clean(s):  # noqa: ANN001, ANN202
        d = Detector(items, least)
        return s.map(lambda t: cleaned(d, t), na_action="ignore")

    return df.withColumn(out, clean(F.col(text).cast("string")))
