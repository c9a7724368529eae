"""One consistent form for text that looks the same: widths, accents, spaces, invisible characters, look-alikes.

The mapping is compiled into a longest-match transducer. The unit it rewrites is the grapheme cluster: a base
with its marks. Compilation checks the table for conflicts (one target per source, targets are fixed points), so
applying it once or twice gives the same text. Case, punctuation, words, line breaks and the number of spaces are kept.

Two forms are made. ``fold`` gives the form to store: a letter that looks like one of another script is rewritten only where
the rest of its word is of that other script, so Russian and Greek words stay what they are. ``skeleton`` gives the form to
compare: look-alikes become Latin everywhere, so texts that look the same have one skeleton whatever their scripts.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts drawn like a Latin one (Cyrillic, then Greek).
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "а": "a", "с": "c", "ԁ": "d",
    "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y",
    "ѵ": "v", "ԝ": "w", "х": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Vowels that two written signs draw like one.
TWO_SIGNS = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॅ": "ॲ", "आॅ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाॅ": "ॉ",
    "ाे": "ो", "ाै": "ौ", "অা": "আ", "અા": "આ", "અો": "ઓ", "અૌ": "ઔ", "અે": "એ", "અૈ": "ઐ", "ાે": "ો", "ાૈ": "ૌ",
    "ਅਾ": "ਆ", "ਅੈ": "ਐ", "ਅੌ": "ਔ", "ੲਿ": "ਇ", "ੲੀ": "ਈ", "ੲੇ": "ਏ", "ੳੁ": "ਉ", "ੳੂ": "ਊ",
}
INVISIBLE = "­͏؜᠎​⁠⁡⁢⁣⁤﻿‎‏‪‫‬‭‮"
SPACES = "               　"
DASHES = {"‐": "-", "‑": "-"}
JOINERS = "‌‍"
VIRAMAS = "्্੍્్್്୍"
#: Marks that any script's letters can carry; with its base such a mark is one grapheme cluster.
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: Letters that a joiner shapes where it stands between two of them (Arabic, Syriac, Thaana, N'Ko, Mongolian), and signs that a
#: joiner makes one picture of.
SHAPED = re.compile("[\u0600-\u08ff\u1800-\u18af\ufb50-\ufdff\ufe70-\ufefc]")
PICTURES = re.compile("[\u00a9\u00ae\u203c\u2049\u2122\u2139\u2194-\u21aa\u231a-\u23ff\u24c2\u25aa-\u25fe\u2600-\u27bf\u2934\u2935\u2b05-\u2b55\u3030\u303d\u3297\u3299\ufe0f\U0001f000-\U0001faff\U000e0020-\U000e007f]")


def default_rules(look_alike: dict[str, str] = LOOK_ALIKE) -> dict[str, str]:
    """Source to target, each an exact sequence of characters. Canonical (de)compositions come from Unicode data."""
    rules = dict(look_alike)
    rules |= {a: unicodedata.normalize("NFC", b) for a, b in TWO_SIGNS.items()}
    rules |= {c: "" for c in INVISIBLE} | {c: " " for c in SPACES} | DASHES
    rules |= {chr(o): chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)}
    for lo, hi in ((0x00C0, 0x1100), (0x1E00, 0x2000), (0x2126, 0x212C), (0xFB00, 0xFB07), (0x1D400, 0x1D7FF)):
        for o in range(lo, hi):
            c = chr(o)
            if c in rules or unicodedata.combining(c):
                continue
            fonts = lo in (0xFB00, 0x1D400)  # ligatures and letters of mathematical fonts
            d = unicodedata.normalize("NFKC" if fonts else "NFD", c)
            if d == c:
                continue
            t = unicodedata.normalize("NFC", "".join(rules.get(x, x) for x in d))
            if t != c:
                rules[c] = t
    for o in range(0x0900, 0x0D00):  # pairs of Indic signs that Unicode composes
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(o):
            rules.setdefault(d, chr(o))
    return rules


class Transducer:
    """Longest-match rewriting of grapheme clusters by a conflict-checked table.

    A trie holds the sources. Most texts hold nothing that a source begins with and are handed back as they are. In the
    rest one scan finds the clusters that a source can touch (a base or invisible sign of the table, a base with
    combining accents, two signs drawn as one, a joiner); only those are walked through the trie, each distinct cluster
    once, its result being kept. Null stays null, an empty text stays empty.
    """

    def __init__(self, rules: dict[str, str] | None = None):
        self.rules = default_rules() if rules is None else dict(rules)
        self.trie: dict = {}
        for s, t in self.rules.items():
            if not s:
                raise ValueError("an empty source")
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            if None in node and node[None] != t:
                raise ValueError(f"two targets for {s!r}")
            node[None] = t
        self._kept: dict[str, str] = {}
        single = "".join(re.escape(s) for s in self.rules if len(s) == 1 and s <= "\uffff")
        beyond = [s for s in self.rules if len(s) == 1 and s > "\uffff"]  # a class with these is searched one by one
        astral = [f"[{min(beyond)}-{max(beyond)}]"] if beyond else []
        vowels, nuktas = ["", ""], ["", ""]  # pairs of signs, by first and second, the second being a vowel or a nukta
        for s in self.rules:
            if len(s) > 1:
                to = nuktas if unicodedata.combining(s[1]) else vowels
                to[0] += s[0]
                to[1] += s[1]
        pairs = [f"[{re.escape(a)}][{re.escape(b)}]+" for a, b in (vowels, nuktas) if a]
        self.seen = [re.compile(p) for p in [f"[{single}{JOINERS}{MARKS}]", *pairs, *astral]]
        parts = [*pairs, f"[{single}][{MARKS}{JOINERS}]*" if single else "", f"[A-Za-zÀ-ɏ]?[{MARKS}]+", f"[{JOINERS}]", *astral]
        self.touched = re.compile("|".join(p for p in parts if p))
        self.invisible = re.compile("[" + "".join(re.escape(s) for s, t in self.rules.items() if not t) + "]") if any(not t for t in self.rules.values()) else None
        for s, t in self.rules.items():
            if self._walk(t) != t:
                raise ValueError(f"the target of {s!r} is rewritten again")

    def _walk(self, s: str) -> str:
        out, i = [], 0
        while i < len(s):
            node, j, end, best = self.trie, i, i, None
            while j < len(s) and s[j] in node:
                node = node[s[j]]
                j += 1
                if None in node:
                    end, best = j, node[None]
            if best is None:
                out.append(s[i])
                i += 1
            else:
                out.append(best)
                i = end
        return unicodedata.normalize("NFC", "".join(out))

    @staticmethod
    def _shows(text: str, i: int, end: int) -> bool:
        """Whether a joiner at i can be seen: after a virama, between letters that it shapes, between signs of one picture."""
        if not i:
            return False
        before, after = text[i - 1], text[end : end + 1]
        if before in VIRAMAS:
            return True
        return bool(after) and any(p.match(before) and p.match(after) for p in (SHAPED, PICTURES) if p is SHAPED or text[i] == "\u200d")

    def _cluster(self, m: re.Match) -> str:
        s = m.group()
        if s[0] in JOINERS:
            return s if self._shows(m.string, m.start(), m.end()) else ""
        got = self._kept.get(s)
        if got is None:
            got = self._walk(s)
            if len(self._kept) < 100_000:
                self._kept[s] = got
        return got

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() or not any(p.search(text) for p in self.seen):
            return text
        if self.invisible is not None:  # first, for they part bases from their marks
            text = self.invisible.sub("", text)
        return self.touched.sub(self._cluster, text)


def _script(c: str) -> str | None:
    """The script of a letter that has look-alikes: of Latin, Greek and Cyrillic."""
    if "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u024f":
        return "latin"
    if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
        return "greek"
    return "cyrillic" if "\u0400" <= c <= "\u052f" else None


#: For each script, the letters of the others that look like one of its own.
TO_SCRIPT: dict[str, dict[str, str]] = {"latin": {a: b for a, b in LOOK_ALIKE.items() if _script(a) in ("greek", "cyrillic")}}
for _to in ("greek", "cyrillic"):
    _own = {b: a for a, b in reversed(LOOK_ALIKE.items()) if _script(a) == _to}
    TO_SCRIPT[_to] = {a: _own[b] for a, b in LOOK_ALIKE.items() if b in _own and _script(a) != _to and _script(a) is not None} | _own
_OTHERS = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_WORD = re.compile(f"[A-Za-z\u00c0-\u024f\u0370-\u052f\u1f00-\u1fff{MARKS}]+")
_PLAIN_RULES = {a: b for a, b in LOOK_ALIKE.items() if a not in TO_SCRIPT["latin"]}


def one_script(text: str) -> str:
    """Each word that mixes Latin, Greek and Cyrillic put into the script of those of its letters that have no look-alike in
    the others; where all have one, into Latin, unless the word is of one script and the text has words of that script."""
    if not _OTHERS.search(text):
        return text
    words = [unicodedata.normalize("NFD", w) for w in set(_WORD.findall(text))]
    sure = {}  # of each word, the scripts of letters that look like no other
    for w in words:
        sure[w] = {_script(c) for c in w if _script(c) in ("greek", "cyrillic") and c not in TO_SCRIPT["latin"]}
    written = set().union(*sure.values()) if sure else set()

    def rewrite(m: re.Match) -> str:
        w = unicodedata.normalize("NFD", m.group())
        scripts = {x for x in map(_script, w) if x}
        if scripts <= {"latin"}:
            return m.group()
        own = sure[w]
        if len(own) > 1 or (len(scripts) == 1 and scripts <= written):
            return m.group()
        to = TO_SCRIPT[next(iter(own))] if own else TO_SCRIPT["latin"]
        if own and any(_script(c) not in (None, *own) and c not in to for c in w):
            return m.group()  # letters of two scripts that look like no other: a word of its own
        return unicodedata.normalize("NFC", "".join(to.get(c, c) for c in w))

    return _WORD.sub(rewrite, text)


_DEFAULT: list[Transducer] = []


def _transducers() -> list[Transducer]:
    """For the form to store and for the form to compare, compiled once a process."""
    if not _DEFAULT:
        _DEFAULT.extend((Transducer(default_rules(_PLAIN_RULES)), Transducer()))
    return _DEFAULT


def fold(text: str | None) -> str | None:
    """The form to store."""
    if text is None or text.isascii():
        return text
    return one_script(_transducers()[0](text))


def skeleton(text: str | None) -> str | None:
    """The form to compare."""
    return _transducers()[1](text)
