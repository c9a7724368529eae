"""Words of a text for comparison: markup and escapes undone, one form of characters, no case, no punctuation."""

from __future__ import annotations

import html
import re
import unicodedata

from granary.llm.fold import fold



def _between() -> str:
    """A class of the characters that part words: all but letters, digits, marks and joiners."""
    parts, lo = [], None
    for o in range(0x10001):
        c = chr(o)
        part = o < 0x10000 and unicodedata.category(c)[0] in "PSZC" and c not in "\u200c\u200d"
        if part and lo is None:
            lo = o
        elif not part and lo is not None:
            parts.append(f"{re.escape(chr(lo))}-{re.escape(chr(o - 1))}")
            lo = None
    return "".join(parts)


WORD = re.compile(f"[^{_between()}]+")
ESCAPE = re.compile(r"\\+(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrtbf\"'/\\])")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
DIGITS = {b + i: str(i) for b in (0x966, 0x9E6, 0xA66, 0xAE6, 0xC66) for i in range(10)}


def _escape(m: re.Match) -> str:
    x = m.group(1)
    if x[0] in "ux" and len(x) > 1:
        return chr(int(x[1:], 16))
    return {"n": "\n", "r": "\n", "t": " ", "b": " ", "f": " "}.get(x, x)


def plain(text: str) -> str:
    """text with escapes and entities undone and tags taken out, in the consistent form."""
    if "\\" in text:
        text = ESCAPE.sub(_escape, text)
        if any("\ud800" <= c <= "\udfff" for c in text):  # escaped halves of one character
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    return fold(text)


LINES = re.compile(r"[\r\n]+")
_KEPT: dict[str, list[str]] = {}


def split_words(text: str) -> list[str]:
    """Words of text already plain; what stands between white space is worked on once and kept."""
    out: list[str] = []
    for x in text.split():
        got = _KEPT.get(x)
        if got is None:
            got = WORD.findall(x.translate(DIGITS).lower())
            if len(_KEPT) < 300_000 and len(x) < 60:
                _KEPT[x] = got
        out += got
    return out


def words_of(text: str | None) -> list[str]:
    """The words in order; null or blank gives none."""
    return split_words(plain(text)) if text else []


def lines_of_words(text: str | None) -> list[list[str]]:
    """The words of each line that has any."""
    return [x for x in map(split_words, LINES.split(plain(text))) if x] if text else []
