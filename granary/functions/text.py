"""Text expressions over columns: white space, sentences, n-grams, shingles, fingerprints. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the classes \s of Java and of other engines know ASCII only.
WS = r"[\t-\r \x{85}\p{Z}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: the optimiser would write it out wherever body names it, within
    lambdas once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Runs of white space that aren't one blank; the many single blanks of a text needn't be written anew.
_RUNS = r" [\t-\r \x{85}\p{Z}]+|[[\t-\r\x{85}\p{Z}]&&[^ ]][\t-\r \x{85}\p{Z}]*"


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; case kept."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def compare_form(c: Column) -> Column:
    """collapse() in small letters."""
    return F.lower(collapse(c))


def fingerprint(c: Column) -> Column:
    """SHA-256 of the collapsed text: equal texts but for white space have one."""
    return F.sha2(collapse(c), 256)


def tokens(c: Column) -> Column:
    """Words between white space; a blank text has none."""
    t = collapse(c)
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """Every row of n words, joined by blanks, in order, repeats kept; none if there are fewer words."""

    def rows(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, many).otherwise(F.array().cast("array<string>"))

    return let(words, rows)


def shingles(text: Column, size: int = 24, step: int = 8) -> Column:
    """Distinct rows of ``size`` characters at every ``step``; a text not longer than that is one, an empty one has none."""

    part = gcd(size, step)  # the text is cut into parts once: a substring would be looked for from its beginning each time

    def cuts(t: Column) -> Column:
        n = F.length(t)
        starts = F.sequence(F.lit(0), F.greatest(F.floor((n - size) / step).cast("int"), F.lit(0)))
        many = lambda p: F.transform(starts, lambda i: F.array_join(F.slice(p, i * (step // part) + 1, size // part), ""))
        rows = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{part}}}"), F.lit(0)), many)
        return F.when(n.isNull() | (n == 0), F.array().cast("array<string>")).when(n <= size, F.array(t)).otherwise(F.array_distinct(rows))

    return let(text, cuts)


def sentences(text: Column) -> Column:
    """Distinct sentences in comparable form, of more than three characters."""
    broken = F.split(F.regexp_replace(text, r"([.!?।॥])[\t-\r \x{85}\p{Z}]+", "$1\n"), r"\n+")
    return F.array_distinct(F.filter(F.transform(broken, compare_form), lambda s: F.length(s) > 3))


def hash28(c: Column) -> Column:
    """A 28-bit number from MD5: one that other engines can compute too."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("bigint")


MERSENNE = 2147483647
PERMUTATIONS, ROWS = 64, 8
