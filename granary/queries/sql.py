"""Pieces of SQL that several queries share."""

from granary.functions.text import MERSENNE, PERMUTATIONS, ROWS, WS


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def collapse(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q(WS)}, ' ', 'g'), '^ +| +$', '', 'g')"


def compare_form(c: str) -> str:
    return f"lower({collapse(c)})"


def tokens(c: str) -> str:
    return f"(CASE WHEN length({collapse(c)}) > 0 THEN string_split({collapse(c)}, ' ') ELSE [] END)"


def ngrams(w: str, n: int) -> str:
    return f"(CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i+{n - 1}], ' ')) ELSE [] END)"


def shingles(t: str, size: int = 24, step: int = 8) -> str:
    return f"(CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) <= {size} THEN [{t}] ELSE list_distinct(list_transform(range(0, length({t}) - {size} + 1, {step}), lambda i: substr({t}, i::INT + 1, {size}))) END)"


def sentences(t: str) -> str:
    broken = f"regexp_split_to_array(regexp_replace({t}, '([.!?।॥])[\\t-\\r \\x{{85}}\\p{{Z}}]+', '\\1' || chr(10), 'g'), '\\n+')"
    return f"list_distinct(list_filter(list_transform({broken}, lambda s: {compare_form('s')}), lambda s: length(s) > 3))"


def signature(h: str) -> str:
    return f"list_transform(range(0, {PERMUTATIONS}), lambda k: list_min(list_transform({h}, lambda x: ((1103515245 + 7919 * k) * x + (12345 + 104729 * k)) % {MERSENNE})))"


def bands(sig: str) -> str:
    return f"list_transform(range(0, {PERMUTATIONS // ROWS}), lambda b: b::VARCHAR || ':' || md5(array_to_string({sig}[b * {ROWS} + 1:b * {ROWS} + {ROWS}], ',')))"
