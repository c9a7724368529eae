"""Checks of texts, drafts and records: degenerate texts, critics, rules, arithmetic of nested expressions, gates."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import let, ngrams
from granary.operators.langid import EXPECTED, script_profile

# What stands for text not yet written; limits of the test of degenerate texts.
PLACEHOLDERS = ("todo", "tbd", "lorem ipsum", "{{", "}}", "<insert", "xxx", "placeholder")
DEGENERATE = {"ngram": 8, "run": 32, "distinct": 0.35, "cycle": 0.5, "dominance": 0.6, "period": 16}


def most_alike(values: Column) -> Column:
    """How often the most frequent of an array's values occurs: the longest run of equal ones once they are sorted."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v.eqNullSafe(s["last"]), s["run"] + 1).otherwise(F.lit(1))
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["best"])


def _ends_in_cycle(ids: Column, n: Column, period: Column, times: Column) -> Column:
    """Whether the last times * period tokens are ``times`` equal rows: the row shifted by a period is itself."""
    size = (times - 1) * period
    return (n >= times * period) & (F.slice(ids, F.greatest(n - times * period + 1, F.lit(1)), size) == F.slice(ids, F.greatest(n - size + 1, F.lit(1)), size))


def degeneracy(text: Column, ids: Column) -> Column:
    """Why a text with tokens ids is degenerate, all reasons in order, none for a sound one.

    empty; run (one token 32 times at the end); repeats (a row of 8 tokens three times at the end); cycle (a row of at most
    16 tokens, at least three times, covers over half); looping (under 35 % of its rows of 4 tokens are distinct);
    dominance (one character is over 60 % of all but blanks). A null text is empty.
    """
    p = DEGENERATE

    def tests(w: Column, n: Column) -> Column:
        run = (n >= p["run"]) & _ends_in_cycle(w, n, F.lit(1), F.lit(p["run"]))
        back = (n >= 3 * p["ngram"]) & _ends_in_cycle(w, n, F.lit(p["ngram"]), F.lit(3))
        need = lambda k: F.greatest(F.lit(3), F.floor(n * p["cycle"] / k).cast("int") + 1)
        cycle = (n >= 6) & F.exists(F.sequence(F.lit(1), F.lit(p["period"])), lambda k: _ends_in_cycle(w, n, k, need(k)))
        loop = let(ngrams(w, 4), lambda g: (n >= 6) & (F.size(g) >= 6) & (F.size(F.array_distinct(g)) / F.size(g) < p["distinct"]))
        body = F.regexp_replace(text, "[ \n]", "")
        one = let(body, lambda b: F.when(F.length(b) >= 12, most_alike(F.split(b, "")) / F.length(b) > p["dominance"]).otherwise(F.lit(False)))
        named = ((run, "run"), (back, "repeats"), (cycle, "cycle"), (loop, "looping"), (one, "dominance"))
        found = F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in named]), lambda x: x.isNotNull())
        return F.when(text.isNull() | ~text.rlike(r"[^\t-\r \x{85}\p{Z}]"), F.array(F.lit("empty"))).otherwise(found)

    return let(F.coalesce(ids, F.array().cast("array<string>")), lambda w: let(F.size(w), lambda n: tests(w, n)))


def critics(task: Column, response: Column, answer: Column, language: Column, prompt: Column, least: int = 12) -> Column:
    """Findings on a draft: an array of (critic, verdict, code), verdict being ok, warn or reject.

    Fields missing; too little text; placeholders; an answer that stands in the prompt; a script that the language isn't
    written in; a sentence three times or more. Null fields count as empty.
    """
    t, r, a = (F.coalesce(c, F.lit("")) for c in (task, response, answer))
    blank = lambda c: ~c.rlike(r"[^\t-\r \x{85}\p{Z}]")
    finding = lambda critic, verdict, code: F.struct(F.lit(critic).alias("critic"), F.lit(verdict).alias("verdict"), F.lit(code).cast("string").alias("code"))
    form = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"[\t-\r \x{85}\p{Z}]+", " ")), "^ | $", "")
    body = F.regexp_replace(F.concat_ws(" ", t, r, a), r"^[\t-\r ]+|[\t-\r ]+$", "")
    low = F.lower(body)
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), language)
    share = let(script_profile(F.when(r != "", r).otherwise(t)), lambda s: F.when(expected == "devanagari", s["devanagari"]).when(expected == "latin", s["latin"]))
    said = F.filter(F.transform(F.split(r, r"[।.!?\n]+"), lambda s: F.regexp_replace(s, r"^[\t-\r ]+|[\t-\r ]+$", "")), lambda s: F.length(s) > 8)
    each = [
        F.when(blank(t) | blank(r) | blank(a), finding("field_completeness", "reject", "MISSING_FIELD")).otherwise(finding("field_completeness", "ok", None)),
        F.when(F.length(body) < least, finding("substance", "reject", "TOO_SHORT")),
        F.when(F.greatest(*[low.contains(x) for x in PLACEHOLDERS]), finding("placeholder_scan", "reject", "PLACEHOLDER_TEXT")),
        F.when((F.length(form(a)) > 0) & form(F.coalesce(prompt, F.lit(""))).contains(form(a)), finding("prompt_echo", "warn", "ANSWER_ECHOES_PROMPT")),
        F.when(share < 0.5, finding("language_script", "warn", "LANGUAGE_SCRIPT_MISMATCH")),
        F.when(let(said, lambda x: (F.size(x) > 2) & (most_alike(x) >= 3)), finding("degeneracy", "warn", "DEGENERATE_REPETITION")),
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def worst(findings: Column) -> Column:
    """The worst verdict of an array of findings; ok where there is none."""
    has = lambda v: F.exists(findings, lambda f: f["verdict"] == v)
    return F.when(has("reject"), "reject").when(has("warn"), "warn").otherwise("ok")


def violations(df: DataFrame, key: str, rules: dict[str, Column], severity: dict[str, str] | None = None) -> DataFrame:
    """(key, code, severity) of every rule that a row breaks; a rule that is null for a row isn't broken. One pass, any number
    of rules; severity is error where none is given."""
    codes = F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit((severity or {}).get(code, "error")).alias("severity"))) for code, broken in rules.items()])
    return df.select(F.col(key), F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("v")).select(key, "v.code", "v.severity")


_PARTS = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|(\*\*|[-+*/()]))")


def exact_value(expression: str) -> Fraction | None:
    """The exact value of an expression of numbers, + - * / ** and brackets; None where it has none (division by zero, a power
    that is no whole number or over 64, anything else than these signs, more than 200 signs)."""
    tokens, at, text = [], 0, expression.replace("×", "*").replace("÷", "/").replace("−", "-").replace(",", "").strip()
    while at < len(text):
        m = _PARTS.match(text, at)
        if not m:
            return None
        tokens.append(Fraction(m.group(1)) if m.group(1) else m.group(2))
        at = m.end()
    if not tokens or len(tokens) > 200:
        return None
    values, waiting, expect = [], [], True  # two stacks: values, and operators not yet applied
    rank = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "**": 4}

    def apply() -> None:
        op, b = waiting.pop(), values.pop()
        if op == "neg":
            values.append(-b)
            return
        a = values.pop()
        if op == "**":
            if b.denominator != 1 or abs(b) > 64:
                raise ValueError("power")
            values.append(a ** int(b))
        else:
            values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)

    try:
        for t in tokens:
            if isinstance(t, Fraction) or t == "(":
                if not expect:
                    return None
                if t == "(":
                    waiting.append(t)
                else:
                    values.append(t)
                    expect = False
            elif expect:
                if t == "-":
                    waiting.append("neg")
                elif t != "+":
                    return None
            elif t == ")":
                while waiting and waiting[-1] != "(":
                    apply()
                if not waiting:
                    return None
                waiting.pop()
            else:
                while waiting and waiting[-1] != "(" and (rank[waiting[-1]] > rank[t] or (rank[waiting[-1]] == rank[t] and t != "**")):
                    apply()
                waiting.append(t)
                expect = True
        if expect:
            return None
        while waiting:
            if waiting[-1] == "(":
                return None
            apply()
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return values[0]


@F.pandas_udf(T.StructType([T.StructField("numerator", T.StringType()), T.StructField("denominator", T.StringType()), T.StructField("value", T.DoubleType())]))
def evaluated(s: pd.Series) -> pd.DataFrame:
    """The exact value of each expression, as a fraction in lowest terms and as a double; nulls where it has none. Brackets nest
    to any depth, which no expression of columns can follow."""

    def one(x: str | None) -> tuple:
        v = exact_value(x) if x else None
        if v is None:
            return None, None, None
        try:
            return str(v.numerator), str(v.denominator), float(v)
        except OverflowError:
            return str(v.numerator), str(v.denominator), None

    return pd.DataFrame([one(x) for x in s], columns=["numerator", "denominator", "value"])


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression over whole paths: * and ? match any characters, "/" too; a pattern that ends in /** or
    / stands for all below that folder."""
    folder = glob[: -len("**")] if glob.endswith("/**") else glob if glob.endswith("/") else None
    if folder is not None:
        return "^" + re.escape(folder)
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def path_matches(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path is meant: no exclude pattern matches it, and some include pattern does (any path where there is none). A null path isn't."""
    some = lambda globs: F.greatest(*[path.rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return (some(include) if include else F.lit(True)) & ~some(exclude)


def language_by_path(path: Column, patterns: list[tuple[str, str]], declared: Column) -> Column:
    """The language of the first pattern that matches a path; else the declared one, else unknown."""
    out = F
    for glob, language in patterns:
        out = out.when(path.rlike(glob_pattern(glob)), language)
    rest = F.coalesce(declared, F.lit("unknown"))
    return out.otherwise(rest) if patterns else rest
