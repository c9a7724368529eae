"""Operators on records, assessments and answers: sampling, review schedules, arithmetic claims, comparison of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days between reviews, by stage.
STAGES = (1, 3, 7, 16, 35, 75, 160)
NUMBER = r"-?\d+(?:\.\d+)?"
CLAIM = rf"({NUMBER})\s*([+\-*/×÷])\s*({NUMBER})\s*=\s*({NUMBER})"
PERCENT = rf"({NUMBER})\s*%\s*of\s*({NUMBER})\s*(?:=|is)\s*({NUMBER})"


def bucket(key: Column, seed: int, of: int = 10_000) -> Column:
    """A number below ``of`` from SHA-256 of seed and key: the same everywhere and always."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("bigint") % of


def largest_remainder(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """df with share: ``total`` dealt by weight, whole parts first, then the largest remainders (the least key on a tie).

    df has a row for each stratum, not for each record: its rows are ranked together, in one task.
    """
    whole = Window.partitionBy()
    exact = F.col(weight) * total / F.sum(weight).over(whole)
    x = df.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col(key)))
    return x.withColumn("share", (F.col("_floor") + F.when(rank <= F.lit(total) - F.sum("_floor").over(whole), 1).otherwise(0)).cast("bigint")).drop("_floor", "_rest")


def pick(df: DataFrame, by: list[str], key: str, count: Column | int, seed: int) -> DataFrame:
    """Of each group, the ``count`` rows that come first in the order of a seeded hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    n = count if isinstance(count, Column) else F.lit(count)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def quotas_of(shares: dict[str, float], total: int) -> dict[str, int]:
    """``total`` places dealt by share: whole parts first, then the largest remainders (the least name on a tie)."""
    whole = sum(shares.values())
    exact = {k: total * v / whole for k, v in shares.items()}
    out = {k: int(v + 1e-9) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (round(out[k] - exact[k], 9), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def bucketed_sample(df: DataFrame, bucket: str, key: str, shares: dict[str, float], total: int, seed: int, preference: tuple[str, ...]) -> DataFrame:
    """(key, bucket, how) of ``total`` rows: of each bucket its quota in the order of a seeded hash, then, for what some bucket
    lacks, further rows of the others in order of preference (how: quota or redistributed). Fewer rows come out only where df
    has fewer. Rows of other buckets are left out.

    No more than a quota and ``total`` rows of a bucket can be chosen, so each task passes on that many of its own first ones
    and a bucket may hold most of all rows. Only the number of rows chosen of each bucket reaches the driver.
    """
    quotas = quotas_of(shares, total)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    x = df.where(F.col(bucket).isin(*quotas)).select(key, bucket, order.alias("_o"))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(bucket).orderBy("_o", key))).where(F.col("_n") <= max(quotas.values(), default=0) + total)
    lookup = lambda values: F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col(bucket))
    x = x.withColumn("_q", lookup(quotas)).withColumn("_p", lookup({k: preference.index(k) if k in preference else len(preference) for k in quotas}))
    chosen = x.where("_n <= _q")
    missing = total - sum(r["count"] for r in chosen.groupBy(bucket).count().collect())
    more = x.where("_n > _q").orderBy("_p", "_o", key).limit(missing)
    return chosen.select(key, bucket, F.lit("quota").alias("how")).unionByName(more.select(key, bucket, F.lit("redistributed").alias("how")))


def review_state(events: DataFrame, key: str, day: str, performance: str) -> DataFrame:
    """(key, stage, due_day, reviews): each key's reviews folded in order of day. From 0.8 on a stage up, under 0.5 two down.

    Several reviews on a day count as one, with their mean, so a key has at most as many as there are days. The fold runs in
    the JVM over a key's own reviews, sorted; keys are independent.
    """
    top = len(STAGES) - 1
    days = F.array(*[F.lit(d) for d in STAGES])
    daily = events.groupBy(key, F.col(day).cast("int").alias("d")).agg(F.avg(F.col(performance).cast("double")).alias("p"))
    each = daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("r"))
    start = F.struct(F.lit(0).alias("stage"), F.lit(None).cast("int").alias("due"), F.lit(0).alias("n"))

    def step(s: Column, e: Column) -> Column:
        up = F.when(e["p"] >= 0.8, F.least(s["stage"] + 1, F.lit(top))).when(e["p"] < 0.5, F.greatest(s["stage"] - 2, F.lit(0))).otherwise(s["stage"])
        return F.struct(up.alias("stage"), (e["d"] + F.element_at(days, up + 1)).alias("due"), (s["n"] + 1).alias("n"))

    return each.select(key, F.aggregate("r", start, step).alias("s")).select(key, F.col("s.stage").alias("stage"), F.col("s.due").alias("due_day"), F.col("s.n").alias("reviews"))


def forgetting_risk(day: Column, last: Column, interval: Column) -> Column:
    """Half the part of the interval that has passed, half what is overdue, at most 1."""
    since = day - last
    return F.least(F.lit(1.0), 0.5 * since / interval + 0.5 * F.greatest(F.lit(0.0), (since - interval) / interval))


def arithmetic_claims(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, claim, holds) of each "a op b = c" and "p% of n = m" in the text. Exact: both sides are compared as decimals,
    quotients by cross-multiplication. A division by zero has null."""

    def exploded(pattern: str, n: int) -> DataFrame:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(n + 1)]
        return df.select(F.col(key), F.explode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])).alias("m")).select(key, *[F.col(f"m.g{i}").alias(f"g{i}") for i in range(n + 1)])

    num = lambda c: F.col(c).try_cast("decimal(18,6)")
    a, b, c = num("g1"), num("g3"), num("g4")
    op = F.col("g2")
    holds = F.when(op == "+", a + b == c).when(op == "-", a - b == c).when(op.isin("*", "×"), a * b == c).when(op.isin("/", "÷") & (b != 0), a == c * b)
    plain = exploded(CLAIM, 4).select(key, F.col("g0").alias("claim"), holds.alias("holds"))
    p, n, m = num("g1"), num("g2"), num("g3")
    return plain.unionByName(exploded(PERCENT, 3).select(key, F.col("g0").alias("claim"), (p * n == m * 100).alias("holds")))


def answer_form(c: Column) -> Column:
    """An answer for comparison: small letters, white space collapsed, no closing punctuation."""
    t = F.regexp_replace(F.lower(c), r"[\t-\r \x{85}\x{200b}\p{Z}]+", " ")
    t = F.regexp_replace(t, "^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(t, "[।.,;:!?\"'`]+$", ""), "^ +| +$", "")


def answer_matches(answer: Column, expected: Column, mode: Column, tolerance: Column) -> Column:
    """Whether an answer is right: the same words, the same first number within a tolerance, or the same set of parts.

    Null where the mode can't be decided by a machine or nothing is expected.
    """
    first = lambda c: F.regexp_extract(c, NUMBER, 0).try_cast("double")
    parts = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, r"[,;/\n]|\band\b"), answer_form), lambda x: F.length(x) > 0)))
    return (
        F.when(expected.isNull(), F.lit(None).cast("boolean"))
        .when(mode == "exact", answer_form(answer) == answer_form(expected))
        .when(mode == "numeric", F.abs(first(answer) - first(expected)) <= F.coalesce(tolerance, F.lit(0.0)) + 1e-9)
        .when(mode == "set", parts(answer) == parts(expected))
    )


# The ladder of difficulties, from the lowest.
DIFFICULTIES = ("beginner", "elementary", "intermediate", "advanced", "expert", "olympiad")


def rank_of(difficulty: Column) -> Column:
    """The place of a difficulty on the ladder, from 0; -1 for others and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, DIFFICULTIES)), difficulty).cast("int") - 1, F.lit(-1))


def node_coverage(df: DataFrame, node: str, kind: str, correct: str, total: str, difficulty: str, verified: str, practice: int = 3, mastery: int = 8, accuracy: float = 0.8, floor: str = "intermediate") -> DataFrame:
    """What the assessments of each node show: attempts, total, correct, accuracy (null where nothing was asked), the highest
    difficulty reached, verified attempts, what stands against mastery (codes, in order) and the state.

    learning: too few attempts to judge, which is then the only blocker; mastered: nothing against it; assessed: attempts and
    accuracy suffice, something else doesn't; practice: the rest. Attempts are summed up in each task before they are shuffled.
    """
    has = lambda k: F.coalesce(F.bool_or(F.col(kind) == k), F.lit(False))
    x = df.groupBy(node).agg(
        F.count("*").alias("attempts"), F.sum(F.coalesce(total, F.lit(0))).alias("total"), F.sum(F.coalesce(correct, F.lit(0))).alias("correct"), F.max(rank_of(F.col(difficulty))).alias("_d"),
        F.count_if(F.coalesce(verified, F.lit(False))).alias("verified"), has("transfer").alias("_t"), has("verification").alias("_v"),
    ).withColumn("accuracy", F.try_divide("correct", "total"))
    acc = F.coalesce("accuracy", F.lit(0.0))
    against = [
        (F.col("attempts") < mastery, "few_attempts"), (acc < accuracy, "low_accuracy"), (F.col("_d") < DIFFICULTIES.index(floor), "low_difficulty"),
        (~F.col("_t"), "no_transfer"), (~F.col("_v"), "no_verification"), (F.col("verified") == 0, "nothing_verified"),
    ]
    blockers = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in against]), lambda b: b.isNotNull())
    x = x.withColumn("blockers", F.when(F.col("attempts") < practice, F.array(F.lit("too_little_evidence"))).otherwise(blockers))
    state = F.when(F.col("attempts") < practice, "learning").when(F.size("blockers") == 0, "mastered").when((F.col("attempts") >= mastery) & (acc >= accuracy), "assessed").otherwise("practice")
    reached = F.coalesce(F.get(F.array(*map(F.lit, DIFFICULTIES)), F.col("_d")), F.lit("none"))
    return x.select(node, "attempts", "total", "correct", "accuracy", F.when(F.col("_d") < 0, "none").otherwise(reached).alias("difficulty"), "verified", "blockers", state.alias("state"))
