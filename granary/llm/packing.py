"""Problem 8: texts, sized in tokens, put into containers of a fixed capacity with as little unused space as possible.

Items of one size are alike, so the packing is solved on the number of items of each size: at most as many numbers as
the capacity, whatever the corpus. Bins are completed around the largest item left; the result says how many bins are
filled by each pattern of sizes. Items are then ranked within their size, and a rank's place in the patterns is its bin.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import count_tokens
from granary.llm.related import ranked

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, how many), ...), how many bins


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the incumbent. Bins of equal room are filled alike."""
    rooms: dict[int, list[list]] = {}  # room: [[contents, bins], ...]
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                per = capacity // size
                full, rest = divmod(n, per)
                if full:
                    rooms.setdefault(capacity - per * size, []).append([Counter({size: per}), full])
                if rest:
                    rooms.setdefault(capacity - rest * size, []).append([Counter({size: rest}), 1])
                n = 0
                continue
            contents, bins = rooms[fit].pop()
            if not rooms[fit]:
                del rooms[fit]
            per = min(fit // size, n)
            full = min(bins, n // per)
            if bins > full:
                rooms.setdefault(fit, []).append([contents, bins - full])
            rooms.setdefault(fit - per * size, []).append([contents + Counter({size: per}), full])
            n -= per * full
    return [(tuple(sorted(c.items(), reverse=True)), b) for r in rooms.values() for c, b in r]


def dominated(waste: int, chosen: tuple[tuple[int, int], ...], left: dict[int, int]) -> bool:
    """Whether an item left over fits in place of smaller ones chosen (or of none) that are no more than it together.

    Those could go where that item goes, so no packing gains by this filling.
    """
    use, sums = dict(chosen), 1  # bit i: smaller items chosen that sum to i
    smaller = sorted(use)
    i = 0
    for size in sorted(left):
        while i < len(smaller) and smaller[i] < size:
            for _ in range(use[smaller[i]]):
                sums |= sums << smaller[i]
            i += 1
        if left[size] > use.get(size, 0):
            low = max(size - waste, 0)
            if sums >> low & ((1 << (size - low + 1)) - 1):
                return True
    return False


def fillings(room: int, left: dict[int, int], sizes: list[int], most_waste: int, want: int, nodes: int = 4000) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Up to ``want`` undominated fillings of a room as (waste, ((size, how many), ...)), least waste first.

    Larger items are tried first, so a filling comes before those that it dominates, which are left out; branches whose
    items can't bring the waste below the worst kept are pruned. The first filling tried is never dominated.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    sums = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums[i] = sums[i + 1] + sizes[i] * left[sizes[i]]
    budget = [nodes]

    def worst() -> int:
        return most_waste if len(found) < want else min(most_waste, found[-1][0] - 1)

    def go(i: int, room: int, chosen: list[tuple[int, int]]) -> bool:
        """False to end the search."""
        budget[0] -= 1
        while i < len(sizes) and sizes[i] > room:
            i += 1
        if i == len(sizes) or room == 0:
            if room <= worst() and not dominated(room, tuple(chosen), left):
                found.append((room, tuple(chosen)))
                found.sort(key=lambda f: f[0])
                del found[want:]
            return budget[0] > 0 and not (len(found) == want and found[-1][0] == 0)
        if room - sums[i] > worst():
            return True
        s = sizes[i]
        for k in range(min(left[s], room // s), -1, -1):
            if not go(i + 1, room - k * s, [*chosen, (s, k)] if k else chosen):
                return False
            if budget[0] <= 0:
                return False
        return True

    go(0, room, [])
    return found


def bin_completion(left: dict[int, int], capacity: int, tail: int = 40, nodes: int = 3000) -> list[Pattern]:
    """Patterns that hold all items of ``left`` (size: how many), none split; sizes from 1 to the capacity.

    Around the largest item the best filling is taken, for as many bins as the items allow. The last ``tail`` items are
    packed by branch and bound over the undominated fillings, within ``nodes`` steps and the total waste that a better
    packing than the incumbent may have. The incumbent, by best fit, stands if nothing better is found.
    """
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("an item of no size, or beyond the capacity")
    left = {s: n for s, n in left.items() if n}
    if not left:
        return []
    incumbent = best_fit(left, capacity)
    bound = -(-sum(s * n for s, n in left.items()) // capacity)
    if sum(b for _, b in incumbent) == bound:
        return incumbent
    now, out = dict(left), []
    while now and sum(now.values()) > tail:
        s = max(now)
        now[s] -= 1
        rest = {k: n for k, n in now.items() if n}
        got = fillings(capacity - s, rest, sorted((k for k in rest if k <= capacity - s), reverse=True), capacity, 1)
        use = Counter(dict(got[0][1]) if got else {})
        use[s] += 1
        now[s] += 1
        times = max(1, min(now[k] // n for k, n in use.items()))
        for k, n in use.items():
            now[k] -= n * times
            if not now[k]:
                del now[k]
        out.append((tuple(sorted(use.items(), reverse=True)), times))
    out += _exact(now, capacity, nodes)
    return out if sum(b for _, b in out) < sum(b for _, b in incumbent) else incumbent


def _exact(left: dict[int, int], capacity: int, nodes: int) -> list[Pattern]:
    best = best_fit(left, capacity) if left else []
    bound = -(-sum(s * n for s, n in left.items()) // capacity)
    budget = [nodes]

    def go(now: dict[int, int], used: list[Pattern]) -> None:
        nonlocal best
        budget[0] -= 1
        n = len(used)
        if not now:
            if n < sum(b for _, b in best):
                best = list(used)
            return
        total = sum(s * k for s, k in now.items())
        spare = (sum(b for _, b in best) - 1 - n) * capacity - total  # waste that a better packing may still have
        if spare < 0 or budget[0] <= 0:
            return
        s = max(now)
        rest = {k: c - (k == s) for k, c in now.items() if c - (k == s)}
        for _, f in fillings(capacity - s, rest, sorted((k for k in rest if k <= capacity - s), reverse=True), spare, 6, 300):
            use = Counter(dict(f))
            use[s] += 1
            after = {k: c - use[k] for k, c in now.items() if c > use[k]}
            go(after, [*used, (tuple(sorted(use.items(), reverse=True)), 1)])
            if sum(b for _, b in best) == bound or budget[0] <= 0:
                return

    go(left, [])
    return best


def sized(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """key, n_tokens and _u (a number of the row, for keys need not be unique)."""
    return count_tokens(df.select(F.col(key).alias("key"), F.col(text).alias("text")), tokenizer=tokenizer).withColumn("_u", F.monotonically_increasing_id())


def packed(df: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(container, bin, key, piece, tokens): where each document of df goes, for each container of plan.

    A document larger than the capacity is cut into full pieces, each a bin of its own, and a rest; no other is split. Null
    and empty texts take no space: one row with 0 tokens and a null bin. Rows with equal or null keys are separate items.
    """
    from granary.session import cut

    spark = df.sparkSession
    plans = plan.where("container IS NOT NULL AND capacity_tokens > 0").select("container", "capacity_tokens", "tokenizer").distinct().orderBy("container").collect()
    sizes = {t: cut(sized(df, key, text, t)) for t in sorted({p.tokenizer for p in plans})}
    parts = []
    for i, p in enumerate(plans):
        c = p.capacity_tokens
        x = sizes[p.tokenizer].select("key", "_u", F.col("n_tokens").alias("n"), F.lit(p.container).alias("container"), F.lit(i).alias("_c"), F.lit(c).alias("cap"))
        parts.append(x)
    if not parts:
        raise ValueError("the plan names no container")
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    fulls = F.when(F.col("n") > F.col("cap"), F.floor(F.col("n") / F.col("cap"))).otherwise(F.lit(0)).cast("int")
    every = every.withColumn("_full", fulls).withColumn("_rest", (F.col("n") - F.col("_full") * F.col("cap")).cast("int"))
    none = every.where("n = 0").select("container", F.lit(None).cast("string").alias("bin"), "key", F.lit(0).alias("piece"), F.lit(0).alias("tokens"))
    whole = every.where("_full > 0").select("container", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("piece"), "key", "cap", "_u")
    whole = whole.select("container", F.concat_ws(":", F.lit("f"), F.col("_u").cast("string"), F.col("piece").cast("string")).alias("bin"), "key", "piece", F.col("cap").alias("tokens"))
    items = every.where("_rest > 0").select("container", "_c", "key", "_u", F.col("_full").alias("piece"), F.col("_rest").alias("tokens"), (F.col("_c").cast("bigint") * F.lit(1 << 32) + F.col("_rest")).alias("_by"))
    counts: dict[int, dict[int, int]] = {}
    for r in items.groupBy("_c", "tokens").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["_c"], {})[r.tokens] = r.n
    slots = []
    for i, p in enumerate(plans):
        at: Counter = Counter()
        first = 0
        for pattern, bins in bin_completion(counts.get(i, {}), p.capacity_tokens):
            for size, k in pattern:
                for _ in range(k):
                    slots.append(((i << 32) + size, at[size], at[size] + bins, first))
                    at[size] += bins
            first += bins
    places = spark.createDataFrame(slots, "_by bigint, lo bigint, hi bigint, first bigint")
    order = items.withColumn("_o", F.xxhash64("key", "piece", "_u"))
    placed = ranked(order, "_by", "_o").join(places, "_by").where("rank >= lo AND rank < hi")
    placed = placed.select("container", F.concat(F.lit("b:"), (F.col("first") + F.col("rank") - F.col("lo")).cast("string")).alias("bin"), "key", "piece", "tokens")
    return placed.unionByName(whole).unionByName(none).withColumnRenamed("key", key)
