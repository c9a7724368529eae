"""Splits by content component, and n-grams that leak from one split to the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import compare_form, sentences, tokens
from granary.operators.dedup import connected
from granary.operators.membership import exploded, gram_hashes, key_filter
from granary.operators.running import running_total
from granary.session import cut


def content_components(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, component): documents that share a sentence, directly or through others, under the least key.

    Each sentence's documents are tied to its first one, so a sentence that many hold costs one link a document.
    """
    s = df.select(F.col(key).alias("k"), F.explode(sentences(F.col(text))).alias("s")).select("k", F.md5(F.encode("s", "UTF-8")).alias("s"))
    first = s.groupBy("s").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1")
    roots = connected(s.join(first, "s").where("k > a").select("a", F.col("k").alias("b")).distinct())
    return df.select(F.col(key)).join(roots, F.col(key) == F.col("node"), "left").select(key, F.coalesce("root", F.col(key)).alias("component"))


def assign_split(parts: DataFrame, language: str, fraction: float, seed: int) -> DataFrame:
    """component, its language (of most of its documents, the least on a tie), documents and split.

    Components of a language come in the order of a seeded hash; they go to val until val has its part, at least one document.
    parts has key, component and the language. Ordering is over components, not documents.
    """
    votes = parts.groupBy("component", language).agg(F.count("*").alias("n"))
    each = votes.groupBy("component").agg(F.sum("n").alias("docs"), F.min_by(language, F.struct(-F.col("n"), F.col(language))).alias("lang"))
    totals = each.groupBy("lang").agg(F.sum("docs").alias("total"))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce("lang", F.lit("")), F.col("component").cast("string")), 256)
    x = each.join(totals, each.lang.eqNullSafe(totals.lang)).drop(totals.lang).withColumn("_key", F.concat(key, F.lit(":"), F.col("component").cast("string")))
    x = running_total(x, "lang", "_key", "docs", "_upto")
    before = F.col("_upto") - F.col("docs")
    return x.select("component", "lang", "docs", F.when(before < F.greatest(F.round(F.col("total") * fraction), F.lit(1)), "val").otherwise("train").alias("split"))


def gram_rows(df: DataFrame, key: str, text: str, n: int, *rest: str, lower: bool = True) -> DataFrame:
    """(key, rest, g): the 64-bit hashes of the rows of n words of each text, in order, repeats kept, as an array."""
    t = compare_form(F.col(text)) if lower else F.col(text)
    return df.select(key, *rest, t.alias("_t")).select(key, *rest, gram_hashes(tokens(F.col("_t")), n).alias("g"))


def component_edges(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(a, b): documents that share a row of n words, each tied to the first that holds it. No pair of others is made."""
    g = gram_rows(df, key, text, n).select(F.col(key).alias("k"), F.explode(F.array_distinct("g")).alias("g"))
    first = g.groupBy("g").agg(F.min("k").alias("a"), F.count("*").alias("n")).where("n > 1")
    return g.join(first, "g").where("k > a").select("a", F.col("k").alias("b")).distinct()


def leaking(df: DataFrame, key: str, text: str, split: str, n: int, held: Column) -> DataFrame:
    """Held-out documents of which a row of n words occurs in train, with how many.

    Rows of words are hashed to 64 bits. Train's are filtered by the held-out ones where they are made, then reduced to
    distinct ones before they meet them (a semi-join).
    """
    hold = cut(gram_rows(df.where(held), key, text, n).select(key, F.explode("g").alias("g")))
    only = key_filter(hold.select("g").distinct())
    train = exploded(gram_rows(df.where(F.col(split) == "train"), key, text, n).select("g"), "g", only).distinct()
    return hold.join(train, "g", "left_semi").groupBy(key).agg(F.count("*").alias("hits"), F.count_distinct("g").alias("distinct_hits"))


def leaking_pairs(df: DataFrame, key: str, text: str, split: str, n: int, held: Column) -> DataFrame:
    """(held_key, train_key, rows): a held-out document and the first train document that holds each of its shared rows of n
    words, with the number of distinct rows so tied. Every held-out document with a leak has a pair; copies of a passage in
    train aren't expanded."""
    hold = cut(gram_rows(df.where(held), key, text, n).select(F.col(key).alias("held_key"), F.explode(F.array_distinct("g")).alias("g")))
    only = key_filter(hold.select("g").distinct())
    train = exploded(gram_rows(df.where(F.col(split) == "train"), key, text, n), "g", only).groupBy("g").agg(F.min(key).alias("train_key"))
    return hold.join(train, "g").groupBy("held_key", "train_key").agg(F.count("*").alias("rows"))


def repair_leaks(df: DataFrame, key: str, text: str, split: str, unit: str, n: int = 8, rounds: int = 50) -> DataFrame:
    """(key, split, moved_in) after held-out units with leaks are moved to train until none leaks; nothing is deleted.

    unit is the column that moves as a whole (the key, or a component). Only rows of words that a held-out document holds
    matter: train's are filtered by them, reduced to distinct ones, and cut in the shared folder with the held-out ones; in
    each round those of the units moved last are looked up. A repair that isn't done after ``rounds`` raises.
    """
    columns = [key] if unit == key else [key, unit]
    state = cut(df.select(*columns, F.col(split).alias("split"), F.lit(0).alias("moved_in")))
    hold = cut(gram_rows(df.where(F.col(split) != "train"), key, text, n).select(key, F.explode(F.array_distinct("g")).alias("g")))
    only = key_filter(hold.select("g").distinct())
    new = exploded(gram_rows(df.where(F.col(split) == "train"), key, text, n).select("g"), "g", only).distinct()
    for i in range(1, rounds + 1):
        bad = hold.join(new, "g", "left_semi").select(key).distinct()
        units = state.where("split <> 'train'").join(bad, key).select(unit).distinct().withColumn("_bad", F.lit(True))
        moves = F.coalesce(F.col("_bad") & (F.col("split") != "train"), F.lit(False))
        x = state.join(units, unit, "left").withColumn("_move", moves)
        state = cut(x.select(*columns, F.when(F.col("_move"), "train").otherwise(F.col("split")).alias("split"), F.when(F.col("_move"), i).otherwise(F.col("moved_in")).alias("moved_in")))
        moved = state.where(F.col("moved_in") == i).select(key)
        if moved.isEmpty():
            return state.select(key, "split", "moved_in")
        new = hold.join(moved, key, "left_semi").select("g").distinct()
    raise RuntimeError(f"leaks are left after {rounds} rounds")
