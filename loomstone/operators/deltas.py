"""Keeping counts up to date by signed rows: after some files changed, their old rows count -1 and their new ones +1, and nothing is counted anew.

A kept table has ``keys`` and sums under the names ``sums``; what falls to ``support`` = 0 is gone. Tables that are derived from it, such
as totals by name, take the same changes summed by fewer keys, so a chain of tables costs what changed and the keys that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import occurrence_counts


def signed(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, sums): what new rows hold more, or less, than old ones; keys whose sums stay the same are left out."""
    minus = old.select(*keys, *[(-F.col(c)).alias(c) for c in sums])
    change = minus.unionByName(new.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    differs = F.lit(False)
    for c in sums:
        differs = differs | (F.col(c) != 0)
    return change.where(differs)


def coarser(change: DataFrame, keys: list[str], sums: list[str], more: dict | None = None) -> DataFrame:
    """Changes summed by fewer keys; ``more`` adds sums by expressions, such as a number of files."""
    added = [F.sum(e).alias(c) for c, e in (more or {}).items()]
    return change.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *added)


def touched(kept: DataFrame, change: DataFrame, keys: list[str], sums: list[str], support: str) -> DataFrame:
    """The changed keys' new rows: kept ones plus the changes, without those whose support is 0."""
    moved = [F.col(c).alias(f"_{c}") for c in sums]
    both = change.select(*keys, *moved).join(kept, keys, "left")
    now = both.select(*keys, *[(F.coalesce(c, F.lit(0)) + F.col(f"_{c}")).alias(c) for c in sums])
    return now.where(F.col(support) != 0)


def applied(kept: DataFrame, change: DataFrame, keys: list[str], sums: list[str], support: str) -> DataFrame:
    """The whole table after the changes: rows of other keys as they are."""
    return kept.join(change.select(*keys), keys, "left_anti").select(*keys, *sums).unionByName(touched(kept, change, keys, sums, support))


def occurrence_change(old_idents: DataFrame, new_idents: DataFrame) -> DataFrame:
    """(path, name, n) of identifiers (path, name, ln) of the changed files alone, before and after."""
    count = lambda i: occurrence_counts(i).select("path", "name", "n")
    return signed(count(old_idents), count(new_idents), ["path", "name"], ["n"])


def fan_in_change(symbols: DataFrame, own: DataFrame, totals: DataFrame, change: DataFrame) -> DataFrame:
    """(path, name, qualified, fan_in) of the symbols whose fan-in may differ, those of names that the change touches: ``own`` (path, name, n)
    and ``totals`` (name, n) are the tables after it. Other symbols keep theirs."""
    names = change.select("name").distinct()
    some = symbols.join(names, "name", "left_semi")
    total = totals.join(names, "name", "left_semi").select("name", F.col("n").alias("_t"))
    mine = own.join(names, "name", "left_semi").select("path", "name", F.col("n").alias("_o"))
    out = some.join(total, "name", "left").join(mine, ["path", "name"], "left")
    return out.select("path", "name", "qualified", (F.coalesce("_t", F.lit(0)) - F.coalesce("_o", F.lit(0))).alias("fan_in"))


def edge_change(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(src, dst, n) of import edges of the changed files; n is how many imports support an edge, so one of two may go."""
    count = lambda e: e.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return signed(count(old_edges), count(new_edges), ["src", "dst"], ["n"])


def degree_change(kept_edges: DataFrame, change: DataFrame) -> DataFrame:
    """(node, n): how the numbers of different files that import a file change; ``kept_edges`` (src, dst, n) are those before."""
    before = change.select("src", "dst", F.col("n").alias("_d")).join(kept_edges, ["src", "dst"], "left").withColumn("_b", F.coalesce("n", F.lit(0)))
    step = (F.col("_b") + F.col("_d") > 0).cast("long") - (F.col("_b") > 0).cast("long")
    return before.groupBy(F.col("dst").alias("node")).agg(F.sum(step).alias("n")).where("n <> 0")
