"""Mixing sources to target weights by exact subset sums of document lengths.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the words of all
documents; a target stops at three times its source's size, the excess going to the others by weight.
With T the total, that is target_i = min(3 S_i, x w_i), where x makes the targets add up to T; x follows
from the sources sorted by 3 S_i / w_i.

A source takes each document floor(target / S) times. The remaining budget r < S is filled from one
count of documents for each exact length: every length first gives its share floor(n * r / S), then
single documents follow, longest lengths first, until less than a margin is left; a bounded-knapsack
dynamic programme over the bitset of reachable sums spends the margin exactly where the lengths allow
it, over all lengths, else as nearly as they do. Only this histogram of lengths, one source at a time, is gathered in a task.

Which documents of a length are taken follows a seeded hash of ids and texts: large lengths are dealt into
buckets of about 500 documents by the hash, rows that share id and text further by row number, whole buckets are
taken in order, and only the one that the count ends in is ranked. No window holds more than a bucket of rows,
however many documents share a length, an id or a text; the window over buckets sees one row for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import n_words

SEED, BUCKET, MOST = 20_011, 500, 3


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target. One row for each source; the windows see only these."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    cap = weighed.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = cap.withColumn("all", F.sum("source_size").over(Window.partitionBy())).withColumn("x", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # x of the first source whose cap isn't reached; sources before it take their caps.
    level = level.withColumn("level", F.min(F.when(F.col("x") <= F.col("ratio"), F.struct("ratio", "x"))).over(Window.partitionBy())["x"])
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to the budget, or to what is nearest above or below."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(n) * budget // total for n in counts.tolist()], np.int64)
    left = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    # Spread single documents over the lengths; stop while there is room for the exact search.
    margin = int(np.median(np.repeat(lengths, np.minimum(counts, 50)))) * 8
    for k in order.tolist():
        if left <= margin:
            break
        if taken[k] < counts[k] and 0 < lengths[k] <= left - margin // 2:
            taken[k] += 1
            left -= int(lengths[k])
    while left > margin:  # few distinct lengths: as many as fit of each
        before = left
        for k in order.tolist():
            more = min(int(counts[k] - taken[k]), max(0, left - margin // 2) // max(1, int(lengths[k])))
            taken[k] += more
            left -= more * int(lengths[k])
        if left == before:
            break
    return taken + knapsack(lengths, counts - taken, left)


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over all lengths: how many of each make the sum nearest to the budget, above or below; the lower of two.

    A document longer than the budget only helps alone, the shortest of them. The others' sums matter up to twice the budget,
    as taking nothing is as near as that. Copies of a length go in powers of two. ``first`` holds the step that reached each sum first; what is
    left of a sum without that step was reached before, so one number for each sum is all that is kept.
    """
    out = np.zeros(len(lengths), np.int64)
    order = [k for k in np.argsort(lengths, kind="stable").tolist() if lengths[k] > 0 and free[k] > 0]
    fits = [k for k in order if lengths[k] <= budget]
    alone = next((k for k in order if lengths[k] > budget), None)
    limit = min(2 * budget, sum(int(lengths[k]) * min(int(free[k]), 2 * budget // int(lengths[k])) for k in fits))
    first = np.full(limit + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(-1, 0)]
    for k in fits:
        if budget <= limit and first[budget] >= 0:
            break
        size = int(lengths[k])
        many, chunk = min(int(free[k]), limit // size), 1
        while many > 0:
            c = min(chunk, many)
            width = c * size
            reached = (first[:-width] >= 0) & (first[width:] < 0)
            first[width:][reached] = len(steps)
            steps.append((k, c))
            many, chunk = many - c, chunk * 2
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    if alone is not None and int(lengths[alone]) - budget < abs(at - budget):
        out[alone] = 1
        return out
    while at > 0:
        k, c = steps[first[at]]
        out[k] += c
        at -= c * int(lengths[k])
    return out


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    budget = int(round(target))
    times = min(MOST, budget // size) if size else 0
    extra = fill(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget - times * size) if times < MOST else np.zeros(len(rows), np.int64)
    return rows[["source", "size", "n", "source_size", "target"]].assign(times=times, extra=extra)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs.

    With ``carry`` there is also ``row``, a struct of those columns, so that each row has its own ``taken``
    even where ids are null or repeated.

    Null texts have size 0; such documents, and empty ones, take nothing. A null source is a source of its
    own. Rows with equal ids and texts are alike, so it doesn't matter which of them is taken.
    """
    step = Steps(docs.sparkSession)
    extra = [F.struct(*carry).alias("row")] if carry else []
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(id_col, text, F.lit(seed)).alias("h"), F.monotonically_increasing_id().alias("r"), *extra)
    rows = step(rows, "sizes")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = targets(sizes).withColumnRenamed("source", "of")
    planned = lengths.join(shares, lengths["source"].eqNullSafe(shares["of"])).drop("of").groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, times int, extra long")
    plan = step(planned.select(F.col("source").alias("of"), F.col("size").alias("length"), "source_size", "target", "times", "extra", F.ceil(F.col("n") / BUCKET).cast("int").alias("buckets")), "plan")
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["of"]) & (rows["size"] == plan["length"])).withColumn("bucket", F.pmod("h", F.col("buckets")).cast("int"))
    # Rows without a choice need no rank. Rows of one hash are alike; many of them are dealt on by their row numbers.
    choice = dealt.where("extra > 0").groupBy("of", "length", "bucket", "h").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    choice = step(choice.withColumn("parts", F.ceil(F.col("m") / BUCKET).cast("int")), "choice")
    alike = choice.where("parts > 1").select(F.col("of").alias("ho"), F.col("length").alias("hl"), F.col("h").alias("hh"), "parts")
    dealt = dealt.join(alike, dealt["of"].eqNullSafe(alike["ho"]) & (dealt["length"] == alike["hl"]) & (dealt["h"] == alike["hh"]), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod("r", F.col("parts")).cast("int") + 1, F.lit(0)))
    # Documents in earlier buckets of a length: those of single hashes as part 0, the others by part.
    single = choice.where("parts = 1").groupBy("of", "length", "bucket").agg(F.sum("m").alias("m"), F.first("extra").alias("extra")).withColumn("part", F.lit(0)).withColumn("hh", F.lit(None).cast("long"))
    many = dealt.where("extra > 0 and part > 0").groupBy("of", "length", "bucket", "hh", "part").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    earlier = Window.partitionBy("of", "length").orderBy("bucket", F.col("hh").isNotNull(), "hh", "part").rowsBetween(Window.unboundedPreceding, -1)
    quota = single.unionByName(many).withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    quota = quota.select(F.col("of").alias("qo"), F.col("length").alias("ql"), F.col("bucket").alias("qb"), F.col("hh").alias("qh"), F.col("part").alias("qp"), F.greatest(F.lit(0), F.least("m", F.col("extra") - F.col("before"))).alias("quota"))
    same = dealt["of"].eqNullSafe(quota["qo"]) & (dealt["length"] == quota["ql"]) & (dealt["bucket"] == quota["qb"]) & dealt["hh"].eqNullSafe(quota["qh"]) & (dealt["part"] == quota["qp"])
    ranked = dealt.join(quota, same, "left")
    rank = F.row_number().over(Window.partitionBy("of", "length", "bucket", "hh", "part").orderBy("h", "r"))
    one = F.when(rank <= F.coalesce("quota", F.lit(0)), 1).otherwise(0)
    return ranked.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), ((F.col("times") + one) * F.col("size")).cast("long").alias("taken"), *(["row"] if carry else []))
