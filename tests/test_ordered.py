"""Ordered scans over ranges, and dyadic interval joins, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import intervals, ordered


def test_running_sums_runs_and_budgets(spark):
    r = random.Random(3)
    rows = [(k, r.choice("aab"), r.randint(0, 9)) for k in range(400)]
    df = spark.createDataFrame(r.sample(rows, 400), "k int, s string, v int").repartition(5)
    for ranges in (1, 7):
        o = ordered.Ordered(df, ["k"], ranges=ranges)
        got = {x.k: x.total for x in o.running(F.col("v"), "total").collect()}
        sums, t = {}, 0
        for k, _, v in rows:
            t += v
            sums[k] = t
        assert got == sums
        assert {x.k: x.pos for x in o.positions().collect()} == {k: k + 1 for k in range(400)}
        runs, n, last = {}, 0, None
        for k, s, _ in rows:
            n, last = n + (s != last), s
            runs[k] = n
        assert {x.k: x["_run"] for x in o.runs(["s"]).collect()} == runs
        assert sorted(x.k for x in o.within(F.col("v"), 50).collect()) == [k for k, total in sums.items() if total <= 50]


def test_no_task_sees_all_rows(spark):
    o = ordered.Ordered(spark.range(1000).withColumn("v", F.col("id") % 7), ["id"], ranges=8)
    for df in (o.running(F.col("v"), "t"), o.runs(["v"]), o.within(F.col("v"), 90)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def plain_tree(fan, budget):
    rows = sorted((x for x in fan if not (x[3] == "mod" and x[4] == x[5])), key=lambda x: (-x[6], x[1], x[0], x[4], x[2]))
    out, k, spent = [], 0, 0
    while k < len(rows):
        p, name, q, kind, s, e, f = rows[k]
        run = 1
        while k + run < len(rows) and (rows[k + run][6], rows[k + run][1], rows[k + run][3]) == (f, name, kind):
            run += 1
        line = f"{f:>4}×  {kind} {name}  (×{run} files)\n" if run >= 3 else f"{f:>4}×  {kind} {q}  {p}:{s}-{e}\n"
        spent += (len(line.encode()) + 3) // 4
        if spent > budget:
            break
        out.append((len(out) + 1, f, kind, name, q, p, s, e, run if run >= 3 else 1))
        k += run if run >= 3 else 1
    return out


@pytest.mark.parametrize("budget", [0, 60, 700, 10**6])
def test_tree_rank(spark, budget):
    r = random.Random(9)
    fan = []
    for k in range(120):
        name, kind, s = r.choice(["tests", "run", "é", f"f{k}"]), r.choice(["mod", "fn", "fn"]), r.randint(1, 5)
        fan.append((f"p{r.randint(0, 40):02}/x{k}", name, name, kind, s, s + r.randint(0, 3), 12345 if k == 3 else {"tests": 0, "run": 7, "é": 7}.get(name, r.randint(0, 3))))
    df = spark.createDataFrame(r.sample(fan, len(fan)), "path string, name string, qualified string, kind string, start_line int, end_line int, fan_in long").repartition(3)
    got = sorted(tuple(x) for x in ordered.tree_rank(df, budget, ranges=6).collect())
    assert got == plain_tree(fan, budget)
    assert ordered.tree_rank(df.where("false"), budget).count() == 0


def test_cover_holds_each_line_once(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a, 40)] + [(7, 100_000), (2**30, 2**31 - 2), (1, 1)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", intervals.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        spans = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.c)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (r.b - r.a + 1).bit_length()


@pytest.mark.parametrize("seed", [1, 2])
def test_dyadic_join_equals_the_range_join(spark, seed):
    r = random.Random(seed)
    symbols = [(p, s, s + r.choice([0, 1, 3, 40, 900]), k, f"{p}.{k}") for k in range(200) for p, s in [(r.choice(["a", "a", "a", "b"]), r.randint(1, 500))]]
    hits = [(r.choice(["a", "b", "c"]), r.randint(1, 1500), r.choice(["x", "y"]), None) for _ in range(300)] + [("a", 5, "x", None)] * 2
    s = spark.createDataFrame(symbols, "path string, start_line int, end_line int, ord int, qualified string")
    h = spark.createDataFrame(hits, "path string, ln int, line string, extra int")
    for keep in (True, False):
        want = sorted(map(tuple, intervals.enclosing(h, s, keep).collect()), key=str)
        assert sorted(map(tuple, intervals.enclosing_dyadic(h, s, keep).collect()), key=str) == want
    best = lambda p, ln: max(((a, -b, o, q) for sp, a, b, o, q in symbols if sp == p and a <= ln <= b), default=("",))[-1]
    assert sorted(map(tuple, intervals.enclosing_dyadic(h, s).collect()), key=str) == sorted(((*x, best(x[0], x[1])) for x in hits), key=str)
    bare = h.select("path", "ln")
    assert intervals.enclosing(bare, s).count() == len(hits) == intervals.enclosing_dyadic(bare, s.where("false")).count()


def test_a_huge_file_is_dealt_over_tasks(spark):
    """All symbols and hits in one file: the join's keys put them into every task."""
    s = spark.range(3000).select(F.lit("a").alias("path"), (F.col("id") * 3 + 1).cast("int").alias("start_line"), (F.col("id") * 3 + 9).cast("int").alias("end_line"), F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("qualified"))
    cover = s.select("path", F.explode(intervals.dyadic_cover(F.col("start_line"), F.col("end_line"))).alias("b"))
    dealt = cover.repartition(4, "path", "b.level", "b.block").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(x["count"] for x in dealt) < 2 * min(x["count"] for x in dealt)
