"""Signed changes against rebuilds after random edits, stored byte sums, and searches from both ends over bucketed edges."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import deltas, graph, intervals, ranking


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_equal_a_rebuild(spark, seed):
    r = random.Random(seed)
    make = lambda files: spark.createDataFrame([(p, n, k) for p, names in files.items() for k, n in enumerate(names)], "path string, name string, ln int")
    imports = lambda files: spark.createDataFrame([(p, n) for p, names in files.items() for n in names if n.startswith("m")], "src string, dst string")
    names = ["a", "b", "c", "m1", "m2", "m3"]
    files = {f"m{k}": [r.choice(names) for _ in range(r.randint(0, 8))] for k in range(8)}
    own = ranking.occurrence_counts(make(files)).select("path", "name", "n").cache()
    totals = own.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("files")).cache()
    edges = imports(files).groupBy("src", "dst").agg(F.count("*").alias("n")).cache()
    degrees = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).cache()
    symbols = spark.createDataFrame([(p, n, f"{p}.{n}") for p in files for n in names[:4]], "path string, name string, qualified string")
    fan = lambda o, t: {(x.path, x.name): x.fan_in for x in ranking.fan_in(symbols, None, o.withColumn("ln", F.lit(1))).collect()}
    for _ in range(2):
        edited = dict(files)
        for p in r.sample(sorted(files), 3):
            edited[p] = [r.choice(names) for _ in range(r.randint(0, 8))]
        edited.pop(r.choice(sorted(edited)))
        edited[f"new{r.random()}"] = ["a", "zz", "m1"]
        paths = [p for p in set(files) | set(edited) if files.get(p) != edited.get(p)]
        only = lambda f: {p: f[p] for p in paths if p in f}
        change = deltas.occurrence_change(make(only(files)), make(only(edited))).cache()
        before = fan(own, totals)
        # Files that hold a name for the first time, or no longer, count one more or less.
        sign = change.join(own.select("path", "name", F.col("n").alias("b")), ["path", "name"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
        held = ((F.col("b") + F.col("n")) > 0).cast("long") - (F.col("b") > 0).cast("long")
        by_name = deltas.coarser(sign, ["name"], ["n"], {"files": held})
        own = deltas.applied(own, change, ["path", "name"], ["n"], "n").cache()
        totals = deltas.applied(totals, by_name, ["name"], ["n", "files"], "n").cache()
        e = deltas.edge_change(imports(only(files)), imports(only(edited))).cache()
        degrees = deltas.applied(degrees, deltas.degree_change(edges, e), ["node"], ["n"], "n").cache()
        edges = deltas.applied(edges, e, ["src", "dst"], ["n"], "n").cache()
        after = before | {(x.path, x.name): x.fan_in for x in deltas.fan_in_change(symbols, own, totals, change).collect()}
        files = edited
        whole = ranking.occurrence_counts(make(files)).select("path", "name", "n")
        assert rows(own) == rows(whole) and rows(totals) == rows(whole.groupBy("name").agg(F.sum("n"), F.count("*")))
        assert rows(edges) == rows(imports(files).groupBy("src", "dst").count()) and rows(degrees) == rows(imports(files).distinct().groupBy("dst").count())
        assert after == fan(whole, totals)
    assert deltas.occurrence_change(make(files), make(files)).count() == 0


@pytest.mark.parametrize("pad", [0, 2, 40])
def test_stored_sums_cost_the_same(spark, pad):
    r = random.Random(pad)
    sizes = {f"f{k}": [r.randint(0, 60) for _ in range(n)] for k, n in enumerate([1, 3, 63, 64, 65, 128, 400])}
    lines = spark.createDataFrame([(p, k, b) for p, s in sizes.items() for k, b in enumerate(s, 1)], "path string, ln int, n_bytes int")
    hits = spark.createDataFrame([(p, r.randint(-3, len(s) + 60)) for p, s in sizes.items() if p != "f3" for _ in range(r.randint(1, 6))] + [("f6", 900), ("gone", 1)], "path string, ln int")
    sums = intervals.line_sums(lines)
    # A window may begin or end outside of the file; the line map only knows hits on lines.
    inside = hits.join(lines.select("path", "ln"), ["path", "ln"], "left_semi")
    assert rows(intervals.baseline_from_sums(sums, inside, pad)) == rows(intervals.baseline_tokens(lines, inside, pad))
    assert rows(intervals.baseline_from_sums(sums, hits.where("false"), pad)) == rows(intervals.baseline_tokens(lines, hits.where("false"), pad))
    spans = {}
    for p, a, b in rows(intervals.merged_windows(inside, lines.groupBy("path").agg(F.max("ln").alias("n")), pad)):
        assert a <= b and all(b2 + 1 < a or a2 > b + 1 for a2, b2 in spans.get(p, ()))
        spans.setdefault(p, []).append((a, b))


def test_search_from_both_ends(spark):
    r = random.Random(5)
    pairs = [(a, b) for a in range(60) for b in r.sample(range(60), 2) if a != b] + [(100 + k, 101 + k) for k in range(9)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    bucketed = graph.BucketedEdges(edges, buckets=4)
    try:
        cases = [((0,), (59,), 8), ((1, 2), (40, 41), 8), ((100,), (108,), 8), ((100,), (109,), 8), ((3,), (3,), 8), ((59,), (100,), 8), ((777,), (1,), 8), ((0,), (30,), 1), ((5, 6, 7), (20, 30), 8)]
        for start, goal, depth in cases:
            want = rows(graph.shortest_path(edges, node(*start), node(*goal), depth))
            assert rows(graph.meet(bucketed, node(*start), node(*goal), depth)) == want, (start, goal)
        size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for table, key in ((bucketed.out(), "src"), (bucketed.into(), "dst")):
            plan = table.join(node(1, 2).select(F.col("node").alias(key)), key)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the frontier's alone
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    finally:
        bucketed.drop()
