"""Plans that send no growing table whole and hand on no pairs."""

import random

from pyspark.sql import functions as F

from loomstone.functions import imports, text as text_
from loomstone.operators import binding, composite, graph, ranking
from loomstone.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_are_resolved_without_a_broadcast(spark):
    files = spark.createDataFrame([("src/a.py", "python", "import b\n"), ("src/b.py", "python", "import a, os\n")], "path string, lang string, text string")
    got = imports.resolve(imports.specs_of(files).distinct(), files)
    assert "Broadcast" not in plan(got) and sorted(map(tuple, got.collect())) == [("src/a.py", "b", "src/b.py"), ("src/b.py", "a", "src/a.py")]
    all_ = composite.dependencies(files)
    assert "Broadcast" not in plan(all_["edges"]) + plan(all_["external"]) and all_["edges"].count() == 2


def test_scopes_are_followed_without_a_broadcast(spark):
    seen = []

    def step(df, tag):
        seen.append(plan(df))
        return df

    parents = spark.createDataFrame([("a#b#c", "a#b"), ("a#b", "a"), ("a", "/")], "scope string, parent string")
    assert binding.ancestors(parents, step).count() == 10
    bindings = spark.createDataFrame([("x", "f", "import", "x", 1, "y", ["f"]), ("y", "f", "import", "y", 1, "z", ["f"])], "scope string, name string, kind string, path string, line int, to string, push array<string>")
    assert {r.to for r in binding.shortened(bindings, step).collect()} == {"z"}
    assert len(seen) > 5 and not any("Broadcast" in p for p in seen)


def test_types_of_uses_without_pairs(spark):
    rnd = random.Random(4)
    types = [(rnd.choice("AB"), rnd.choice([f"p{k}" for k in range(5)] + [None]), rnd.randrange(4)) for _ in range(60)]
    used = [(f"p{k}", n) for k in range(7) for n in "ABC"]
    for k in (1, 2, 3):
        got = composite.referenced_types(spark.createDataFrame(used * 2, "of string, name string"), spark.createDataFrame(types, "name string, path string, ln int"), k)
        wanted = [(of, n, p, ln) for of, n in used for p, ln in sorted((p, ln) for m, p, ln in types if m == n and p not in (None, of))[:k]]
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
        text = plan(got)
        assert text.index("Join") < text.index("Exchange")  # the joined rows are the result


def test_calls_are_narrowed_by_counts(spark):
    rnd = random.Random(5)
    pick = lambda *xs: rnd.choice([*xs, None])
    calls = [(rnd.randrange(40), rnd.choice("abcd"), pick("s", "t", "u"), pick("d/x", "d/y", "e/z"), pick(0, 1, 2)) for _ in range(80)]
    defs = [(rnd.choice("abcde"), k, pick("s", "t", "u"), pick("d/x", "e/z", "e/w", "g/h"), pick(0, 1, 2), rnd.random() < 0.5) for k in range(14)]
    c = spark.createDataFrame(calls, "call_id long, name string, my_scope string, my_file string, argc int")
    d = spark.createDataFrame(defs, "name string, callee long, scope string, file string, params int, is_method boolean")
    wanted = graph.narrow_by_scope(c.join(d, "name")).select("call_id", "callee", "ambiguous")
    got = graph.narrow_calls(c, d, "name").select("call_id", "callee", "ambiguous")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.where(F.col("ambiguous")).count()


def test_calls_and_definitions_share_one_shuffle(spark):
    rnd = random.Random(6)
    files = [(f"p{rnd.randrange(9)}", rnd.choice([None, "", *["\n".join(" ".join(rnd.choice(["alphabet", "betatron9", "Gammaray_", "tiny", "9alphabet"]) for _ in range(rnd.randrange(4))) for _ in range(25))] * 4])) for _ in range(30)]
    apart = lambda ln: ln % 10 == 1
    seen = ranking.sightings(spark.createDataFrame(files, "path string, text string"), 8, apart)
    at = {}
    for path, text in files:
        for ln, line in enumerate((text or "").split("\n"), 1):
            for name in line.split():
                if len(name) >= 8 and not name[0].isdigit():
                    at.setdefault((path, name), set()).add(ln)
    defs = [(p, n, min(own)) for (p, n), lns in at.items() if (own := {k for k in lns if k % 10 == 1})]
    wanted = [(c, n, min(lns), p, ln) for (c, n), lns in at.items() for p, m, ln in defs if m == n and p != c]
    got = graph.callees_of_sightings(seen, apart).select("caller", "name", "ln", "callee_file", "start_line")
    assert wanted and sorted(map(tuple, got.collect())) == sorted(wanted)
    assert seen.count() < sum(len(lns) for lns in at.values())  # occurrences stay in their file

    whole = catalogue.QUERIES["callees_join"](spark, "/root/testdata/sf0.001")
    whole.collect()
    final = plan(whole).split("== Initial Plan ==")[0]
    assert final.count("- Exchange") == 1 and final.count("- ReusedExchange") == 1


def test_pairs_of_one_name_are_dealt_over_tasks(spark):
    rnd = random.Random(7)
    apart = lambda ln: ln % 10 == 1
    rows = [(f"p{k}", "frequent", ln) for k in range(60) for ln in (rnd.randrange(2, 9), *[11] * (k % 3 == 0))]
    rows += [(f"p{rnd.randrange(60)}", f"name{rnd.randrange(40)}", rnd.randrange(1, 30)) for _ in range(300)] + [("p1", None, 1), ("p2", None, 1)]
    got = graph.callees_of_sightings(spark.createDataFrame(rows, "path string, name string, ln int"), apart, block=8, pairs=200)
    at = {}
    for path, name, ln in rows:
        at.setdefault((path, name), set()).add(ln)
    defs = [(p, n, min(own)) for (p, n), lns in at.items() if (own := {k for k in lns if k % 10 == 1})]
    wanted = [(c, n, min(lns), p, ln) for (c, n), lns in at.items() if n for p, m, ln in defs if m == n and p != c]
    assert sorted(map(tuple, got.select("caller", "name", "ln", "callee_file", "start_line").collect())) == sorted(wanted)
    made = [n for _, n in got.where("name = 'frequent'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 60 * 20 - 20 and len(made) > 3 and max(made) < sum(made) / 2  # before, one task had them all


def test_long_identifiers_are_those_of_all_lines(spark):
    texts = ["éalphabet9 9alphabet alphabet\r\n_x_x_x_x-alphabetalphabet", "short\n\n\nalphabet", "", None, "ab a _ 1a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for least in (1, 2, 8):
        for text, got, whole in df.select("text", text_.long_identifiers("text", least), text_.identifiers(F.col("text"))).collect():
            assert got == (whole if text is None else [n for n in whole if len(n) >= least])
