"""Reports made of several operators: diffs, tests of a symbol, renames, lookups and the watch's ignore rules."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import composite, editing, history, intervals
from loomstone.sources import index
from loomstone.streaming import watch


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [("a.rs", "S", "S", "struct", None, 1, 20), ("a.rs", "f", "S.f", "fn", "S", 3, 6), ("a.rs", "g", "S.g", "fn", "S", 8, 12), ("a.rs", "twin", "twin", "fn", None, 30, 31), ("a.rs", "same", "same", "const", None, 30, 31), ("n.rs", "N", "N", "fn", None, 1, 2), ("n.rs", "m", "N.m", "fn", "N", 2, 2), ("t/x.txt", "H", "H", "fn", None, 1, 9)]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "path string, name string, qualified string, kind string, parent string, start_line int, end_line int, ord int").cache()


def test_diff_report(spark, symbols):
    changes = spark.createDataFrame([(0, "z.rs", 1, 1, True), (1, "a.rs", 4, 5, False), (2, "a.rs", 12, 13, False), (3, "a.rs", 30, 30, False), (4, "e.rs", 7, 7, False), (5, "t/x.txt", 1, 1, False)], "ord int, path string, lo int, hi int, deleted boolean")
    new = spark.createDataFrame([("n.rs",), ("b.rs",), ("notes.txt",)], "path string")
    got = [tuple(r)[:-1] for r in history.diff_report(changes, new, symbols).orderBy("place").collect()]
    assert got == [
        ("z.rs", "deleted", None, None, None, None),
        ("a.rs", "modified", "struct", "S", 1, 20),  # line 13 is in none of its functions
        ("a.rs", "modified", "fn", "S.f", 3, 6),
        ("a.rs", "modified", "fn", "S.g", 8, 12),
        ("a.rs", "modified", "const", "same", 30, 31),  # symbols of the same lines don't hold each other
        ("a.rs", "modified", "fn", "twin", 30, 31),
        ("e.rs", "modified", None, None, None, None),
        ("b.rs", "new", None, None, None, None),
        ("n.rs", "new", "fn", "N", 1, 2),  # a new file by its top level
    ]
    only = history.diff_report(changes.where("ord = 1"), new.where("false"), symbols).collect()
    assert [(r.symbol, r.status) for r in only] == [("S.f", "modified")]


def test_tests_of_a_symbol(spark):
    hits = [("a.rs", 3, "f"), ("a.rs", 5, "f"), ("a.rs", 9, "tests.uses_f"), ("a.rs", 8, "tests.uses_f"), ("b.rs", 4, "f"), ("tests/c.rs", 1, ""), ("d_test.py", 2, "g")]
    h = spark.createDataFrame(hits, "path string, ln int, symbol string")
    me = spark.createDataFrame([("a.rs", 3, 6, "f")], "path string, start_line int, end_line int, name string")
    got = sorted(map(tuple, composite.tests_for(h, me).collect()))
    assert got == [("a.rs", "tests.uses_f", 8, 1), ("d_test.py", "g", 2, 1), ("tests/c.rs", "", 1, 1)]  # b.rs has another f
    assert composite.tests_for(h.where("false"), me).count() == 0


def test_rename_is_refused_where_names_meet(spark, symbols):
    files = spark.createDataFrame([("a.rs", "fn f() { f() }\n")], "path string, text string")
    with pytest.raises(ValueError, match="'g' is already defined: a.rs:8"):
        editing.rename_plan(files, "f", "g", symbols)
    assert editing.rename_plan(files, "f", "h", symbols).first().new_text == "fn h() { h() }\n"


def test_lookup_reads_symbols_twice_at_most(spark, symbols, tmp_path):
    symbols.write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    found = composite.locate(table, "f", "a.rs")
    assert [r.qualified for r in found.collect()] == ["S.f"] and found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 2
    assert [r.qualified for r in composite.locate(table, "S").collect()] == ["S"]


def test_hits_are_searched_once(spark, symbols, tmp_path):
    spark.createDataFrame([("a.rs", "x\nfind me\n")], "path string, text string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    from loomstone.operators import search

    hits = intervals.enclosing(search.grep(files, "find"), symbols)
    assert [tuple(r) for r in hits.collect()] == [("a.rs", 2, "find me", "S")]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("/f]") + hits._jdf.queryExecution().optimizedPlan().toString().count("Relation [path#") <= 2


def test_watch_honours_ignore_rules(spark, tmp_path):
    root, table = tmp_path / "tree", str(tmp_path / "table")
    root.mkdir()
    (root / "kept.py").write_text("def kept(): pass\n")
    (root / "made.py").write_text("def made(): pass\n")
    (root / ".gitignore").write_text("made.py\n")
    assert watch.refresh(spark, str(root), table) == 1
    assert {r.path for r in watch.read(spark, table, "files").collect()} == {"kept.py"}
    (root / ".gitignore").write_text("kept.py\n")
    assert watch.refresh(spark, str(root), table) == 2  # one is gone, one is new
    assert {r.path for r in watch.read(spark, table, "files").select("path").collect()} == {"made.py"}
    assert {r.name for r in watch.read(spark, table).where(F.col("path") == "made.py").collect()} == {"made"}


def test_buckets_grow_with_the_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "BUCKETS", 2)
    monkeypatch.setattr(watch, "PER_BUCKET", 4)
    root, table = tmp_path / "tree", str(tmp_path / "table")
    root.mkdir()
    for k in range(5):
        (root / f"a{k}.py").write_text(f"def a{k}(): pass\n")
    size = lambda: watch.current(spark, table)["size"]
    names = lambda: sorted(r.name for r in watch.read(spark, table).collect())
    assert watch.refresh(spark, str(root), table) == 5 and size() == {"buckets": 2, "count": 5}
    for k in range(5):
        (root / f"b{k}.py").write_text(f"def b{k}(): pass\n")
    assert watch.refresh(spark, str(root), table) == 5 and size() == {"buckets": 8, "count": 10}
    assert names() == sorted([f"{x}{k}" for x in "ab" for k in range(5)])
    (root / "a0.py").unlink()
    (root / "b0.py").write_text("def other(a, b): pass\n")
    before = watch.current(spark, table)["files"]
    assert watch.refresh(spark, str(root), table) == 2 and size() == {"buckets": 8, "count": 9}
    after = watch.current(spark, table)["files"]
    assert sum(before.get(k) != after.get(k) for k in set(before) | set(after)) <= 2  # the others stay where they are
    assert names() == sorted([f"a{k}" for k in range(1, 5)] + [f"b{k}" for k in range(1, 5)] + ["other"])
    assert {r.path for r in watch.read(spark, table, "files").collect()} == {f"a{k}.py" for k in range(1, 5)} | {f"b{k}.py" for k in range(5)}


def test_manifests_of_a_workspace(spark, tmp_path):
    for place, name in (("", "top-one"), ("crates/a", "crate-a"), ("x/y/z", "deep_enough"), ("x/y/z/w", "too-deep"), ("target/p", "built"), ("node_modules/q", "vendored"), (".hidden", "hidden")):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "Cargo.toml").write_text(f'[package]\nname = "{name}"\nversion = "1"\n')
    (tmp_path / "other.toml").write_text('name = "other"\n')
    found = index.crate_names(index.manifests(spark, str(tmp_path)).select("value"))
    assert {r.name for r in found.collect()} == {"top_one", "crate_a", "deep_enough"}


def test_small_formats(spark):
    from loomstone.functions import code, text

    n = spark.createDataFrame([(0,), (999,), (1000,), (1250,), (1350,), (-2500,), (999_999,), (1_000_000,), (12_345_678,)], "n long")
    assert [r[0] for r in n.select(text.short_count(F.col("n"))).collect()] == ["0", "999", "1.0k", "1.2k", "1.4k", "-2.5k", "1000.0k", "1.0M", "12.3M"]
    t = spark.createDataFrame([("abc",), ("abcdef",), ("äöüß",), (None,)], "t string")
    assert [r[0] for r in t.select(text.left_cut(F.col("t"), 4)).collect()] == ["abc ", "…def", "äöüß", None]
    assert [r[0] for r in t.select(text.left_cut(F.col("t"), 1)).collect()] == ["…", "…", "…", None] and t.select(text.left_cut(F.col("t"), 0)).first()[0] == ""
    p = spark.createDataFrame([("Src/a_b.rs",), ("src/axb.rs",), ("src%/a",), ("lib/src",)], "p string")
    hit = lambda c: [r[0] for r in p.where(c).collect()]
    assert hit(code.entries_prefix(F.col("p"), "src/A_b")) == ["Src/a_b.rs", "src/axb.rs"] and hit(code.deps_prefix(F.col("p"), "src/a")) == ["src/axb.rs"]
    assert hit(code.entries_prefix(F.col("p"), "s%c")) == ["Src/a_b.rs", "src/axb.rs", "src%/a"]
