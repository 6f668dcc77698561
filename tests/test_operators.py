"""Operators against brute force and worked cases."""

import os
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from loomstone.functions import grammar
from loomstone.operators import calls as calls_
from loomstone.operators import composite, editing, graph, history, intervals, ranking, registry, search, usage
from loomstone.sources import extract, git, hooks, index
from loomstone.streaming import sessions, watch

SYMBOL = "path string, name string, qualified string, kind string, parent string, start_line int, end_line int, signature string, ord int"


def symbols(spark, rows):
    return spark.createDataFrame([(p, q.rsplit(".", 1)[-1], q, "fn", q.rpartition(".")[0] or None, a, b, f"fn {q}()", i) for i, (p, q, a, b) in enumerate(rows)], SYMBOL)


@pytest.mark.parametrize("seed", range(3))
def test_enclosing_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f, f"s{k}", a, a + rng.randrange(12)) for f in "fgh" for k, a in enumerate(rng.choices(range(1, 30), k=6))]
    at = [(f, ln) for f in "fgh" for ln in rng.sample(range(1, 45), 15)]
    wanted = {(f, ln): max(((a, -b, k, q) for k, (p, q, a, b) in enumerate(rows) if p == f and a <= ln <= b), default=(0, 0, 0, ""))[-1] for f, ln in at}
    hits = spark.createDataFrame(at, "path string, ln int")
    for enclosing in (intervals.enclosing, intervals.enclosing_dense):
        assert {(r.path, r.ln): r.symbol for r in enclosing(hits, symbols(spark, rows)).collect()} == wanted


@pytest.mark.parametrize("seed", range(3))
def test_baseline_matches_brute_force(spark, seed):
    rng, lines, marks, wanted = random.Random(seed), [], [], {}
    for f in "fghij":
        sizes, hits, pad = [rng.randrange(30) for _ in range(rng.randrange(1, 40))], [rng.randrange(-5, 50) for _ in range(rng.randrange(5))], seed * 2
        n = len(sizes)
        covered = {k for h in hits if 1 <= h <= n for k in range(max(1, h - pad), min(n, h + pad) + 1)} or set(range(1, n + 1))
        wanted[f] = (sum(sizes[k - 1] + 1 for k in covered) + 3) // 4
        lines += [(f, k + 1, b) for k, b in enumerate(sizes)]
        marks += [(f, h) for h in hits]
    got = intervals.baseline_tokens(spark.createDataFrame(lines, "path string, ln int, n_bytes int"), spark.createDataFrame(marks, "path string, ln int"), seed * 2)
    assert {r.path: r.tokens for r in got.collect()} == wanted


def test_baseline_of_one_hit(spark):
    lines = spark.range(1, 501).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("ln"), F.lit(80).alias("n_bytes"))
    hit = spark.createDataFrame([("f", 250)], "path string, ln int")
    assert intervals.baseline_tokens(lines, hit).first().tokens == (81 * 80 + 81 + 3) // 4


def test_covered_containers_go(spark):
    s = symbols(spark, [("f", "A", 1, 20), ("f", "A.m", 5, 8), ("f", "A.n", 10, 12), ("f", "B", 30, 40)])
    ranges = lambda *r: spark.createDataFrame([("f", a, b) for a, b in r], "path string, lo int, hi int")
    left = lambda r: sorted(x.qualified for x in intervals.uncovered(intervals.overlapping(s, r), r).collect())
    assert left(ranges((6, 7))) == ["A.m"] and left(ranges((6, 9))) == ["A", "A.m"] and left(ranges((8, 8), (11, 35))) == ["A", "A.m", "A.n", "B"] and left(ranges((25, 26))) == []


def cands(spark, rows):
    return spark.createDataFrame(rows, "call_id int, my_scope string, my_file string, argc int, scope string, file string, params int, is_method boolean, id string")


def test_narrowing(spark):
    rows = [
        (1, "A", "a.rs", None, "A", "x.rs", 0, False, "same scope"), (1, "A", "a.rs", None, "B", "a.rs", 0, False, "same file"),
        (2, "C", "a.rs", None, "A", "x.rs", 0, False, "x"), (2, "C", "a.rs", None, "B", "a.rs", 0, False, "same file"),
        (3, None, "m/z.ts", None, None, "m/near.ts", 0, False, "near"), (3, None, "m/z.ts", None, None, "far/f.ts", 0, False, "far"),
        (4, None, "q.rs", 2, None, "a/x.rs", 2, False, "two"), (4, None, "q.rs", 2, None, "b/y.rs", 1, False, "one"),
        (5, None, "q.rs", 1, "A", "a/x.rs", 1, False, "free"), (5, None, "q.rs", 0, "B", "b/y.rs", 1, True, "method"),
        (6, None, "q.rs", 9, None, "a/x.rs", 2, False, "p"), (6, None, "q.rs", 9, None, "b/y.rs", 1, False, "q"),
    ]
    got = {}
    for r in graph.narrow_by_scope(cands(spark, rows)).collect():
        got.setdefault(r.call_id, set()).add((r.id, r.ambiguous))
    assert got[1] == {("same scope", False)} and got[2] == {("same file", False)} and got[3] == {("near", False)} and got[4] == {("two", False)}
    assert got[6] == {("p", True), ("q", True)}


def test_paths_and_closures(spark):
    edges = spark.createDataFrame([("high", "mid"), ("mid", "low"), ("other", "x"), ("low", "high")], "src string, dst string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    chain = lambda a, b, d=8: [r.node for r in graph.shortest_path(edges, node(a), node(b), d).orderBy("pos").collect()]
    assert chain("high", "low") == ["high", "mid", "low"] and chain("other", "low") == [] and chain("high", "high") == ["high"] and chain("high", "low", 1) == []
    assert {(r.node, r.depth) for r in graph.reach(edges, node("high"), 5).collect()} == {("high", 0), ("mid", 1), ("low", 2)}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    assert [tuple(r) for r in graph.mutual_pairs(pairs).collect()] == [("a", "b")]


LOG = "\x01h2\tBob\t200\tsecond: a\tb\n\n5\t1\tsrc/{a.rs => b.rs}\n-\t-\timg.png\n\x01h1\tAlice\t100\tfirst\n\n3\t4\tsrc/b.rs\n10\t0\tc.rs\n"


def test_history(spark):
    log = history.parse_numstat(spark.createDataFrame([("r", LOG)], "repo string, raw string"))
    assert [(r.hash, r.author, r.ts, r.subject) for r in log.orderBy("seq").collect()] == [("h2", "Bob", 200, "second: a\tb"), ("h1", "Alice", 100, "first")]
    files = git.commit_files(log)
    churn = {r.path: r for r in history.churn(files).collect()}
    assert (churn["src/b.rs"].commits, churn["src/b.rs"].lines, churn["src/b.rs"].last_author) == (2, 13, "Bob") and churn["img.png"].lines == 0
    assert {r.path: r.together for r in history.co_change(files, "src/b.rs").collect()} == {"img.png": 1, "c.rs": 1}


def test_hunks(spark):
    raw = "--- a/x.rs\n+++ b/x.rs\n@@ -10,2 +12,3 @@ fn\n+a\n@@ -40,2 +33,0 @@\n--- /dev/null\n+++ b/new.rs\n@@ -0,0 +1,5 @@\n--- a/old.rs\n+++ /dev/null\n@@ -1,9 +0,0 @@\n"
    got = [(r.path, r.lo, r.hi, r.deleted) for r in history.parse_hunks(spark.createDataFrame([(1, raw)], "id int, raw string")).collect()]
    assert got == [("x.rs", 12, 14, False), ("x.rs", 33, 33, False), ("new.rs", 1, 5, False), ("old.rs", 1, 1, True)]


def test_runs_tops_and_budgets(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aaabbaccc")], "g int, i int, v string")
    got = [(r.v, r.first_pos, r.run) for r in ranking.collapse_runs(rows, ["g"], ["i"], ["v"]).orderBy("first_pos").collect()]
    assert got == [("a", 1, 3), ("b", 4, 1), ("b", 5, 1), ("a", 6, 1), ("c", 7, 3)]
    cost = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 20)], "g int, i int, c int")
    assert [(r.g, r.i) for r in search.budget_prefix(cost, ["g"], ["i"], F.col("c"), 10).collect()] == [(1, 1)]
    assert [r.more for r in ranking.clip(cost, ["g", "i"], 4).collect()] == [False] * 4 and ranking.clip(cost, ["g", "i"], 2).first().more


def test_tidy_and_totals(spark):
    log = spark.createDataFrame([(i, 1000 + i, "p", "hook:read-block" if i == 3 else "find", 5, 1, 10, 90, "x") for i in range(1, 11)], "id long, ts long, project string, cmd string, ms long, results long, tokens_out long, tokens_saved long, detail string")
    assert sorted(r.id for r in usage.tidy(log, 1010, keep_rows=4).collect()) == [7, 8, 9, 10]
    assert sorted(r.id for r in usage.tidy(log, 1010, keep_seconds=2).collect()) == [8, 9, 10]
    t = usage.totals(log).first()
    assert (t.calls, t.blocks, t.pct_saved) == (10, 1, 90.0) and usage.totals(log.limit(0)).first().pct_saved == 0.0


SOURCES = [
    ("a.rs", "rust", "pub struct Cache<K, V> { map: Vec<(K, V)> }\nimpl<K: Eq, V> Cache<K, V> {\n    pub fn get(&self, k: &K) -> Option<&V> { None }\n    pub fn put(&mut self, k: K, v: V) {}\n}\npub fn free_fn() {}\n", {"Cache", "Cache.get", "Cache.put", "free_fn"}),
    ("a.py", "python", "class A:\n    def m(self):\n        pass\n\ndef top():\n    pass\n", {"A", "A.m", "top"}),
    ("a.c", "c", "struct point;\nvoid f(struct point p) {\n}\n", {"f"}),
    ("a.ts", "typescript", "export const handler = async (req: Request) => {\n  return null\n}\nconst legacy = function () {}\nclass C {\n  onClick = () => {}\n  area() { return 3 }\n}\nconst nested = () => {\n  const inner = () => {}\n}\nconst notAFn = 42\n", {"handler", "legacy", "C", "C.onClick", "C.area", "nested", "nested.inner"}),
    ("a.go", "go", "package main\n\ntype Point struct{ X int }\n\nfunc (p Point) Dist() int { return p.X }\n\nfunc main() { p := Point{1} }\n", {"Point", "Dist", "main"}),
    ("A.java", "java", "public class App {\n  public App() {}\n  public int run() { return util(); }\n  static int util() { return 1; }\n}\ninterface Greeter { String hi(); }\n", {"App", "App.App", "App.run", "App.util", "Greeter"}),
    ("a.md", "markdown", "# Title\ntext\n## Section\n```\n# no\n```\n### Sub\n", {"Title", "Section", "Sub"}),
    ("a.yaml", "yaml", "name: x\nnested:\n  key: 1\n", {"name", "nested", "nested.key"}),
    ("a.xml", "xml", "<profiles>\n<profile>\n<id>with-frontend-build</id>\n</profile>\n</profiles>", {"profiles", "profiles.profile#with-frontend-build", "profiles.profile#with-frontend-build.id"}),
    ("a.html", "html", '<main id="shell"><div><p>x</p></div><div id="d"></div></main>', {"main#shell", "main#shell.div#d"}),
    ("a.swift", "swift", "struct S {\n  init() {}\n  subscript(i: Int) -> Int { 1 }\n}\nclass C {\n  deinit {}\n}\nextension S {\n  func f() {}\n}\n", {"S", "S.init", "S.subscript", "C", "C.deinit", "S.f"}),
    ("a.rb", "ruby", "class A\n  def m\n    1\n  end\nend\n", {"A", "A.m"}),
    ("a.sql", "sql", "CREATE TABLE t (a int);\ncreate or replace view v as select 1;\n", {"t", "v"}),
]


def test_extraction(spark):
    files = spark.createDataFrame([s[:3] for s in SOURCES], "path string, lang string, text string")
    got = {}
    for r in extract.symbols(files).collect():
        got.setdefault(r.path, {})[r.qualified] = r
    for path, lang, _, wanted in SOURCES:
        names = set(got.get(path, {}))
        assert names == wanted if lang != "rust" else names >= wanted, (path, names)
    assert got["a.py"]["A.m"].start_line == 2 and got["a.py"]["A.m"].parent == "A" and got["a.ts"]["C.onClick"].kind == "method" and got["a.ts"]["nested.inner"].kind == "fn"
    assert all("<" not in q for q in got["a.rs"])
    broken = spark.createDataFrame([("ok.py", "python", "x = 1\n"), ("bad.py", "python", "def broken(:\n")], "path string, lang string, text string")
    assert [(r.path, r.lines) for r in extract.syntax_errors(broken).collect()] == [("bad.py", [1])]


def test_identifiers_skip_strings_and_comments(spark):
    files = spark.createDataFrame([("a.rs", "rust", "// target\nlet s = \"target\";\n/* target\n*/\ntarget(1, f(2)); m::g(); h!(); x.close; y.close()\n")], "path string, lang string, text string")
    rows = extract.idents(files).collect()
    assert {r.ln for r in rows if r.name == "target"} == {5} and [r.argc for r in rows if r.name == "target"] == [2]
    assert [(r.is_call) for r in rows if r.name == "close"] == [False, True]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src/low.py").write_text("def low(x):\n    return x\n")
    (root / "src/mid.py").write_text("from low import low\n\n\ndef mid():\n    return low(1)\n")
    (root / "src/test_mid.py").write_text("def test_mid():\n    mid()\n")
    (root / "node_modules/x.js").write_text("function no() {}\n")
    (root / "yarn.lock").write_text("x")
    (root / "bad.py").write_bytes(b"\xff\xfe\x00")
    return str(root)


def test_index_of_a_tree(spark, repo):
    scanned = index.scan(spark, repo)
    files = index.texts(scanned).cache()
    assert sorted(r.path for r in files.collect()) == ["src/low.py", "src/mid.py", "src/test_mid.py"]
    s, i = extract.symbols(files), extract.idents(files)
    got = {(r.section, r.name) for r in composite.context(files, s, i, "mid").collect()}
    assert got == {("symbol", "mid"), ("calls", "low"), ("called_by", "test_mid")}
    assert {r.name for r in composite.context(files, s, i, "mid", no_tests=True).collect()} == {"mid", "low"}
    assert composite.bodies(files, composite.locate(s, "low")).first().code == "def low(x):\n    return x"
    fan = {r.qualified: r.fan_in for r in ranking.fan_in(s, i).collect()}
    assert fan == {"low": 3, "mid": 1, "test_mid": 0}
    assert {r.path for r in composite.orientation(s, i).collect()} == {"src/low.py", "src/mid.py", "src/test_mid.py"}
    changed = index.changed(scanned, scanned.withColumn("size", F.col("size") + (F.col("path") == "src/low.py").cast("int")))
    assert [(r.path, r.is_new) for r in changed.collect()] == [("src/low.py", False)]


def test_rename(spark, repo):
    files = index.texts(index.scan(spark, repo))
    plan = editing.rename_plan(files, "low", "base")
    assert {r.path: r.hits for r in plan.collect()} == {"src/low.py": 1, "src/mid.py": 3}
    assert editing.write_all(repo, plan) == 2 and "from base import base" in open(f"{repo}/src/mid.py").read()
    with pytest.raises(ValueError):
        editing.inside(repo, "../x")
    with pytest.raises(ValueError):
        editing.rename_plan(files, "low", "1x")


def test_submodules_and_manifests(spark):
    body = ["[submodule]", " path = libs/a", "# path = no", "path = /etc", "path = C:\\x", "path = a/../b", "url = x"]
    assert [r.path for r in index.submodule_paths(spark.createDataFrame([(x,) for x in body], "value string")).collect()] == ["libs/a"]
    assert [r.name for r in index.crate_names(spark.createDataFrame([('name = "my-crate"',), ("named = 1",)], "value string")).collect()] == ["my_crate"]


def test_git_source(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src")
    run("commit", "-qm", "one")
    with open(f"{repo}/src/low.py", "a") as f:
        f.write("\n\ndef more():\n    pass\n")
    log = git.commits(spark, repo)
    assert log.count() == 1 and {r.path for r in history.churn(git.commit_files(log)).collect()} == {"src/low.py", "src/mid.py", "src/test_mid.py"}
    assert [(r.path, r.lo, r.hi) for r in git.hunks(spark, repo).collect()] == [("src/low.py", 3, 6)]
    assert "src/low.py" in {r.path for r in git.changed_paths(spark, repo).collect()}


def test_watch_follows_new_changed_and_deleted_files(spark, repo, tmp_path):
    table = str(tmp_path / "symbols")
    names = lambda: {(r.path, r.qualified) for r in watch.read(spark, table).collect()}
    assert watch.read(spark, table) is None and watch.refresh(spark, repo, table) == 4
    assert names() == {("src/low.py", "low"), ("src/mid.py", "mid"), ("src/test_mid.py", "test_mid")}
    assert watch.refresh(spark, repo, table) == 0
    os.remove(f"{repo}/src/low.py")
    with open(f"{repo}/src/new.py", "w") as f:
        f.write("def fresh():\n    pass\n")
    with open(f"{repo}/src/mid.py", "w") as f:
        f.write("def renamed(a, b):\n    return 1\n")
    watch.watch(spark, repo, table, str(tmp_path / "point"), once=True)
    assert names() == {("src/new.py", "fresh"), ("src/mid.py", "renamed"), ("src/test_mid.py", "test_mid")}
    # A crash before the rename leaves the old table; another writer waits.
    other = index.Lock(spark, f"{table}/LOCK")
    assert other.acquire() and watch.refresh(spark, repo, table) == 0
    os.remove(f"{repo}/src/new.py")
    other.release()
    assert watch.refresh(spark, repo, table) == 1 and ("src/new.py", "fresh") not in names()
    q = watch.watch(spark, repo, table, str(tmp_path / "point"), every="200 milliseconds")
    with open(f"{repo}/src/late.py", "w") as f:
        f.write("def late():\n    pass\n")
    for _ in range(120):
        if ("src/late.py", "late") in names():
            break
        time.sleep(0.5)
    q.stop()
    assert ("src/late.py", "late") in names()


def test_lock_is_taken_over_when_stale(spark, tmp_path):
    path = str(tmp_path / "l" / "LOCK")
    a, b = index.Lock(spark, path), index.Lock(spark, path)
    assert a.acquire() and not b.acquire()
    assert index.Lock(spark, path, stale=0).acquire()


def test_freshness_and_single_files(spark, repo):
    disk = index.scan(spark, repo)
    known = spark.createDataFrame(disk.select("path", "size", "mtime_ns").collect(), "path string, size long, mtime_ns long")
    rows = spark.createDataFrame(extract.symbols(index.texts(disk)).collect(), extract.symbols(index.texts(disk)).schema)
    with open(f"{repo}/src/mid.py", "w") as f:
        f.write("def other():\n    return 12345\n")
    os.remove(f"{repo}/src/low.py")
    paths = spark.createDataFrame([("src/mid.py",), ("src/mid.py",), ("src/low.py",), ("src/test_mid.py",), ("none.py",)], "path string")
    assert {r.path: r.stale for r in index.freshness(paths, index.scan(spark, repo), known).collect()} == {"src/mid.py": True, "src/low.py": True, "src/test_mid.py": False, "none.py": True}
    assert index.stale_count(index.scan(spark, repo), known).first().stale == 2
    new = index.reindex(rows, index.texts(index.scan(spark, repo)), spark.createDataFrame([("src/mid.py",), ("src/low.py",)], "path string"), extract.symbols)
    assert {(r.path, r.qualified) for r in new.collect()} == {("src/mid.py", "other"), ("src/test_mid.py", "test_mid")}
    assert index.open_index(spark, f"{repo}/nowhere", f"{repo}/neither") is None


def test_ignore_rules_match_git(spark, repo):
    os.makedirs(f"{repo}/src/gen/deep", exist_ok=True)
    os.makedirs(f"{repo}/a/x", exist_ok=True)
    for p in ("src/gen/a.py", "src/gen/deep/b.py", "src/keep_me.py", "src/skip_1.py", "src/skip_2.py", "a/x/c.py", "a/d.py", "a/log.py", "top.py", "a/top.py"):
        with open(f"{repo}/{p}", "w") as f:
            f.write("x = 1\n")
    with open(f"{repo}/.gitignore", "w") as f:
        f.write("# comment\nskip_*.py\n!skip_2.py\n/top.py\nsrc/gen/\n\n**/x/*.py\n")
    with open(f"{repo}/a/.gitignore", "w") as f:
        f.write("log.py\n/d.p?\n")
    subprocess.run(["git", "-C", repo, "init", "-q"], check=True)
    listed = subprocess.run(["git", "-C", repo, "ls-files", "--others", "--exclude-standard"], check=True, capture_output=True, text=True).stdout.split()
    got = {r.path for r in index.scan(spark, repo, rules=index.rules_of(repo)).collect()}
    assert got == {p for p in listed if p.endswith(".py")} and "src/skip_2.py" in got and "src/gen/deep/b.py" not in got


def test_grep_anchors_and_foreign_classes(spark):
    files = spark.createDataFrame([("a", "first\nsecond 5 \n ;;y\nthird"), ("b", "äö\nzz")], "path string, text string")
    find = lambda p, **k: {(r.path, r.ln) for r in search.grep(files, p, regex=True, **k).collect()}
    assert find(r"\Asecond") == {("a", 2)} and find(r"^\p{L}+$") == {("a", 1), ("a", 4), ("b", 1), ("b", 2)} and find(r"third\z") == {("a", 4)}
    assert find(r"[0-9]\W*+$") == {("a", 2)} and find(r"\h") == {("a", 2), ("a", 3)}
    with pytest.raises(ValueError):
        search.grep(files, "(?=x)", regex=True)
    assert [r.path for r in search.grep(files, "q", include=spark.createDataFrame([("dep", "q")], "path string, text string")).collect()] == ["dep"]


def test_locate_and_ambiguity(spark):
    s = symbols(spark, [("src/a.py", "run", 1, 2), ("b/src/a.py", "run", 1, 2), ("c.py", "A.run", 5, 9)])
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(composite.locate(s, "run")) == ["b/src/a.py", "src/a.py"] and paths(composite.locate(s, "src/a.py:run")) == ["src/a.py"]
    assert paths(composite.locate(s, "A.run")) == ["c.py"] and paths(composite.locate(s, "x.py:run")) == [] and paths(composite.locate(s, "run", kind="class")) == []
    said = composite.ambiguity(composite.locate(s, "run"))
    assert "src/a.py:1" in said and "file:Name" in said and "Parent.Name" not in said and composite.ambiguity(composite.locate(s, "A.run")) is None


def test_call_trees(spark):
    s = symbols(spark, [("m.rs", "low", 1, 3), ("m.rs", "mid", 5, 7), ("m.rs", "high", 9, 12), ("o.rs", "other", 1, 2), ("p.rs", "low", 1, 2)])
    calls = [("m.rs", "low", 1, False, None), ("m.rs", "low", 6, True, 0), ("m.rs", "mid", 10, True, 0), ("m.rs", "low", 11, True, 0), ("o.rs", "other", 1, False, None), ("o.rs", "x", 9, True, 0)]
    idents = spark.createDataFrame(calls, "path string, name string, ln int, is_call boolean, argc int")
    edges = calls_.build(idents, s)
    got = {(r.caller, r.callee, r.callee_path, r.ln, r.ambiguous) for r in edges.collect()}
    assert got == {("mid", "low", "m.rs", 6, False), ("high", "mid", "m.rs", 10, False), ("high", "low", "m.rs", 11, False)}
    down = {(r.depth, r.symbol, r.parent) for r in calls_.tree(edges, "high", "m.rs", 3).collect()}
    assert down == {(1, "mid", "high"), (1, "low", "high")}
    up = [(r.depth, r.symbol, r.parent) for r in calls_.tree(edges, "low", "m.rs", 3, up=True).collect()]
    assert sorted(up) == [(1, "high", "low"), (1, "mid", "low")]
    assert calls_.tree(edges, "high", "m.rs", 3, nodes=1).count() == 1 and calls_.tree(edges, "high", "m.rs", 3, children=1).count() == 2
    assert calls_.tree(edges, "other", "o.rs", 2).count() == 0


def test_resolver_narrows_calls_with_one_match(spark):
    c = spark.createDataFrame([(1, "f", "a", 3), (1, "f", "b", 9), (2, "g", "a", 1), (2, "g", "b", 1)], "call_id int, name string, file string, start_line int")
    r = spark.createDataFrame([(1, "f", "b", 9), (2, "g", "a", 1), (2, "g", "b", 1)], "call_id int, name string, file string, line int")
    assert sorted((x.call_id, x.file) for x in calls_.resolver_matches(c, r).collect()) == [(1, "b"), (2, "a"), (2, "b")]


def test_registry_notes_and_settings(spark):
    projects = spark.createDataFrame([("h1", "/home/x", 3, 9, 5), ("h2", "/tmp/gone", 1, 2, 9), ("h3", "/home/gone", 1, 1, 1)], "hash string, path string, files long, symbols long, last_indexed long")
    log = spark.createDataFrame([(4, 1, "/tmp/gone", "find", 1, 1, 10, 5, "d")], "id long, ts long, project string, cmd string, ms long, results long, tokens_out long, tokens_saved long, detail string")
    assert tuple(registry.totals(projects).first()) == (3, 5, 12) and tuple(registry.totals(projects.limit(0)).first()) == (0, 0, 0)
    assert [r.hash for r in registry.listing(projects).collect()] == ["h2", "h1", "h3"] and [r.path for r in registry.paths(projects).collect()] == ["/home/gone", "/home/x", "/tmp/gone"]
    here = spark.createDataFrame([("/home/x",)], "path string")
    assert [r.hash for r in registry.orphans(projects, here).collect()] == ["h2"] and registry.orphans(projects, here, purge=True).count() == 2
    notes = spark.createDataFrame([], "id long, symbol string, note string, ts long")
    notes = registry.note_add(registry.note_add(notes, "Foo.bar", "one", 7), "bar", "two", 8)
    assert [r.id for r in registry.notes_all(notes).collect()] == [1, 2] and registry.note_remove(notes, [1]).count() == 1
    asked = spark.createDataFrame([("X.bar",), ("Foo.bar",), ("baz",)], "symbol string")
    assert sorted((r.symbol, r.id) for r in registry.notes_for(asked, notes).collect()) == [("Foo.bar", 1), ("Foo.bar", 2), ("X.bar", 1), ("X.bar", 2)]
    owned = notes.withColumn("project", F.lit("/tmp/gone"))
    kept = registry.forget(projects, log, owned, registry.orphans(projects, here), keep_stats=True)
    assert [x.count() for x in kept] == [2, 1, 0] and registry.forget(projects, log, owned, projects)[1].count() == 0
    meta = registry.meta_set(registry.meta_set(spark.createDataFrame([], "key string, value string"), "last_tidy", "1000"), "k", "v")
    assert registry.meta_get(meta, "k") == "v" and registry.meta_get(registry.meta_delete(meta, "k"), "k") is None
    assert registry.meta_get(registry.meta_set(meta, "k", "w"), "k") == "w"
    assert registry.tidy_due(meta, 1000 + 86_400) and not registry.tidy_due(meta, 1000 + 86_399) and registry.tidy_due(registry.meta_set(meta, "last_tidy", "x"), 90_000)
    more = registry.log(log, spark.createDataFrame([(2, "p", "grep", 1, 1, 5, -9, None)], "ts long, project string, cmd string, ms long, results long, tokens_out long, tokens_saved long, detail string"))
    assert [(r.id > 4, r.tokens_saved, r.detail) for r in more.where("ts = 2").collect()] == [(True, 0, "")]
    s = symbols(spark, [("a", "x", 1, 9), ("a", "y", 2, 4), ("b", "z", 1, 2)])
    assert tuple(registry.index_counts(projects, s).first()) == (3, 3) and registry.has_files(s) and not registry.has_files(s.limit(0))
    assert [(r.path, r.header) for r in registry.with_headers(s, ["ord"]).orderBy("ord").collect()] == [("a", True), ("a", False), ("b", True)]
    assert [r.qualified for r in registry.top_symbols(s, 2).collect()] == ["x", "y"]
    assert {r.path: r.width for r in registry.line_width(spark.createDataFrame([("a", 90), ("b", 10)], "path string, size long"), s).collect()} == {"a": 10, "b": 5}
    errors = spark.createDataFrame([("a", [1, 2]), ("b", [])], "path string, errors array<int>")
    assert tuple(registry.syntax_totals(errors).first()) == (2, 2)


def test_coupled_and_hot(spark):
    rows = [(h, "a", h, p, 1, 1, h) for h, ps in enumerate((["t", "x", "y"], ["t", "x"], ["t", "z"], ["x"])) for p in ps]
    cf = spark.createDataFrame(rows, "hash int, author string, ts int, path string, adds int, dels int, seq int")
    assert [(r.path, r.together, r.total) for r in history.coupled(cf, "t", 5).collect()] == [("x", 2, 3)]
    assert [r.path for r in history.hot(cf, spark.createDataFrame([("x",), ("z",)], "path string"), 5).collect()] == ["x", "z"]
    ranges = spark.createDataFrame([("a.rs",), ("b.unknown",)], "path string")
    assert [r.path for r in history.known_only(ranges).collect()] == ["a.rs"]


def test_grammar(spark):
    args = ["src/a.rs:Name", "plain", "a.b:c/d", "x:y", "C:\\a.rs:f", "a.rs:", "a.rs:b:c"]
    got = [tuple(r.l) for r in spark.createDataFrame([(a,) for a in args], "a string").select(grammar.locator(F.col("a")).alias("l")).collect()]
    assert got == [grammar.split_locator(a) for a in args]
    assert got[:4] == [("src/a.rs", "Name"), (None, "plain"), (None, "a.b:c/d"), (None, "x:y")] and got[6] == ("a.rs:b", "c")
    assert grammar.parse_range("42-48") == (42, 48) and grammar.parse_range(" 1 - 1") == (1, 1)
    for bad in ("0-3", "5-4", "x", "3", "-1-2"):
        with pytest.raises(ValueError):
            grammar.parse_range(bad)
    assert grammar.literal_of("plain.text") is None and grammar.literal_of("tokens_(out|saved)") == "tokens_" and grammar.literal_of("ab|cd") == "cd" and grammar.literal_of("^$") == ""
    hashed = spark.createDataFrame([("/x",), ("",), ("/ä",)], "p string").select(grammar.project_hash(F.col("p")).alias("h")).collect()

    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    assert [r.h for r in hashed] == ["07d64e07b49caeb2", fnv(b""), fnv("/ä".encode())]
    paths = ["/tmp/a", "/var/folders/x/y", "/home/tmp/a", "/scratch/z"]
    assert [r.e for r in spark.createDataFrame([(p,) for p in paths], "p string").select(grammar.is_ephemeral(F.col("p"), ("/scratch/",)).alias("e")).collect()] == [True, True, False, True]
    assert grammar.is_home_or_root("/") and grammar.is_home_or_root("/root", "/root") and not grammar.is_home_or_root("/root/repo", "/root")
    assert spark.range(1).select(grammar.like_escape(F.lit("a%b_c\\")).alias("x")).first().x == "a\\%b\\_c\\\\"


def test_hook_payloads_and_json(spark, tmp_path):
    lines = ['{"tool_name": "Read", "tool_input": {"file_path": "a.rs", "limit": 5}, "cwd": "/x", "session_id": "s"}', "{broken", "{}"]
    rows = hooks.payloads(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.valid for r in rows] == [True, False, False] and rows[0].tool_input.file_path == "a.rs" and rows[0].tool_input.limit == 5 and rows[0].session_id == "s"
    with open(tmp_path / "x.txt", "w") as f:
        f.write("\n".join(lines))
    q = hooks.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("payloads").trigger(once=True).start()
    assert q.awaitTermination(60) and spark.table("payloads").where("valid").count() == 1
    one = spark.createDataFrame([("a", 1)], "path string, ln int")
    assert hooks.json_lines(one).first().value == '{"path":"a","ln":1}' and hooks.structured(one, "refs").first().value == '{"refs":[{"path":"a","ln":1}]}'


def test_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(3)}", f"p{rng.randrange(6)}", k, rng.random() < 0.3, rng.random() < 0.5) for k in range(160)]
    rows = [(s, p, k, part, red and not part) for s, p, k, part, red in rows]
    schema = "session string, path string, seq long, partial boolean, redirect boolean"
    source = spark.createDataFrame(rows, schema)
    for part in (F.col("seq") < 80, F.col("seq") >= 80):  # two runs, so what the first leaves is the second's state
        source.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _, q = sessions.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "out"), once=True)
        assert q.awaitTermination(60)
    tracked = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(tracked) == len(rows)
    reads = {r.seq: (r.nth, r.reread, r["count"], r.fires) for r in tracked if not r.partial}
    log = spark.createDataFrame([r[:4] for r in rows if not r[3]], "session string, path string, seq long, partial boolean")
    assert reads == {r.seq: (r.nth, r.reread, r["count"], r.fires) for r in usage.streaks(log, 4).collect()}
    slices, denied, seen, counts = {}, set(), set(), {}
    for s, p, k, part, red in rows:
        if part:
            counts[s, p] = counts.get((s, p), 0) + 1
            slices[k] = (counts[s, p], counts[s, p] % 3 == 0)
        if red and (s, p) not in seen:
            seen.add((s, p))
            denied.add(k)
    assert {r.seq: (r.nth, r.fires) for r in tracked if r.partial} == slices and {r.seq for r in tracked if r.denied} == denied


def test_redirects_of_the_policy(spark):
    facts = [("a", False, True, True, True, 800, True), ("b", True, True, True, True, 800, True), ("c", False, True, True, True, 100, True)]
    df = spark.createDataFrame(facts, "path string, partial boolean, is_code boolean, indexed boolean, in_repo boolean, lines int, callable boolean")
    assert {r.path: r.redirect for r in sessions.with_redirect(df).collect()} == {"a": True, "b": False, "c": False}
