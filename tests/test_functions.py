"""Column helpers against tables of cases."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import code, policy, shell, text
from loomstone.operators import editing, history, search


def each(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_lines(spark):
    assert each(spark, ["a\nb", "a\n", "", "a\r\nb\r\n", "\n", "a\n\nb"], text.lines) == [["a", "b"], ["a"], [], ["a", "b"], [""], ["a", "", "b"]]


@pytest.mark.parametrize("signature, params", [("fn a()", 0), ("fn b(x: i32)", 1), ("def c(self, y=(1, 2), z=[3, 4])", 3), ("const X", None), ("f(a: Vec<Map<K, V>>, b)", 2), ("h(  )", 0), ("f(x = \"a,b\", y)", 2), ("f(x, y) { g(1, 2) }", 2)])
def test_param_count(spark, signature, params):
    assert each(spark, [signature], text.param_count) == [params]


def test_receivers(spark):
    cases = {"fn a(&self)": True, "fn a(&mut self, x: T)": True, "def m(self, x)": True, "f(selfish)": False, "f(self: Box<Self>)": True, "f()": False, "nothing": False, "f(this, x)": True}
    assert each(spark, list(cases), text.first_param_is_receiver) == list(cases.values())


def test_names_and_paths(spark):
    assert each(spark, ["a.b.c", "a", ""], text.name_tail) == ["c", "a", ""]
    assert each(spark, ["a.b.c", "a"], text.scope_parent) == ["a.b", None]
    assert each(spark, ["a/b/c", "a"], text.dir_of) == ["a/b", ""]
    assert each(spark, ["a/b/../c", "../x", "./a//b/", "a/../../b"], text.normalize_path) == ["a/c", "x", "a/b", "b"]
    assert each(spark, ["let x2 = foo(bar, foo); baz_qux.method(42, 9abc)"], text.identifiers) == [["let", "x2", "foo", "bar", "foo", "baz_qux", "method"]]
    assert each(spark, ["a", "_b1", "1a", "", "a-b"], text.is_valid_ident) == [True, True, False, False, False]


def test_languages(spark):
    cases = {"a/b.rs": "rust", "x.py": "python", "Makefile": "make", "build.mk": "make", "Dockerfile.dev": "dockerfile", "web.dockerfile": "dockerfile", "a.tsx": "tsx", "notes.txt": None, "README": None, "x/y.go": "go"}
    assert each(spark, list(cases), code.detect_lang) == list(cases.values())
    paths = {"src/a.rs": True, "node_modules/x/a.js": False, "web/package-lock.json": False, "target/a.rs": False, "a.bin": False, "dist": False}
    assert each(spark, list(paths), code.is_indexed_path) == list(paths.values())


def test_test_paths_and_symbols(spark):
    paths = {"src/tests/a.rs": True, "tests": True, "src/test_a.py": True, "a.test.ts": True, "a.spec.js": True, "pkg/x_test.go": True, "src/contest.rs": False, "latest/a.py": False, "Spec/a.rb": True}
    assert each(spark, list(paths), code.is_test_path) == list(paths.values())
    assert each(spark, ["tests.a", "A.test_x", "m.x_test", "attest"], code.is_test_symbol) == [True, True, True, False]


def test_external_names(spark):
    cases = [("rust", "serde::de", "serde"), ("rust", "crate::x", None), ("rust", "mod:y", None), ("rust", "mine::x", None), ("python", "numpy.linalg", "numpy"), ("python", ".x", None), ("tsx", "@a/b/c", "@a/b"), ("tsx", "./x", None), ("tsx", "react/jsx", "react"), ("tsx", "@a", None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, lang string, spec string, want string")
    got = rows.orderBy("i").select(code.external_name(F.col("lang"), F.col("spec"), ["mine"]), "want").collect()
    assert all(a == b for a, b in got)


def test_path_filters(spark):
    paths = ["src", "src/a.rs", "srcx/a.rs", "lib/src/a.rs"]
    assert each(spark, paths, lambda p: code.path_filter(p, "src", is_dir=True)) == [True, True, False, False]
    assert each(spark, paths, lambda p: code.path_filter(p, "src")) == [True, True, True, False]
    assert each(spark, paths, lambda p: code.path_filter(p, "src/")) == [True, True, False, False]
    assert each(spark, paths, lambda p: code.file_match(p, "A.RS")) == [False, True, True, True]


def test_fuzzy_scores(spark):
    got = each(spark, ["login", "UserLogin", "lxoxgin", "nope", ""], lambda c: search.fuzzy_score("LOGIN", c))
    assert got == [1000, 1000 - 4 * 4 - 4, 500 - 2 * 2, None, None]


def test_humanised(spark):
    assert each(spark, [0, 1023, 1536, 5 * 1024**2, 3 * 1024**3], text.human_bytes, "long") == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert each(spark, [-3, 4, 59, 3599, 86399, 200000], text.ago, "long") == ["just now", "just now", "59s ago", "59m ago", "23h ago", "2d ago"]


def test_halves_go_to_even(spark):
    ties = [1280, 1792, 1022 * 1024**2 + 2**18, 2**18 * 7, 1024**3 + 2**28, -1]
    assert each(spark, ties, text.human_bytes, "long") == ["1.2 KB", "1.8 KB", "1022.2 MB", "1.8 MB", "1.2 GB", "-1 B"]


READ = {
    "base": ({}, "redirect"), "reread": ({"reread": True}, "redirect"), "prose": ({"callable_": False}, "redirect"), "partial": ({"partial": True, "reread": True}, "allow"), "not code": ({"is_code": False}, "allow"),
    "short": ({"lines": 42}, "allow"), "119": ({"lines": 119}, "allow"), "120": ({"lines": 120}, "advise"), "300": ({"lines": 300}, "advise"), "short reread": ({"lines": 12, "reread": True}, "advise"), "unindexed": ({"indexed": False}, "nudge"),
    "loose": ({"indexed": False, "in_repo": False}, "allow"), "mid unindexed": ({"lines": 216, "indexed": False}, "allow"), "mid prose": ({"lines": 216, "callable_": False}, "allow"),
}


@pytest.mark.parametrize("name", READ)
def test_read_policy(spark, name):
    changes, wanted = READ[name]
    facts = {"partial": False, "is_code": True, "indexed": True, "in_repo": True, "lines": 800, "callable_": True, "reread": False} | changes
    assert spark.range(1).select(policy.decide_read(**{k: F.lit(v) for k, v in facts.items()})).first()[0] == wanted


def test_grep_policy(spark):
    base = {"surgical": False, "single_file": False, "identifier": True, "indexed": True, "in_repo": True, "soft": False}
    cases = [({}, "redirect"), ({"soft": True}, "advise"), ({"single_file": True}, "advise"), ({"surgical": True}, "allow"), ({"identifier": False}, "allow"), ({"indexed": False}, "nudge"), ({"indexed": False, "single_file": True}, "allow"), ({"indexed": False, "in_repo": False}, "allow")]
    for changes, wanted in cases:
        assert spark.range(1).select(policy.decide_grep(**{k: F.lit(v) for k, v in (base | changes).items()})).first()[0] == wanted


SHELL = [
    ("cat src/main.rs", ("read", "src/main.rs", None, None, None)),
    ("/bin/cat src/main.rs", ("read", "src/main.rs", None, None, None)),
    ("sed -n '1,$p' a.rs", ("read", "a.rs", None, None, None)),
    ("sed -n '1,240p' main.rs", ("read", "main.rs", 240, None, None)),
    ("sed -n '10,20p' a.rs", ("partial", "a.rs", None, None, None)),
    ("head -n 40 a.rs", ("partial", "a.rs", None, None, None)),
    ("wc -l a.rs", ("partial", None, None, None, None)),
    ('/bin/zsh -lc "wc -l big.rs && cat big.rs"', ("read", "big.rs", None, None, None)),
    ("cat a.rs && cargo build", ("other",) + (None,) * 4),
    ("cat a.rs > b.rs", ("other",) + (None,) * 4),
    ("cat $(ls)", ("other",) + (None,) * 4),
    ("cat 'oops", ("other",) + (None,) * 4),
    ("LC_ALL=C grep -rn UserService src", ("grep", "src", None, "UserService", False)),
    ("rg UserService", ("grep", None, None, "UserService", False)),
    ("rg -C 3 UserService", ("grep", None, None, "UserService", True)),
    ("rg -C x UserService", ("other",) + (None,) * 4),
    ("grep -A5 Foo src", ("grep", "src", None, "Foo", True)),
    ("rg -g '*.rs' Foo", ("other",) + (None,) * 4),
    ("sed -i 's/a/b/' f", ("other",) + (None,) * 4),
]


def test_shell_lines(spark):
    got = each(spark, [c for c, _ in SHELL], shell.shell_intent)
    assert [tuple(g) for g in got] == [w for _, w in SHELL]
    assert shell.segments("a; b | c || d") == ["a", "b", "c", "d"] and shell.segments("grep 'a;b' src") == ["grep 'a;b' src"]
    assert shell.unwrapped("bash -c 'cat a.rs'") == "cat a.rs" and shell.unwrapped("cat a.rs") is None


def test_renames(spark):
    cases = {"src/{old => new}.rs": "src/new.rs", "a => b": "b", "a/{ => x}/b": "a/x/b", "a/{x => }/b": "a/b", "plain": "plain"}
    assert each(spark, list(cases), history.normalize_rename) == list(cases.values())


def test_splices(spark):
    s = lambda t, a, b, n: spark.createDataFrame([(t, n)], "t string, n string").select(editing.splice_lines(F.col("t"), F.lit(a), F.lit(b), F.col("n"))).first()[0]
    assert s("a\nb\nc\n", 2, 2, "X\nY\n") == "a\nX\nY\nc\n"
    assert s("a\nb\nc", 3, 9, "X") == "a\nb\nX"
    assert s("a\r\nb\r\n", 1, 1, "X\r\nY") == "X\r\nY\r\nb\r\n"
    i = lambda t, at, n: spark.createDataFrame([(t, n)], "t string, n string").select(editing.splice_insert(F.col("t"), F.lit(at), F.col("n"))).first()[0]
    assert i("a\nb\n", 1, "X\n") == "a\nX\nb\n" and i("a", 0, "X") == "X\na" and i("a\n", 99, "X") == "a\nX\n"
