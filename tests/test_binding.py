"""Name binding against a plain resolver that follows one reference at a time."""

import random

import pytest

from loomstone.operators import binding, calls

SYMBOL = "path string, name string, qualified string, parent string, start_line int"
IMPORT = "importer string, path string, names array<string>, alias string, line int"
TYPED = "path string, within string, name string, type array<string>, line int"
USE = "path string, ln int, within string, names array<string>"


def plain(uses, symbols, imports, typed):
    at = lambda p, q: f"{p}#{q}" if q else p
    bound, parent = {}, {}
    for p, n, q, up, line in symbols:
        bound.setdefault((at(p, up), n), []).append(("def", p, line, at(p, q), []))
        parent[at(p, q)] = at(p, up)
    for i, p, names, alias, line in imports:
        bound.setdefault((i, alias), []).append(("import", i, line, p, names) if names else ("def", p, 1, p, []))
    for p, w, n, t, line in typed:
        bound.setdefault((at(p, w), n), []).append(("typed", p, line, at(p, w), t))

    def look(scope, names, outwards, been):
        if (scope, tuple(names), outwards) in been or len(names) > 16:
            return set()
        been = been | {(scope, tuple(names), outwards)}
        at = scope
        while (at, names[0]) not in bound:
            if not outwards or at not in parent:
                return set()
            at = parent[at]
        out, rest = set(), names[1:]
        for kind, p, line, to, push in bound[at, names[0]]:
            if kind == "import":
                out |= look(to, push + rest, False, been)
            elif not rest:
                out.add((p, line))
            else:
                out |= look(to, push + rest, kind == "typed", been)
        return out

    return sorted({(p, ln, tuple(n), d, line) for p, ln, w, n in uses for d, line in look(at(p, w), n, True, frozenset()) if (d, line) != (p, ln)})


def run(spark, uses, symbols, imports, typed):
    make = spark.createDataFrame
    rows = binding.bind(make(uses, USE), make(symbols, SYMBOL), make(imports, IMPORT), make(typed, TYPED)).collect()
    return sorted((r.path, r.ln, tuple(r.names), r.def_path, r.def_line) for r in rows)


def test_rules(spark):
    symbols = [("a", "f", "f", None, 1), ("a", "T", "T", None, 3), ("a", "go", "T.go", "T", 4), ("b", "f", "f", None, 5), ("b", "g", "g", None, 9), ("b", "f", "g.f", "g", 10), ("c", "h", "h", None, 2), ("c", "h", "h", None, 7)]
    imports = [("b", "a", ["T"], "T", 1), ("c", "b", ["T"], "Q", 1), ("c", "a", [], "a", 2), ("d", "d", ["x"], "x", 1), ("e", "e", ["y", "y"], "y", 1)]
    typed = [("b", "g", "t", ["T"], 11), ("b", "g", "u", ["u"], 12)]
    uses = [
        ("b", 12, "g", ["f"]),  # the nearest scope wins
        ("b", 6, "f", ["f"]),
        ("b", 13, "g", ["t", "go"]),  # a typed name's member, through an import
        ("b", 13, "g", ["t"]),
        ("c", 3, "h", ["Q", "go"]),  # imported from where it is imported
        ("c", 4, None, ["a", "T", "go"]),
        ("c", 5, None, ["a"]),
        ("c", 6, None, ["h"]),  # two definitions of one name
        ("c", 2, None, ["h"]),  # but not that of the same line
        ("d", 3, None, ["x"]),  # an import of itself
        ("e", 3, None, ["y"]),  # one that grows
        ("b", 20, "g", ["u", "go"]),
        ("a", 9, None, ["T", "f"]),  # members don't look outwards
        ("zz", 1, None, ["f"]),
        ("a", 9, None, []),
    ]
    want = [
        ("b", 6, ("f",), "b", 5), ("b", 12, ("f",), "b", 10), ("b", 13, ("t",), "b", 11), ("b", 13, ("t", "go"), "a", 4), ("c", 2, ("h",), "c", 7), ("c", 3, ("Q", "go"), "a", 4),
        ("c", 4, ("a", "T", "go"), "a", 4), ("c", 5, ("a",), "a", 1), ("c", 6, ("h",), "c", 2), ("c", 6, ("h",), "c", 7),
    ]
    assert run(spark, uses, symbols, imports, typed) == sorted(want)
    assert [u for u in plain([u for u in uses if u[3]], symbols, imports, typed)] == sorted(want)
    assert run(spark, [], symbols, imports, typed) == [] and run(spark, uses, [], [], []) == []


def test_chains_of_imports_are_shortened(spark, monkeypatch):
    symbols = [("m40", "f", "f", None, 1)]
    imports = [(f"m{k}", f"m{k + 1}", ["f"], "f", 1) for k in range(40)] + [("x", "y", ["g"], "g", 1), ("y", "x", ["g"], "g", 1)]
    tags, call = [], binding.Steps.__call__
    monkeypatch.setattr(binding.Steps, "__call__", lambda self, df, tag="step": tags.append(tag) or call(self, df, tag))
    uses = [("m0", 5, None, ["f"]), ("m39", 5, None, ["f"]), ("x", 5, None, ["g"])]
    assert run(spark, uses, symbols, imports, []) == [("m0", 5, ("f",), "m40", 1), ("m39", 5, ("f",), "m40", 1)]
    assert sum(t.startswith("flight") for t in tags) <= 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_generated_modules(spark, seed):
    r = random.Random(seed)
    files, names = [f"m{k}" for k in range(6)], ["a", "b", "c", "d"]
    symbols, imports, typed, uses = [], [], [], []
    for f in files:
        scopes, line = [None], 0
        for _ in range(8):
            up, name, line = r.choice(scopes), r.choice(names), line + 2
            q = f"{up}.{name}" if up else name
            symbols.append((f, name, q, up, line))
            scopes.append(q)
        imports += [(f, r.choice(files), [r.choice(names) for _ in range(r.randint(0, 2))], r.choice(names), 50 + k) for k in range(2)]
        typed += [(f, r.choice(scopes), r.choice(["x", "y"]), [r.choice(names + ["x"]) for _ in range(r.randint(1, 2))], 60)]
        uses += [(f, r.randint(1, 20), r.choice(scopes), [r.choice(names + ["x", "y"]) for _ in range(r.randint(1, 3))]) for _ in range(30)]
    want = plain(uses, symbols, imports, typed)
    assert run(spark, uses, symbols, imports, typed) == want and len(want) > 20


def test_binding_settles_candidates(spark):
    symbols = [("a", "go", "go", None, 1), ("b", "go", "go", None, 1), ("c", "run", "run", None, 1)]
    make = spark.createDataFrame
    bound = binding.bind(make([("c", 2, "run", ["go"])], USE), make(symbols, SYMBOL), make([("c", "b", ["go"], "go", 1)], IMPORT))
    resolved = bound.selectExpr("concat(path, ':', ln) call_id", "element_at(names, -1) name", "def_path file", "def_line line")
    cands = make([("c:2", "go", "a", 1), ("c:2", "go", "b", 1), ("c:9", "go", "a", 1)], "call_id string, name string, file string, start_line int")
    assert sorted((x.call_id, x.file) for x in calls.resolver_matches(cands, resolved).collect()) == [("c:2", "b"), ("c:9", "a")]
