"""Import extraction and resolution."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import imports

EXTRACT = [
    ("rust", "use ä::{b, c};\n", ["ä::b", "ä::c"]),
    ("rust", "use ä::{b::{c}};", ["ä::b::c"]),
    ("rust", "use a::{b::{c, d}, e, f as g, self};\n", ["a::b::c", "a::b::d", "a::e", "a::f", "a"]),
    ("rust", "use weft::{\n    heddle,\n    reed, shed,\n};\nuse crate::warp::{beam, comb};\n", ["weft::heddle", "weft::reed", "weft::shed", "weft", "crate::warp::beam", "crate::warp::comb"]),
    ("rust", "  pub use x::y as z;\nmod sub;\npub mod other ;\nmod inline { use q::r; }\nuse open::end", ["x::y", "mod:sub", "mod:other", "mod:inline { use q::r"]),
    ("rust", "use {a, b::c};\nuse std::io::*;", ["a", "b::c", "std::io::*"]),
    ("python", "from loom.yarn import x\nimport os, loom.knot.ply as m\n  from . import y\nfrom ..a import b\nimportant = 1\n", ["loom.yarn", "os", "loom.knot.ply", ".", "..a"]),
    ("typescript", "import { x } from './loom/thread'\nconst y = require('./loom')\nimport \"./dye\"\nconst z = await import(\"q/r\")\nfrom 'open\n", ["./loom/thread", "./loom", "./dye", "q/r"]),
    ("rust", "", []),
]
RESOLVE = [
    ("rust", "weft::reed", "src/bin.rs", ["src/reed.rs", "src/bin.rs"], "src/reed.rs"),
    ("rust", "regex::Regex", "src/bin.rs", ["src/reed.rs", "src/bin.rs"], None),
    ("rust", "crate::reed::count_dents", "src/bin.rs", ["src/reed.rs", "src/shed.rs", "src/warp/mod.rs"], "src/reed.rs"),
    ("rust", "mod:warp", "src/bin.rs", ["src/reed.rs", "src/warp/mod.rs", "src/bin.rs"], "src/warp/mod.rs"),
    ("rust", "std::fmt::Write", "src/bin.rs", ["src/fmt.rs"], None),
    ("rust", "self::x::Y", "src/a/b.rs", ["src/a/x.rs", "src/x.rs"], "src/a/x.rs"),
    ("rust", "super::x", "src/a/b.rs", ["src/a/x.rs", "src/x.rs"], "src/x.rs"),
    ("rust", "super::super::x::y", "src/a/b/c.rs", ["src/x/y.rs", "x.rs", "src/x.rs"], "src/x/y.rs"),
    ("rust", "crate::a::b", "m.rs", ["p/a/b/mod.rs", "p/a.rs"], "p/a/b/mod.rs"),
    ("rust", "crate", "m.rs", ["m.rs"], None),
    ("python", "loom.yarn", "app.py", ["loom/yarn.py", "loom/knot/ply.py", "loom/__init__.py"], "loom/yarn.py"),
    ("python", ".yarn", "loom/knot/ply.py", ["loom/yarn.py", "loom/knot/ply.py"], None),
    ("python", "..yarn", "loom/knot/ply.py", ["loom/yarn.py", "loom/knot/ply.py"], "loom/yarn.py"),
    ("python", "loom.yarn.name", "app.py", ["loom/yarn.py", "z/loom/yarn.py"], "loom/yarn.py"),
    ("python", "sub", "main.py", ["sub/__init__.py"], None),
    ("python", "sub", "main.py", ["a/sub/__init__.py"], "a/sub/__init__.py"),
    ("typescript", "./loom/thread.js", "web/start.ts", ["web/loom/thread.ts", "web/loom/index.ts", "web/start.ts"], "web/loom/thread.ts"),
    ("typescript", "./loom", "web/start.ts", ["web/loom/thread.ts", "web/loom/index.ts", "web/start.ts"], "web/loom/index.ts"),
    ("typescript", "react", "web/start.ts", ["react.ts"], None),
    ("javascript", "../x", "a/b/c.js", ["a/x.js", "a/x.ts"], "a/x.ts"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(k, lang, text) for k, (lang, text, _) in enumerate(EXTRACT)], "k int, lang string, text string")
    got = {r.k: r.s for r in df.select("k", imports.extract(F.col("lang"), F.col("text")).alias("s")).collect()}
    assert [got[k] for k in range(len(EXTRACT))] == [w for *_, w in EXTRACT]


def test_resolution(spark):
    for k, (lang, spec, importer, files, wanted) in enumerate(RESOLVE):
        specs = spark.createDataFrame([(importer, lang, spec)], "importer string, lang string, spec string")
        got = imports.resolve(specs, spark.createDataFrame([(f,) for f in files], "path string"), ["weft"]).collect()
        assert [r.path for r in got] == ([wanted] if wanted else []), (k, spec)


@pytest.mark.parametrize("depth", [1, 30])
def test_deep_use_trees(spark, depth):
    text = "use " + "".join(f"a{k}::{{" for k in range(depth)) + "x" + "}" * depth + ";"
    (row,) = spark.createDataFrame([("rust", text)], "lang string, text string").select(imports.extract(F.col("lang"), F.col("text")).alias("s")).collect()
    assert row.s == ["::".join(f"a{k}" for k in range(depth)) + "::x"]
