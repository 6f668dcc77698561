"""Import statements of source texts, and the files that they may name, as expressions.

``extract`` gives the specifiers of a text in order. ``candidates`` gives what each may resolve to as an array of
(prio, key, mode): mode 0 keys are whole paths, mode 1 keys are whole paths or ends of paths from a slash on,
mode 2 keys are such ends only. ``keys`` gives the keys by which files can be found, so resolution is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import dir_of, lines, normalize_path

# Script extensions in the order in which they are tried.
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
KEY = "array<struct<prio:int,key:string,mode:int>>"


def _empty() -> Column:
    return F.array().cast("array<string>")


def use_tree(spec: Column) -> Column:
    """Leaf paths of a use declaration: one pass over its names and signs with a stack of the groups' paths.

    ``self``, ``*`` and an empty place in a group stand for the group's path; "as" names are dropped.
    """
    signs = F.regexp_extract_all(spec, F.lit(r"[{},]|[^{},]+"), F.lit(0))
    start = F.expr("named_struct('stack', cast(array() as array<string>), 'name', '', 'done', false, 'out', cast(array() as array<string>))")
    bare = lambda c: F.regexp_replace(F.trim(c), r"(::)+$", "")

    def path(s: Column, name: Column) -> Column:
        top = F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), F.lit(""))
        return F.when(name == "", top).when(top == "", name).otherwise(F.concat(top, F.lit("::"), name))

    def leaf(s: Column) -> Column:
        raw = F.trim(s["name"])
        name = F.when(raw.isin("self", "*") & (F.size(s["stack"]) > 0), F.lit("")).otherwise(bare(F.split(raw, " as ")[0]))
        found = path(s, name)
        return F.when(s["done"] | (found == ""), s["out"]).otherwise(F.concat(s["out"], F.array(found)))

    def state(stack: Column, name: Column, done: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), name.alias("name"), done.alias("done"), out.alias("out"))

    def step(s: Column, sign: Column) -> Column:
        up = F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        over = (F.size(s["stack"]) == 0) & s["done"]  # what follows the outermost group doesn't count
        return (
            F.when(over, s)
            .when(sign == "{", state(F.concat(s["stack"], F.array(path(s, bare(s["name"])))), F.lit(""), F.lit(False), s["out"]))
            .when(sign == ",", state(s["stack"], F.lit(""), F.lit(False), leaf(s)))
            .when(sign == "}", state(up, F.lit(""), F.lit(True), leaf(s)))
            .otherwise(state(s["stack"], F.when(s["done"], s["name"]).otherwise(sign), s["done"], s["out"]))
        )

    return F.aggregate(signs, start, step, lambda s: F.when((F.size(s["stack"]) == 0) & s["done"], s["out"]).otherwise(leaf(s)))


def _rust(text: Column) -> Column:
    declared = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:pub )?(?:use [^;]*|mod [^;\n]*);"), F.lit(0))

    def each(s: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s*\n\s*", " ")), ";$", ""), r"^(pub )?", "")
        name = F.trim(F.substring(body, F.lit(5), F.length(body)))
        return F.when(body.startswith("use "), use_tree(name)).when(name != "", F.array(F.concat(F.lit("mod:"), name))).otherwise(_empty())

    return F.flatten(F.transform(declared, each))


def _python(text: Column) -> Column:
    def each(line: Column) -> Column:
        s = F.ltrim(line)
        modules = F.transform(F.split(F.substring(s, F.lit(8), F.length(s)), ","), lambda m: F.split(F.ltrim(m), r"\s")[0])
        source = F.trim(F.split(F.substring(s, F.lit(6), F.length(s)), " import")[0])
        return F.when(s.startswith("import "), F.filter(modules, lambda m: m != "")).when(s.startswith("from ") & (source != ""), F.array(source)).otherwise(_empty())

    return F.flatten(F.transform(lines(text), each))


def _script(text: Column) -> Column:
    openers = [rf"{word}{quote}([^{quote}]*){quote}" for word in ("from ", r"require\(", r"import\(") for quote in "\"'"]

    def each(line: Column) -> Column:
        found = [F.slice(F.regexp_extract_all(line, F.lit(p), F.lit(1)), 1, 1) for p in openers]
        bare = F.slice(F.regexp_extract_all(F.ltrim(line), F.lit("^import [\"']([^\"']*)[\"']"), F.lit(1)), 1, 1)
        return F.concat(*found, bare)

    return F.flatten(F.transform(lines(text), each))


def extract(lang: Column, text: Column) -> Column:
    """Import specifiers of a text in order; every language but rust and python is read as a script."""
    return F.when(lang == "rust", _rust(text)).when(lang == "python", _python(text)).otherwise(_script(text))


def _rows(keys: list[tuple[Column, int]], prio: Column) -> Column:
    return F.array(*[F.struct(prio.cast("int").alias("prio"), key.alias("key"), F.lit(mode).alias("mode")) for key, mode in keys])


def start(lang: Column, spec: Column, importer: Column) -> Column:
    """Where a specifier's relative path starts, normalised: a folder, or for scripts the path that is named.

    It is a column of its own, so that each of a specifier's candidates only puts strings together."""
    here = dir_of(importer)
    ups = F.size(F.split(F.regexp_extract(spec, r"^((?:\s*super\s*(?:::|$))*)", 1), "super")) - 1
    rust = F.when(spec.startswith("mod:"), here).otherwise(F.concat(here, F.repeat(F.lit("/.."), ups)))
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    python = F.concat(here, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    return normalize_path(F.when(lang == "rust", rust).when(lang == "python", python).otherwise(F.concat(here, F.lit("/"), spec)))


def _under(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def _rust_candidates(spec: Column, base: Column, own: list[str]) -> Column:
    parts = F.transform(F.split(spec, "::"), lambda s: F.trim(s))
    first = parts[0]
    whole = first.isin("crate", *own)
    # Of a path of names, all that is above the file is in the base.
    skip = F.when(first == "super", F.size(F.split(F.regexp_extract(spec, r"^((?:\s*super\s*(?:::|$))*)", 1), "super")) - 1).otherwise(F.lit(1))
    rest = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))

    def longest_first(take: Column) -> Column:
        name = F.array_join(F.slice(rest, F.lit(1), take), "/")
        file, folder = F.concat(name, F.lit(".rs")), F.concat(name, F.lit("/mod.rs"))
        prio = (F.size(rest) - take) * 2
        inside = F.concat(_rows([(_under(base, file), 0)], prio), _rows([(_under(base, folder), 0)], prio + 1))
        return F.when(whole, _rows([(file, 1), (folder, 2)], prio)).otherwise(inside)

    module = F.substring(spec, F.lit(5), F.length(spec))
    declared = F.concat(_rows([(_under(base, F.concat(module, F.lit(".rs"))), 0)], F.lit(0)), _rows([(_under(base, F.concat(module, F.lit("/mod.rs"))), 0)], F.lit(1)))
    used = F.when((whole | first.isin("self", "super")) & (F.size(rest) > 0), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1))), longest_first))).otherwise(F.array().cast(KEY))
    return F.when(spec.startswith("mod:"), declared).otherwise(used)


def _python_candidates(spec: Column, base: Column) -> Column:
    near = spec.startswith(".")
    name = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.+", "/")

    def of(j: Column, prio: int) -> Column:
        file, folder = F.concat(j, F.lit(".py")), F.concat(j, F.lit("/__init__.py"))
        inside = F.concat(_rows([(_under(base, file), 0)], F.lit(prio)), _rows([(_under(base, folder), 0)], F.lit(prio + 1)))
        return F.when(j == "", F.array().cast(KEY)).when(near, inside).otherwise(_rows([(file, 1), (folder, 2)], F.lit(prio)))

    return F.concat(of(name, 0), F.when(name.contains("/"), of(F.regexp_extract(name, "^(.*)/", 1), 2)).otherwise(F.array().cast(KEY)))


def _script_candidates(spec: Column, base: Column) -> Column:
    stem = F.regexp_replace(base, "(" + "|".join(e.replace(".", "\\.") for e in SCRIPTS) + ")$", "")
    named = F.transform(F.array(*map(F.lit, SCRIPTS)), lambda e: F.concat(stem, e))
    listed = F.transform(F.array(*map(F.lit, SCRIPTS)), lambda e: F.concat(base, F.lit("/index"), e))
    rows = F.transform(F.concat(F.array(base), named, listed), lambda key, k: F.struct(k.cast("int").alias("prio"), key.alias("key"), F.lit(0).alias("mode")))
    return F.when(spec.startswith("."), rows).otherwise(F.array().cast(KEY))


def candidates(lang: Column, spec: Column, base: Column, own: list[str] = ()) -> Column:
    """What a specifier with a given ``start`` may resolve to; empty for packages from outside. own are this project's package names."""
    return F.when(lang == "rust", _rust_candidates(spec, base, list(own))).when(lang == "python", _python_candidates(spec, base)).otherwise(_script_candidates(spec, base))


def keys(files: DataFrame) -> DataFrame:
    """(key, mode, path): one file for each key, the shortest and then smallest path that it fits."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("key"), (k > 1).alias("end")))
    each = files.select("path", F.explode(ends).alias("e"))
    modes = F.when(F.col("e.end"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = each.select("path", F.col("e.key").alias("key"), F.explode(modes).alias("mode"))
    return rows.groupBy("key", "mode").agg(F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("path")))["path"].alias("path"))


def resolve(specs: DataFrame, files: DataFrame, own: list[str] = ()) -> DataFrame:
    """(importer, spec, path) of specs (importer, lang, spec) that name one of the files (path): the first candidate that exists.

    Each key has one file, so the join adds no rows to the candidates, whatever many files end alike. Both sides are exploded
    from few columns, which their estimated sizes don't show, so neither is sent whole.
    """
    placed = specs.select("importer", "lang", "spec", start(F.col("lang"), F.col("spec"), F.col("importer")).alias("_start"))
    wanted = placed.select("importer", "spec", F.explode(candidates(F.col("lang"), F.col("spec"), F.col("_start"), own)).alias("c"))
    wanted = wanted.select("importer", "spec", F.col("c.prio").alias("prio"), F.col("c.key").alias("key"), F.col("c.mode").alias("mode"))
    hit = wanted.join(keys(files).hint("merge"), ["key", "mode"])
    return hit.groupBy("importer", "spec").agg(F.min(F.struct("prio", F.length("path").alias("n"), F.col("path").alias("path")))["path"].alias("path"))


def specs_of(files: DataFrame) -> DataFrame:
    """(importer, lang, spec) of files (path, lang, text)."""
    return files.select(F.col("path").alias("importer"), "lang", F.explode(extract(F.col("lang"), F.col("text"))).alias("spec"))
