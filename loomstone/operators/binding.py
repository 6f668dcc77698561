"""Name binding: definitions that references reach through scopes, imports and types, by stitching partial paths.

A scope is a place where names are bound: the root, a file, or the inside of a symbol. Two tables say how a path goes on:

- ``bindings`` (scope, name, kind, path, line, to, push): in a scope, a name is a definition at (path, line), whose own scope is
  ``to`` (null if it has none), or stands for the names ``push``, looked up from scope ``to``: an ``import`` there alone, a
  ``typed`` name's members from its own scope outwards.
- ``parents`` (scope, parent): a scope and the one around it.

A reference (ref, scope, names) is a stack of names. A step pops the first one: it is looked up in its scope and those
around it, the nearest scope that binds it alone; the remaining names are looked up in what it leads to, and there only, as members. What
is in flight is a table of distinct (scope, stack) pairs, whatever number of references share them, joined with the bindings on
(scope, top of the stack) at each step; so a common name meets one row for each pair, not for each use. Pairs that came up
before are dropped, so loops of imports end (chains of imports are shortened first), and stacks beyond ``longest`` names as well, which only a growing loop has.

All tables here grow with the tree, and their columns compress well, so their files look smaller than they are: joins are by merging
and send none whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..plans.shared import Steps

ROOT = "/"


def ancestors(parents: DataFrame, step: Steps) -> DataFrame:
    """(scope, around, depth): every scope with itself and all around it, by doubling: log of the nesting depth joins."""
    self_ = parents.select("scope").union(parents.select("parent")).distinct().select("scope", F.col("scope").alias("around"), F.lit(0).alias("depth"))
    hop = parents.select("scope", F.col("parent").alias("around"), F.lit(1).alias("depth")).distinct()
    all_, jump = self_.unionByName(hop), hop
    while True:
        far = jump.select(F.col("scope").alias("around"), F.col("around").alias("beyond"), F.col("depth").alias("more"))
        all_ = step(all_.unionByName(all_.join(far.hint("merge"), "around").select("scope", F.col("beyond").alias("around"), (F.col("depth") + F.col("more")).alias("depth"))).distinct(), "around")
        jump = step(jump.join(far.hint("merge"), "around").select("scope", F.col("beyond").alias("around"), (F.col("depth") + F.col("more")).alias("depth")), "jump")
        if jump.isEmpty():
            return all_


def shortened(bindings: DataFrame, step: Steps, rounds: int = 6) -> DataFrame:
    """bindings whose imports lead past other imports, where these are a name's only binding, by doubling: a chain of 2^k of them takes k joins.

    What remains of longer chains, and of loops, is left to the stitching."""
    one = bindings.groupBy("scope", "name").agg(F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("to").alias("to"), F.first("push").alias("push"))
    one = step(one.where("n = 1 and kind = 'import' and size(push) = 1").select("scope", "name", "to", F.element_at("push", 1).alias("next")), "imports")
    for _ in range(rounds):
        after = one.select(F.col("scope").alias("to"), F.col("name").alias("next"), F.col("to").alias("_to"), F.col("next").alias("_next"))
        far = step(one.join(after.hint("merge"), ["to", "next"], "left"), "jump")
        if far.where("_to is not null and not (_to = to and _next = next)").isEmpty():
            break
        one = far.select("scope", "name", F.coalesce("_to", "to").alias("to"), F.coalesce("_next", "next").alias("next"))
    ends = one.select(F.col("scope").alias("to"), F.col("name").alias("_name"), F.col("to").alias("_to"), F.col("next").alias("_next"))
    single = (F.col("kind") == "import") & (F.size("push") == 1)
    out = bindings.withColumn("_name", F.when(single, F.element_at("push", 1))).join(ends.hint("merge"), ["to", "_name"], "left")
    push = F.when(F.col("_next").isNotNull(), F.array("_next")).otherwise(F.col("push"))
    return step(out.select("scope", "name", "kind", "path", "line", F.coalesce("_to", "to").alias("to"), push.alias("push")), "bindings")


def stitch(refs: DataFrame, bindings: DataFrame, parents: DataFrame, longest: int = 16) -> DataFrame:
    """(ref, path, line): the definitions that each reference (ref, scope, names) reaches, all of them, each once."""
    step = Steps(refs.sparkSession)
    around = ancestors(parents, step)
    starts = refs.where("scope is not null and size(names) > 0").select("scope", "names").distinct()
    bound = shortened(bindings, step).select(F.col("scope").alias("around"), F.col("name").alias("top"), "kind", "path", "line", "to", "push")
    # (first scope, first names, scope now, names left, whether scopes around it count)
    flight = step(starts.select(F.col("scope").alias("s0"), F.col("names").alias("n0"), "scope", "names", F.lit(True).alias("outwards")), "flight")
    seen, found, n = flight, [], 0
    while not flight.isEmpty():
        out = flight.where("outwards").join(around.hint("merge"), "scope")
        own = flight.where("not outwards").withColumn("around", F.col("scope")).withColumn("depth", F.lit(0))
        here = out.unionByName(own.select(*out.columns)).withColumn("top", F.element_at("names", 1)).join(bound.hint("merge"), ["around", "top"])
        nearest = Window.partitionBy("s0", "n0", "scope", "names", "outwards").orderBy("depth")
        here = here.withColumn("_r", F.rank().over(nearest)).where("_r = 1").withColumn("rest", F.slice("names", 2, F.size("names")))
        here = step(here.select("s0", "n0", "around", "kind", "path", "line", "to", "push", "rest"), f"step{n}")
        found.append(here.where("kind = 'def' and size(rest) = 0").select("s0", "n0", "path", "line"))
        inner = here.where("kind = 'def' and size(rest) > 0 and to is not null").select("s0", "n0", F.col("to").alias("scope"), F.col("rest").alias("names"), F.lit(False).alias("outwards"))
        named = here.where("kind = 'import' or kind = 'typed' and size(rest) > 0").select("s0", "n0", F.col("to").alias("scope"), F.concat("push", "rest").alias("names"), (F.col("kind") == "typed").alias("outwards"))
        # A typed name without members is itself the definition.
        found.append(here.where("kind = 'typed' and size(rest) = 0").select("s0", "n0", "path", "line"))
        new = inner.unionByName(named).where(F.size("names") <= longest).distinct()
        flight = step(new.join(seen.hint("merge"), ["s0", "n0", "scope", "names", "outwards"], "left_anti"), f"flight{n}")
        seen, n = seen.unionByName(flight), n + 1
    if not found:
        return refs.sparkSession.createDataFrame([], refs.select("ref").schema.add("path", StringType()).add("line", IntegerType()))
    reached = found[0]
    for more in found[1:]:
        reached = reached.unionByName(more)
    return refs.join(reached.distinct().hint("merge"), (F.col("scope") == F.col("s0")) & (F.col("names") == F.col("n0"))).select("ref", "path", "line").distinct()


def scope_graph(symbols: DataFrame, imports: DataFrame, typed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bindings, parents) of symbols (path, name, qualified, parent, start_line), imports (importer, path, names, alias, line) of ``names``
    out of a file under the name ``alias``, and ``typed`` names (path, within, name, type array<string>, line).

    A file's scope is its path, a symbol's is path#qualified. A name of a file's scope is bound to nothing outside of it but by imports;
    an import without names binds the file itself.
    """
    of = lambda p, q: F.when(q.isNull() | (q == ""), p).otherwise(F.concat_ws("#", p, q))
    scope = of(F.col("path"), F.col("parent"))
    defs = symbols.select(scope.alias("scope"), "name", F.lit("def").alias("kind"), "path", F.col("start_line").cast("int").alias("line"), of(F.col("path"), F.col("qualified")).alias("to"), F.array().cast("array<string>").alias("push"))
    taken = imports.select(F.col("importer").alias("scope"), F.col("alias").alias("name"), F.when(F.size("names") > 0, "import").otherwise("def").alias("kind"), F.when(F.size("names") > 0, F.col("importer")).otherwise(F.col("path")).alias("path"), F.when(F.size("names") > 0, F.col("line")).otherwise(F.lit(1)).cast("int").alias("line"), F.col("path").alias("to"), F.col("names").alias("push"))
    bindings = defs.unionByName(taken)
    if typed is not None:
        within = of(F.col("path"), F.col("within"))
        bindings = bindings.unionByName(typed.select(within.alias("scope"), "name", F.lit("typed").alias("kind"), "path", F.col("line").cast("int").alias("line"), within.alias("to"), F.col("type").alias("push")))
    parents = symbols.select(of(F.col("path"), F.col("qualified")).alias("scope"), scope.alias("parent")).distinct()
    return bindings, parents


def bind(uses: DataFrame, symbols: DataFrame, imports: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """(path, ln, names, def_path, def_line): definitions of uses (path, ln, within, names), other than on the use's own line."""
    bindings, parents = scope_graph(symbols, imports, typed)
    scope = F.when(F.col("within").isNull() | (F.col("within") == ""), F.col("path")).otherwise(F.concat_ws("#", "path", "within"))
    refs = uses.select(F.struct("path", "ln", "names").alias("ref"), scope.alias("scope"), "names").distinct()
    # Scopes without symbols of their own, such as files of imports alone, still stand for themselves.
    alone = refs.select("scope").union(bindings.select("scope")).distinct().select("scope", F.lit(ROOT).alias("parent"))
    tops = alone.join(parents.select("scope").hint("merge"), "scope", "left_anti")
    got = stitch(refs, bindings, parents.unionByName(tops))
    return got.select("ref.path", "ref.ln", "ref.names", F.col("path").alias("def_path"), F.col("line").alias("def_line")).where("not (path = def_path and ln = def_line)").distinct()
