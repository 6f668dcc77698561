"""The call graph of a set of files, and trees of callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_param_is_receiver, param_count
from ..plans.shared import Steps
from . import graph, ranking

# How many nodes a tree has, and how many children a node.
MAX_NODES, MAX_CHILDREN = 80, 12


def occurrences(idents: DataFrame, symbols: DataFrame) -> DataFrame:
    """idents (path, name, ln, is_call, argc) with ``symbol`` and ``symbol_path`` around them, without the names of
    definitions where these are defined and without what lies outside of any symbol."""
    s = symbols.select(F.col("path").alias("sp"), "start_line", "end_line", "ord", "qualified", F.col("name").alias("sn"))
    inside = (F.col("path") == F.col("sp")) & F.col("ln").between(F.col("start_line"), F.col("end_line"))
    rank = F.struct("start_line", -F.col("end_line"), F.col("ord"))
    around = idents.withColumn("_k", F.struct(*idents.columns)).join(s, inside)
    best = around.groupBy("_k").agg(F.max_by("qualified", rank).alias("symbol"), F.max(F.when((F.col("ln") == F.col("start_line")) & (F.col("name") == F.col("sn")), 1).otherwise(0)).alias("own"))
    return best.where("own = 0").select("_k.*", "symbol")


def build(idents: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, caller_path, name, ln, callee, callee_path, start_line, ambiguous): the first call of each name in each symbol,
    joined to the definitions that scope, file, folder or number of arguments leave."""
    first = occurrences(idents, symbols).where(F.col("is_call") & (F.char_length("name") >= 2)).groupBy("path", "symbol", "name").agg(F.min(F.struct("ln", "argc")).alias("c"))
    scope = F.when(F.col("symbol").contains("."), F.regexp_extract("symbol", r"^(.*)\.[^.]*$", 1))
    calls = first.select(F.concat_ws("\u0000", "path", "symbol", "name").alias("call_id"), F.col("symbol").alias("caller"), F.col("path").alias("my_file"), "name", F.col("c.ln").alias("ln"), F.col("c.argc").alias("argc"), scope.alias("my_scope"))
    d = symbols.where("kind <> 'mod'").select("name", F.col("qualified").alias("callee"), F.col("path").alias("file"), F.col("parent").alias("scope"), "start_line", param_count(F.col("signature")).alias("params"), first_param_is_receiver(F.col("signature")).alias("is_method"))
    pairs = calls.join(d, "name").where((F.col("callee") != F.col("caller")) | (F.col("file") != F.col("my_file")))
    kept = graph.narrow_by_scope(pairs)
    return kept.select("caller", F.col("my_file").alias("caller_path"), "name", "ln", "callee", F.col("file").alias("callee_path"), "start_line", "ambiguous")


def tree(edges: DataFrame, symbol: str, path: str, depth: int, up: bool = False, nodes: int = MAX_NODES, children: int = MAX_CHILDREN) -> DataFrame:
    """(depth, parent, symbol, path, ln, ambiguous): what a symbol calls, or with ``up`` what calls it, level by level.

    edges are those of ``build``. Of a call with several definitions the first one that isn't in the tree counts. A node
    shows at most ``children``, the tree at most ``nodes``; a symbol stands where it is reached first. Levels are tables,
    so no graph is gathered; a level is bounded by the caps.
    """
    spark, step = edges.sparkSession, Steps(edges.sparkSession)
    if up:
        e = edges.select(F.col("callee").alias("parent"), F.col("callee_path").alias("pp"), F.concat_ws("\u0000", "caller_path", "caller").alias("slot"), F.col("caller").alias("symbol"), F.col("caller_path").alias("path"), "ln", F.lit(False).alias("ambiguous"), F.lit(0).alias("start_line"))
    else:
        e = edges.select(F.col("caller").alias("parent"), F.col("caller_path").alias("pp"), F.col("name").alias("slot"), F.col("callee").alias("symbol"), F.col("callee_path").alias("path"), "ln", "ambiguous", "start_line")
    shape = "depth int, parent string, symbol string, path string, ln int, ambiguous boolean"
    seen = spark.createDataFrame([(0, None, symbol, path, None, False)], shape)
    level, left = seen, nodes
    for d in range(1, depth + 1):
        front = F.broadcast(level.select(F.col("symbol").alias("parent"), F.col("path").alias("pp")))  # at most the cap on nodes
        reached = e.join(front, ["parent", "pp"]).join(F.broadcast(seen.select("symbol", "path")), ["symbol", "path"], "left_anti")
        one = ranking.top_n(reached, ["parent", "pp", "slot"], ["path", "start_line"], 1)
        some = ranking.top_n(one, ["parent", "pp"], ["ln", "path", "symbol"], children)
        new = some.groupBy("symbol", "path").agg(F.min(F.struct("pp", "ln", "parent", "ambiguous")).alias("b"))
        new = new.orderBy("b.pp", "b.parent", "b.ln", "path", "symbol").limit(left)
        level = step(new.select(F.lit(d).alias("depth"), F.col("b.parent").alias("parent"), "symbol", "path", F.col("b.ln").cast("int").alias("ln"), F.col("b.ambiguous").alias("ambiguous")), "level")
        found = level.count()
        if not found:
            break
        seen, left = seen.unionByName(level), left - found
        if left <= 0:
            break
    return seen.where("depth > 0")


def resolver_matches(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """candidates (call_id, name, file, start_line, ...) of calls for which exactly one matches what a resolver found
    (call_id, name, file, line): those one each; other calls keep all of theirs."""
    r = resolved.select("call_id", "name", "file", F.col("line").alias("start_line")).distinct().withColumn("_hit", F.lit(1))
    marked = candidates.join(r, ["call_id", "name", "file", "start_line"], "left")
    n = F.coalesce(F.sum("_hit").over(Window.partitionBy("call_id")), F.lit(0))
    return marked.withColumn("_n", n).where((F.col("_n") != 1) | F.col("_hit").isNotNull()).drop("_n", "_hit")
