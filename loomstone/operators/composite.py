"""Queries that combine several operators: show, locate, context, shape, impact, dependencies, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import external_name, file_match, is_test_path, is_test_symbol
from ..functions.grammar import split_locator
from ..functions.text import lines, name_tail
from ..functions import imports
from . import graph, ranking, search

# Caps of the composite answers.
MAX_CALLEES, MAX_CALLERS, MAX_TYPES, AUTO_CANDIDATES, AUTO_LINES = 24, 20, 16, 3, 400


def locate(symbols: DataFrame, name: str, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols by exact qualified name, else by bare name; a file, given or as "file.ext:Name", narrows them: its exact path
    wins over suffixes.

    Which of these holds is one row of maxima over what matches, joined back; no task sorts all symbols of a name.
    """
    if file is None:
        file, name = split_locator(name)
    hit = symbols.where((F.col("qualified") == name) | (F.col("name") == name))
    if kind:
        hit = hit.where(F.col("kind") == kind)
    if file:
        hit = hit.where(file_match(F.col("path"), file))
    # The exact path counts before the qualified name: the greatest pair of both is what the answer has.
    rank = F.struct((F.col("path") == file if file else F.lit(False)).alias("exact"), F.coalesce(F.col("qualified") == name, F.lit(False)).alias("whole"))
    best = hit.agg(F.max(rank).alias("_best"))
    return hit.join(F.broadcast(best), F.lit(True)).where(rank == F.col("_best")).drop("_best")  # one row


def ambiguity(pool: DataFrame, show: int = 8) -> str | None:
    """What to say if a pool of ``locate`` has several symbols: the first of them, and what would tell them apart."""
    first = pool.orderBy(F.length("qualified"), "path", "start_line").limit(show + 1).collect()  # a message
    if len(first) < 2:
        return None
    apart = [text for c, text in (("qualified", "Parent.Name"), ("path", "file:Name"), ("kind", "a kind")) if len({r[c] for r in first}) > 1]
    listed = "\n".join(f"  {r.qualified}  {r.path}:{r.start_line}" for r in first[:show])
    return f"several symbols match:\n{listed}\n" + (f"name one by {' or '.join(apart)}" if apart else "they share name, file and kind")


def bodies(files: DataFrame, symbols: DataFrame, context: int = 0) -> DataFrame:
    """symbols with ``code``: their lines, with ``context`` lines around. Files are joined once, lines cut in place."""
    text = files.select(F.col("path").alias("_p"), "text")
    joined = symbols.join(text, F.col("path") == F.col("_p"))
    first = F.greatest(F.col("start_line") - context, F.lit(1))
    return joined.withColumn("code", F.array_join(F.slice(lines(F.col("text")), first, F.col("end_line") + context - first + 1), "\n")).drop("_p", "text")


def auto_expand(pool: DataFrame) -> DataFrame:
    """A pool small enough to be shown whole (three candidates, 400 lines), else nothing."""
    all_ = Window.partitionBy()
    sized = pool.withColumn("_n", F.count("*").over(all_)).withColumn("_l", F.sum(F.col("end_line") - F.col("start_line") + 1).over(all_))
    return sized.where((F.col("_n") <= AUTO_CANDIDATES) & (F.col("_l") <= AUTO_LINES)).drop("_n", "_l")


def context(files: DataFrame, symbols: DataFrame, idents: DataFrame, qualified: str, no_tests: bool = False) -> DataFrame:
    """(section, name, path, ln, ambiguous) around one symbol: itself, what it calls, and what uses it.

    idents (path, name, ln, is_call, argc). Definitions are cut to six for each name before narrowing. Callers are first
    uses by enclosing symbol, outside of the symbol's own lines; production callers alone count towards their cap.
    """
    me = symbols.where(F.col("qualified") == qualified).orderBy("path", "start_line").limit(1)
    own = me.select(F.col("path").alias("mp"), F.col("start_line").alias("ms"), F.col("end_line").alias("me"), F.col("parent").alias("my_scope"), F.col("name").alias("my_name"))
    inside = (F.col("path") == F.col("mp")) & F.col("ln").between(F.col("ms"), F.col("me"))
    calls = idents.join(F.broadcast(own), inside).where(F.col("is_call") & (F.char_length("name") >= 2))  # one row
    first = calls.groupBy("name").agg(F.min("ln").alias("ln"), F.min_by("argc", "ln").alias("argc"), F.first("mp").alias("my_file"), F.first("my_scope").alias("my_scope"), F.first("my_name").alias("my_name"))
    defs = ranking.top_n(symbols.join(first.select("name"), "name", "left_semi"), ["name"], ["path", "start_line"], 6)
    from ..functions.text import first_param_is_receiver, param_count

    d = defs.where("kind <> 'mod'").select("name", F.col("qualified").alias("callee"), F.col("path").alias("file"), F.col("parent").alias("scope"), "start_line", param_count(F.col("signature")).alias("params"), first_param_is_receiver(F.col("signature")).alias("is_method"))
    cands = first.where("name <> my_name").join(d, "name").withColumn("call_id", F.col("name")).where(F.col("callee") != qualified)
    callees = graph.narrow_by_scope(cands).orderBy("ln", "callee").limit(MAX_CALLEES).select(F.lit("calls").alias("section"), F.col("callee").alias("name"), F.col("file").alias("path"), F.col("start_line").alias("ln"), "ambiguous")
    from .intervals import enclosing

    uses = idents.join(F.broadcast(own), F.col("name") == F.col("my_name")).where(~inside).select("path", "ln").distinct()
    callers = enclosing(uses, symbols).groupBy("path", "symbol").agg(F.min("ln").alias("ln"))
    if no_tests:
        callers = callers.where(~(is_test_path(F.col("path")) | is_test_symbol(F.col("symbol"))))
    callers = callers.orderBy("path", "ln").limit(MAX_CALLERS).select(F.lit("called_by").alias("section"), F.col("symbol").alias("name"), "path", "ln", F.lit(False).alias("ambiguous"))
    head = me.select(F.lit("symbol").alias("section"), F.col("qualified").alias("name"), "path", F.col("start_line").alias("ln"), F.lit(False).alias("ambiguous"))
    return head.unionByName(callees).unionByName(callers)


def referenced_types(used: DataFrame, types: DataFrame, per_name: int = 2) -> DataFrame:
    """(of, name, path, ln) of the type symbols that identifiers of each symbol name, a few for each name.

    A file may be any one that is left out, so the first ``per_name`` of each file, of these the first two times as many, hold every
    answer of a name. They are one row that each use meets; pairs of uses and types are never handed on.
    """
    each = ranking.top_n(types.where("path is not null").select("name", "path", "ln"), ["name", "path"], ["ln"], per_name)
    few = ranking.top_n(each, ["name"], ["path", "ln"], 2 * per_name).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("path", "ln"))).alias("_t"))
    met = used.select("of", "name").distinct().join(few.hint("merge"), "name")
    return met.select("of", "name", F.inline(F.slice(F.filter("_t", lambda t: t["path"] != F.col("of")), 1, per_name)))


def impact(hits: DataFrame, is_test: Column, refs: int = search.LIMITS["refs"]) -> DataFrame:
    """(section, path, ln, symbol): the references of a name, the symbols that use it, and the tests among them."""
    marked = hits.withColumn("_t", is_test)
    by_symbol = lambda rows, name: rows.groupBy("path", "symbol").agg(F.min("ln").alias("ln")).select(F.lit(name).alias("section"), "path", "ln", "symbol")
    first = marked.orderBy("path", "ln").limit(refs).select(F.lit("refs").alias("section"), "path", "ln", "symbol")
    return first.unionByName(by_symbol(marked.where("symbol <> ''"), "callers")).unionByName(by_symbol(marked.where("_t"), "tests"))


def tests_for(hits: DataFrame, definition: DataFrame) -> DataFrame:
    """(path, symbol, ln, non_test_refs): the tests among the references (path, ln, symbol) of a defined symbol (path, start_line, end_line, name), each with its
    first line, and how many other references there are.

    The definition itself is no reference: lines of it whose innermost symbol has its name are left out, by place, so that
    calls of itself from elsewhere and symbols of the same name in other files count."""
    own = definition.select(F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.col("name").alias("_n"))
    inside = (F.col("path") == F.col("_p")) & F.col("ln").between(F.col("_s"), F.col("_e")) & (name_tail(F.col("symbol")) == F.col("_n"))
    marked = hits.join(F.broadcast(own.limit(1)), inside, "left_anti").withColumn("_t", is_test_path(F.col("path")) | is_test_symbol(F.col("symbol")))  # one row
    # One aggregate for both: other references are a group of their own, of partial sums.
    groups = marked.groupBy(F.when(F.col("_t"), F.struct("path", "symbol")).alias("_g")).agg(F.min("ln").alias("ln"), F.count("*").alias("_n"))
    others = groups.where("_g is null").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("non_test_refs"))
    return groups.where("_g is not null").join(F.broadcast(others), F.lit(True)).select("_g.path", "_g.symbol", "ln", "non_test_refs")  # one row


def dependencies(files: DataFrame, own: list[str] = ()) -> dict[str, DataFrame]:
    """Import edges, two-way pairs, most imported files and external packages of files (path, lang, text)."""
    specs = imports.specs_of(files).distinct()
    resolved = imports.resolve(specs, files, own)
    edges = resolved.where(F.col("path") != F.col("importer")).select(F.col("importer").alias("src"), F.col("path").alias("dst")).distinct()
    unknown = specs.join(resolved.select("importer", "spec").hint("merge"), ["importer", "spec"], "left_anti")
    outside = unknown.select("importer", external_name(F.col("lang"), F.col("spec"), own).alias("package")).where("package is not null").distinct()
    return {
        "edges": edges,
        "cycles": graph.mutual_pairs(edges),
        "most_imported": graph.in_degree(edges).orderBy(F.desc("n"), "node").limit(10),
        "external": outside.groupBy("package").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(20),
    }


def orientation(symbols: DataFrame, idents: DataFrame, budget: int = 900) -> DataFrame:
    """The top-level symbols by fan-in whose lines fit into a token budget."""
    ranked = ranking.fan_in(symbols.where("parent is null and not (kind = 'mod' and start_line = end_line)"), idents)
    top = ranked.orderBy(F.desc("fan_in"), "name", "path").limit(budget)  # a line costs a token at least
    cost = search.chunk_cost(F.concat_ws(" ", "kind", "qualified", "path"))
    return search.budget_prefix(top.withColumn("_all", F.lit(1)), ["_all"], [F.desc("fan_in"), "name", "path"], cost, budget).drop("_all")
