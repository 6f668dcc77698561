"""Lookup by name, fuzzy lookup, text search, references, outlines and budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_lower, est_tokens, lines, word_pattern

# Default limits.
LIMITS = {"find": 25, "refs": 100, "grep": 50, "entries": 40, "blame": 10, "hot": 20, "coupling": 15, "tree_budget": 2000, "context_budget": 3000, "shape_budget": 2000, "calls_depth": 2, "path_depth": 8}


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def like(c: Column, wanted: str) -> Column:
    """c holds wanted, ASCII case ignored; % and _ in wanted are wildcards."""
    return ascii_lower(c).like(f"%{fold(wanted)}%")


def find(symbols: DataFrame, wanted: str, limit: int = LIMITS["find"], kind: str | None = None) -> DataFrame:
    """Symbols whose name or qualified name is or holds ``wanted``: exact ones first, then short ones. One row
    more than the limit tells that there are more."""
    name, qualified = F.col("name"), F.col("qualified")
    hit = symbols.where((name == wanted) | (qualified == wanted) | like(name, wanted) | like(qualified, wanted))
    if kind:
        hit = hit.where(F.col("kind") == kind)
    first = F.when((name == wanted) | (qualified == wanted), 0).otherwise(1)
    return hit.orderBy(first, F.char_length(qualified), "path", "start_line", "ord").limit(limit + 1)


def fuzzy_score(query: str, candidate: Column) -> Column:
    """1000 less position and length for a substring; else 500 less gaps for an ordered subsequence; null for neither.

    The query is a literal, so the subsequence search unrolls into one locate for each of its characters.
    Positions count bytes; names are ASCII nearly always, and where they aren't the byte lengths of the pieces count.
    """
    q = fold(query)
    c = ascii_lower(candidate)
    if not q:
        return F.lit(None).cast("long")
    size = F.octet_length(c)
    pos = F.octet_length(F.substring(c, F.lit(1), F.instr(c, q) - 1))
    direct = F.lit(1000) - pos * 4 - (size - len(q.encode()))
    # (rest, gaps): what remains after each character, and the bytes skipped before it.
    start = F.struct(c.alias("rest"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        at = F.instr(acc["rest"], ch)
        skipped = F.octet_length(F.substring(acc["rest"], F.lit(1), at - 1))
        return F.struct(F.substring(acc["rest"], at + 1, F.char_length(acc["rest"])).alias("rest"), (acc["gaps"] + skipped).alias("gaps"), (acc["ok"] & (at > 0)).alias("ok"))

    end = lambda s: F.when(s["ok"], F.lit(500) - s["gaps"] * 2 - F.floor(F.octet_length(s["rest"]) / 2))
    scattered = F.aggregate(F.array(*[F.lit(ch) for ch in q]), start, step, end)
    score = F.when(F.instr(c, q) > 0, direct.cast("long")).otherwise(F.when(scattered > 0, scattered.cast("long")))
    return F.when(size > 0, score)


def fuzzy(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best matches by name or qualified name; shorter qualified names first among equals."""
    score = F.greatest(fuzzy_score(query, F.col("name")), fuzzy_score(query, F.col("qualified")))
    scored = symbols.withColumn("score", score).where("score is not null")
    return scored.orderBy(F.desc("score"), F.octet_length("qualified"), "path", "ord").limit(limit)


def matcher(line: Column, pattern: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """Line predicate. Look-around and back-references are refused, as the pattern language has none; whether a pattern is
    valid is for the engine that runs it to say."""
    if regex:
        if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(=|!|<=|<!|>)|\\[1-9])", pattern):
            raise ValueError("look-around and back-references aren't supported")
        return line.rlike(("(?iu)" if ignore_case else "") + pattern)
    return F.lower(line).contains(pattern.lower()) if ignore_case else line.contains(pattern)


def grep(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, include: DataFrame | None = None) -> DataFrame:
    """(path, ln, line) of matching lines; ``include`` (path, text), such as dependencies that aren't indexed, is searched instead of the files.

    The text is tested before its lines are exploded: files without a match never leave the scan's stage, which is
    what an external prefilter would do. A regex is tested in multi-line mode there, where ^ and $ keep their meaning;
    one with an anchor of whole texts, a part that gives nothing back, or flags switched off isn't.
    """
    rows = files if include is None else include
    if not regex or not re.search(r"\\[AzZGQ]|\(\?[a-zA-Z]*-|[*+?}]\+|\(\?>", pattern):
        rows = rows.where(matcher(F.col("text"), f"(?m){pattern}" if regex else pattern, regex, ignore_case))
    each = rows.select("path", F.posexplode(lines(F.col("text"))).alias("p", "line"))
    return each.where(matcher(F.col("line"), pattern, regex, ignore_case)).select("path", (F.col("p") + 1).alias("ln"), "line")


def refs(files: DataFrame, name: str) -> DataFrame:
    """(path, ln, line) of lines that use the name as a whole identifier, each line once."""
    rows = files.where(F.col("text").contains(name)).select("path", F.posexplode(lines(F.col("text"))).alias("p", "line"))
    return rows.where(F.col("line").rlike(word_pattern(name))).select("path", (F.col("p") + 1).alias("ln"), "line")


def budget_prefix(rows: DataFrame, by: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The rows of each group until the first that would exceed the budget; later, cheaper ones don't return."""
    w = Window.partitionBy(*by).orderBy(*order)
    spent = rows.withColumn("_cost", cost).withColumn("_sum", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = spent.withColumn("_over", F.max((F.col("_sum") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return over.where("_over = 0").drop("_over", "_sum", "_cost")


def chunk_cost(text: Column) -> Column:
    return est_tokens(F.octet_length(text))
