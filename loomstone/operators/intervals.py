"""Closed line intervals: innermost enclosing symbol, overlaps, coverage, and the cost of reading around hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import est_tokens
from ..plans.shared import materialise

PAD = 40


def _labelled(hits: DataFrame, of) -> DataFrame:
    """hits with ``symbol`` by ``of``, which adds it to rows (path, ln, ...); the hits of a line go through it as one row, so they are searched once."""
    rest = [c for c in hits.columns if c not in ("path", "ln")]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    out = of(hits.groupBy("path", "ln").agg(F.collect_list(row).alias("_rows"))).withColumn("_row", F.explode("_rows"))
    return out.select(*[F.col(f"_row.{c}") if c in rest else F.col(c) for c in hits.columns], "symbol")


def enclosing(hits: DataFrame, symbols: DataFrame, keep_all: bool = True) -> DataFrame:
    """hits (path, ln, ...) with ``symbol``, the qualified name of the innermost symbol around ln.

    An equi-join on the path with the range as residual, so it hashes or sorts by path instead of looping over
    pairs; then one partial aggregate for each (path, ln). Ties go to the later, shorter, last-extracted symbol.
    Without a symbol the label is "" (or the hit goes, if not keep_all). For files of very many symbols and hits see ``enclosing_dyadic``.
    """
    s = symbols.select(F.col("path").alias("sp"), "start_line", "end_line", "ord", "qualified")
    inside = (F.col("path") == F.col("sp")) & F.col("ln").between(F.col("start_line"), F.col("end_line"))
    rank = F.struct("start_line", -F.col("end_line"), F.col("ord"))

    def of(lines: DataFrame) -> DataFrame:
        found = lines.join(s, inside, "left" if keep_all else "inner")
        return found.groupBy("path", "ln").agg(F.first("_rows").alias("_rows"), F.coalesce(F.max_by("qualified", rank), F.lit("")).alias("symbol"))

    return _labelled(hits, of)


def dyadic_cover(start: Column, end: Column) -> Column:
    """The blocks (level, block) that make up the lines from start to end: block b of level k is lines b * 2^k up to (b + 1) * 2^k - 1.

    At most two of each level, so some 2 log of the length; every line lies in one of them."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((end - start + 1).cast("double"))).cast("int"))

    def of(k: Column) -> Column:
        power = F.pow(F.lit(2.0), k).cast("long")
        left, right = F.floor((start + power - 1) / power).cast("long"), F.floor((end + 1) / power).cast("long")
        takes_left = (left < right) & (left % 2 == 1)
        takes_right = (F.when(takes_left, left + 1).otherwise(left) < right) & (right % 2 == 1)
        block = lambda b: F.struct(k.alias("level"), b.alias("block"))
        return F.array(F.when(takes_left, block(left)), F.when(takes_right, block(right - 1)))

    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def enclosing_dyadic(hits: DataFrame, symbols: DataFrame, keep_all: bool = True) -> DataFrame:
    """The same as ``enclosing`` by equal keys alone: symbols are cut into dyadic blocks of lines, hits looked up at the blocks around them.

    A pair of a hit and a symbol around it meets in exactly one key (path, level, block), so nothing but answers is made, and
    a huge file is dealt over many keys instead of being one task's product. Costs a row for each level of the longest symbol and hit.
    """
    valid = symbols.where("start_line >= 0 and end_line >= start_line")
    cover = valid.select("path", F.explode(dyadic_cover(F.col("start_line"), F.col("end_line"))).alias("b"), "qualified", F.struct("start_line", -F.col("end_line"), F.col("ord")).alias("r"))
    cover = cover.select("path", "b.level", "b.block", "qualified", "r").groupBy("path", "level", "block").agg(F.max("r").alias("r"), F.max_by("qualified", "r").alias("qualified"))
    longest = valid.agg(F.max(F.col("end_line") - F.col("start_line") + 1)).first()[0] or 1  # one row
    levels = F.sequence(F.lit(0), F.lit(int(longest).bit_length() - 1))

    def of(lines: DataFrame) -> DataFrame:
        at = lines.select("path", "ln", F.explode(levels).alias("level")).withColumn("block", F.floor(F.col("ln") / F.pow(F.lit(2.0), "level")).cast("long"))
        inner = at.join(cover, ["path", "level", "block"]).groupBy("path", "ln").agg(F.max_by("qualified", "r").alias("symbol"))
        return lines.join(inner, ["path", "ln"], "left" if keep_all else "inner").withColumn("symbol", F.coalesce("symbol", F.lit("")))

    return _labelled(materialise(hits, "hits"), of)


def enclosing_dense(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same by a line map: every line of a symbol becomes a row, so the join is on (path, line) alone.

    Better where files hold many symbols for each hit; costs a row for each line and nesting level.
    """
    rank = F.struct("start_line", -F.col("end_line"), F.col("ord"))
    lines = symbols.select("path", F.explode(F.sequence("start_line", "end_line")).alias("ln"), "qualified", rank.alias("r"))
    innermost = lines.groupBy("path", "ln").agg(F.max_by("qualified", "r").alias("symbol"))
    return hits.join(innermost, ["path", "ln"], "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))


def overlapping(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that a range (path, lo, hi) of their file touches, each once."""
    r = ranges.select(F.col("path").alias("rp"), "lo", "hi")
    return symbols.join(r, (F.col("path") == F.col("rp")) & (F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")), "left_semi")


def uncovered(touched: DataFrame, ranges: DataFrame) -> DataFrame:
    """Touched symbols without containers whose every changed line lies in a nested touched symbol.

    Symbols of the same lines don't hold each other. Changed lines are expanded and looked up among nested symbols: a semi-join instead of interval arithmetic.
    """
    changed = ranges.select(F.col("path").alias("cp"), F.explode(F.sequence("lo", "hi")).alias("cl")).distinct()
    lines = touched.join(changed, (F.col("path") == F.col("cp")) & F.col("cl").between(F.col("start_line"), F.col("end_line"))).drop("cp")
    nested = touched.select(F.col("path").alias("np"), F.col("qualified").alias("nq"), F.col("start_line").alias("ns"), F.col("end_line").alias("ne"))
    inner = (F.col("path") == F.col("np")) & (F.col("nq") != F.col("qualified")) & (F.col("ns") >= F.col("start_line")) & (F.col("ne") <= F.col("end_line")) & ((F.col("ns") > F.col("start_line")) | (F.col("ne") < F.col("end_line")))
    bare = lines.join(nested, inner & F.col("cl").between(F.col("ns"), F.col("ne")), "left_anti")
    return bare.select(*touched.columns).distinct()


def baseline_tokens(lines: DataFrame, hits: DataFrame, pad: int = PAD) -> DataFrame:
    """(path, tokens): what reading ``pad`` lines around each hit of a file costs; the whole file without a valid hit.

    lines (path, ln, n_bytes); hits (path, ln). A line is read if the nearest hit before or after it is near
    enough: two running values over the file's lines, no interval merging. Costs are rounded for each file.
    """
    marks = hits.select(F.col("path"), F.col("ln").alias("ln"), F.lit(True).alias("hit")).distinct()
    by_line = Window.partitionBy("path").orderBy("ln")
    seen = lines.join(marks, ["path", "ln"], "left").withColumn("at", F.when(F.col("hit"), F.col("ln")))
    before = F.last("at", ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("at", ignorenulls=True).over(by_line.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col("ln") - before <= pad, F.lit(False)) | F.coalesce(after - F.col("ln") <= pad, F.lit(False))
    cost = seen.withColumn("near", near).groupBy("path").agg(F.sum(F.when(F.col("near"), F.col("n_bytes") + 1)).alias("some"), F.sum(F.col("n_bytes") + 1).alias("whole"))
    return cost.select("path", est_tokens(F.coalesce("some", "whole")).alias("tokens"))


#: Lines of a block of the stored sums.
BLOCK = 64


def line_sums(lines: DataFrame) -> DataFrame:
    """(path, block, before, sizes) of lines (path, ln, n_bytes): bytes with line ends of the lines before each block of ``BLOCK`` lines, and of each
    line in it. Made once, when a file is indexed; its rows are few, as are those that a window of it sees."""
    at = F.floor((F.col("ln") - 1) / BLOCK).cast("int")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("ln", (F.col("n_bytes") + 1).cast("long").alias("b")))), lambda x: x["b"])
    blocks = lines.groupBy("path", at.alias("block")).agg(sizes.alias("sizes"))
    own = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("path", "block", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("before"), "sizes")


def merged_windows(hits: DataFrame, n_lines: DataFrame, pad: int = PAD) -> DataFrame:
    """(path, lo, hi): the lines within ``pad`` of a hit (path, ln), as few closed intervals as make them up, cut to files (path, n)."""
    near = hits.select("path", "ln").distinct().join(n_lines, "path").where((F.col("ln") + pad >= 1) & (F.col("ln") - pad <= F.col("n")))
    order = Window.partitionBy("path").orderBy("ln")
    opens = F.coalesce((F.col("ln") - F.lag("ln").over(order) > 2 * pad + 1).cast("int"), F.lit(1))
    runs = near.withColumn("_o", opens).withColumn("_k", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("path", "_k").agg(F.min("ln").alias("a"), F.max("ln").alias("b"), F.first("n").alias("n"))
    return spans.select("path", F.greatest(F.col("a") - pad, F.lit(1)).cast("int").alias("lo"), F.least(F.col("b") + pad, F.col("n")).cast("int").alias("hi"))


def baseline_from_sums(sums: DataFrame, hits: DataFrame, pad: int = PAD) -> DataFrame:
    """The same as ``baseline_tokens`` from ``line_sums``: a window costs the difference of two looked-up sums, and no line is read.

    Windows are few for each file; each meets its first and last block by equal keys."""
    last = sums.groupBy("path").agg(F.max_by(F.struct("block", "before", "sizes"), "block").alias("l"))
    total = F.col("l.before") + F.aggregate("l.sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    files = last.select("path", (F.col("l.block") * BLOCK + F.size("l.sizes")).alias("n"), total.alias("whole"))
    spans = merged_windows(hits, files.select("path", "n"), pad)
    # The bytes up to a line: lo - 1 counts with a minus.
    ends = spans.select("path", F.explode(F.array(F.struct((F.col("lo") - 1).alias("ln"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("ln"), F.lit(1).alias("sign")))).alias("e")).select("path", "e.ln", "e.sign").where("ln > 0")
    met = ends.withColumn("block", F.floor((F.col("ln") - 1) / BLOCK).cast("int")).join(sums, ["path", "block"])
    upto = F.col("before") + F.aggregate(F.slice("sizes", F.lit(1), F.col("ln") - F.col("block") * BLOCK), F.lit(0).cast("long"), lambda a, x: a + x)
    some = met.groupBy("path").agg(F.sum(upto * F.col("sign")).alias("some"))
    return files.join(some, "path", "left").select("path", est_tokens(F.coalesce("some", "whole")).alias("tokens"))
