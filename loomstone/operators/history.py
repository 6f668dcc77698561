"""Commit logs and diffs: parsing, churn, co-change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import detect_lang
from . import intervals


def normalize_rename(path: Column) -> Column:
    """The new path of "a/{old => new}/b" and "old => new"."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    plain = F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), F.replace(braces, F.lit("//"), F.lit("/"))).when(path.contains(" => "), F.substring_index(path, " => ", -1))
    return F.coalesce(plain, path)


def parse_numstat(log: DataFrame) -> DataFrame:
    """(repo, seq, hash, author, ts, subject, files array<struct<adds,dels,path>>) of logs (repo, raw), or of parts of logs
    with ``first``, the number of commits before the part.

    A commit starts with \\x01 and holds tab-separated fields; number lines follow. "-" (binary) counts -1.
    """
    before = F.col("first") if "first" in log.columns else F.lit(0)
    each = log.select("repo", before.alias("first"), F.posexplode(F.split("raw", "\u0001")).alias("p", "body")).where("p > 0").withColumn("seq", F.col("first") + F.col("p"))
    rows = F.split("body", "\r?\n")
    head = F.split(rows[0], "\t", 4)
    stats = F.filter(F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: F.split(r, "\t", 3)), lambda p: F.size(p) == 3)
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(-1).cast("long"))
    files = F.transform(stats, lambda p: F.struct(number(p[0]).alias("adds"), number(p[1]).alias("dels"), normalize_rename(p[2]).alias("path")))
    return each.where(F.size(head) == 4).select("repo", "seq", head[0].alias("hash"), head[1].alias("author"), head[2].try_cast("long").alias("ts"), head[3].alias("subject"), files.alias("files"))


def churn(commit_files: DataFrame) -> DataFrame:
    """(path, commits, lines, last_author, last_ts): rows and changed lines of each path, and who came last.

    commit_files (path, adds, dels, author, ts, seq), seq 0 the newest. Binary changes count no lines.
    """
    changed = F.greatest("adds", F.lit(0)) + F.greatest("dels", F.lit(0))
    return commit_files.groupBy("path").agg(F.count("*").alias("commits"), F.sum(changed).alias("lines"), F.min_by("author", "seq").alias("last_author"), F.min_by("ts", "seq").alias("last_ts"))


def co_change(commit_files: DataFrame, target, commit: str = "hash") -> DataFrame:
    """(path, together): how often other paths changed in commits that touch the target; rows count, as in the log."""
    hit = commit_files.where(F.col("path") == target).select(commit).distinct()
    return commit_files.where(F.col("path") != target).join(hit, commit, "left_semi").groupBy("path").agg(F.count("*").alias("together"))


def changed_union(*lists: DataFrame) -> DataFrame:
    """(path): the different paths of several lists of changes."""
    every = lists[0].select("path")
    for more in lists[1:]:
        every = every.unionByName(more.select("path"))
    return every.distinct()


def hot(commit_files: DataFrame, indexed: DataFrame, limit: int) -> DataFrame:
    """The most changed of the indexed files (path), one more than the limit to tell that there are more."""
    return churn(commit_files.join(indexed.select("path").distinct(), "path", "left_semi")).orderBy(F.desc("commits"), F.desc("lines"), "path").limit(limit + 1)


def coupled(commit_files: DataFrame, target, limit: int, commit: str = "hash", least: int = 2) -> DataFrame:
    """(path, together, total): files changed in at least ``least`` of the total commits that touch the target, most often first."""
    total = commit_files.where(F.col("path") == target).agg(F.count_distinct(commit).alias("total"))
    often = co_change(commit_files, target, commit).where(F.col("together") >= least)
    return often.join(F.broadcast(total), F.lit(True)).orderBy(F.desc("together"), "path").limit(limit + 1)  # one row


def known_only(ranges: DataFrame) -> DataFrame:
    """Changed ranges (path, ...) of files in a known language."""
    return ranges.where(detect_lang(F.col("path")).isNotNull())


def diff_report(changes: DataFrame, untracked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, status, kind, symbol, start, end, place): the innermost symbols that changed ranges (ord, path, lo, hi, deleted) touch, the top-level ones of
    untracked files (path), and deleted files; of files in a known language. Files without such symbols have one row without one.

    ``place`` orders the report: changed files as they come (``ord``), then new ones by name; in a file by start, outer symbols first.
    """
    known = known_only(changes)
    modified = known.where("not deleted")
    s = symbols.select("path", "kind", "qualified", "start_line", "end_line")
    hit = intervals.uncovered(intervals.overlapping(s, modified), modified.select("path", "lo", "hi"))
    new = known_only(untracked).select("path").distinct()
    fresh = s.join(new, "path", "left_semi").where(F.instr("qualified", ".") == 0)
    files = known.groupBy("path").agg(F.min("ord").cast("long").alias("_o"), F.max("deleted").alias("_d")).select("path", F.when(F.col("_d"), "deleted").otherwise("modified").alias("status"), F.lit(0).alias("_n"), "_o")
    files = files.unionByName(new.select("path", F.lit("new").alias("status"), F.lit(1).alias("_n"), F.lit(0).cast("long").alias("_o")))
    named = hit.withColumn("_s", F.lit("modified")).unionByName(fresh.withColumn("_s", F.lit("new"))).withColumnRenamed("path", "_p")
    out = files.join(named, (F.col("path") == F.col("_p")) & (F.col("status") == F.col("_s")), "left")
    place = F.struct("_n", "_o", "path", "start_line", (-F.col("end_line")).alias("_e"), "qualified")
    return out.select(F.col("path").alias("file"), "status", "kind", F.col("qualified").alias("symbol"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), place.alias("place"))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """(id, path, lo, hi, deleted) of unified diffs (id, raw) without context lines.

    New-side ranges, closed; a pure deletion is anchored at line max(start, 1); a file without a new side is deleted and
    keeps its old path. The file of a hunk is the last header before it: one running value over the diff's lines.
    """
    rows = diffs.select("id", F.posexplode(F.split("raw", "\n")).alias("p", "line"))
    order = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda mark: F.when(F.col("line").startswith(mark + " "), F.regexp_replace(F.substring("line", F.lit(5), F.length("line")), r"^[ab]/|\t.*$", ""))
    known = rows.withColumn("old", F.last(side("---"), True).over(order)).withColumn("new", F.last(side("+++"), True).over(order))
    gone = F.col("new") == "/dev/null"
    pattern = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    start, count = F.regexp_extract("line", pattern, 1).try_cast("int"), F.regexp_extract("line", pattern, 2)
    n = F.when(count == "", F.lit(1)).otherwise(count.try_cast("int"))
    hunks = known.where(F.col("line").rlike(pattern)).select("id", F.when(gone, F.col("old")).otherwise(F.col("new")).alias("path"), start.alias("s"), n.alias("n"), gone.alias("deleted"))
    return hunks.select("id", "path", F.greatest("s", F.lit(1)).alias("lo"), F.when(F.col("n") == 0, F.greatest("s", F.lit(1))).otherwise(F.col("s") + F.col("n") - 1).alias("hi"), "deleted")
