"""History of a repository, read by the git program on the driver and parsed by Spark."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import changed_union, parse_hunks, parse_numstat

FORMAT = "\x01%H\t%an\t%at\t%s"


#: Commits in a row that a task parses.
CHUNK = 200


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def commits(spark: SparkSession, root: str, since: str = "6 months ago") -> DataFrame:
    """(repo, seq, hash, author, ts, subject, files) of commits since a date, newest first."""
    each = git(root, "log", f"--format={FORMAT}", f"--since={since}", "--numstat").split("\x01")[1:]
    # Some commits a row, so that tasks share the parsing.
    rows = [(root, at, "".join(f"\x01{c}" for c in each[at : at + CHUNK])) for at in range(0, len(each), CHUNK)]
    return parse_numstat(spark.createDataFrame(rows, "repo string, first int, raw string"))


def commit_files(log: DataFrame) -> DataFrame:
    """One row for each path of a commit."""
    each = log.select("hash", "author", "ts", F.struct("seq").alias("_s"), F.posexplode("files").alias("pos", "f"))
    return each.select("hash", "author", "ts", F.struct(F.col("_s.seq"), "pos").alias("seq"), "f.path", "f.adds", "f.dels")


def hunks(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """Changed ranges of the working tree against a commit."""
    files = re.split(r"(?m)^(?=diff --git )", git(root, "diff", "--unified=0", ref))
    return parse_hunks(spark.createDataFrame([(k, raw) for k, raw in enumerate(files) if raw], "id int, raw string")).drop("id")


def changed_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths that differ from HEAD or aren't tracked."""
    paths = lambda *args: spark.createDataFrame([(p,) for p in git(root, *args).splitlines()], "path string")
    return changed_union(paths("diff", "--name-only", "HEAD"), paths("ls-files", "--others", "--exclude-standard"))


def line_history(spark: SparkSession, root: str, path: str, start: int, end: int, limit: int = 10) -> DataFrame:
    """(hash, author, ts, subject) of the commits that touched a range of lines."""
    raw = git(root, "log", f"-{limit}", f"--format={FORMAT}", f"-L{start},{end}:{path}")
    heads = spark.createDataFrame([(raw,)], "raw string").select(F.explode(F.slice(F.split("raw", "\u0001"), F.lit(2), F.lit(limit))).alias("body"))
    parts = F.split(F.substring_index("body", "\n", 1), "\t", 4)
    return heads.select(parts[0].alias("hash"), parts[1].alias("author"), parts[2].try_cast("long").alias("ts"), parts[3].alias("subject"))
