"""The index of a source tree: listing, change detection, incremental upkeep, storage."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import EXCLUDED_DIRS, detect_lang, is_indexed_path

# Files above this size aren't indexed.
MAX_BYTES = 512 * 1024


def ignore_rules(lines: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(pattern, ignores) in order of lines (folder of the ignore file, line): Java patterns of whole relative paths."""
    out = []
    for folder, line in lines:
        text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
        if not text or text.startswith("#"):
            continue
        ignores = not text.startswith("!")
        text = text[not ignores :]
        only_folders, text = text.endswith("/"), text.rstrip("/")
        anchored = "/" in text
        body = ""
        for part in re.findall(r"\*\*/|/\*\*|\*+|\?|\[!?[^\]]+\]|\\.|[^*?\[\\/]+|.", text.lstrip("/")):
            if part in ("**/", "/**"):
                body += "(?:.*/)?" if part == "**/" else "/.*"
            elif part[0] == "*":
                body += "[^/]*"
            elif part == "?":
                body += "[^/]"
            elif part[0] == "[" and len(part) > 1:
                body += part.replace("[!", "[^")
            else:
                body += re.escape(part[-1:] if part[0] == "\\" else part)
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/.+' if only_folders else '(?:/.*)?'}$", ignores))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that a path fits ignores it. A few rules of a tree; each is one pattern."""
    verdict = F.lit(False)
    for pattern, ignores in rules:
        verdict = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(verdict)
    return verdict


def rules_of(root: str) -> list[tuple[str, bool]]:
    """The rules of a local tree's .gitignore files and its own exclude file, outer ones first.

    Spark's file sources skip hidden files, so these few are read here; folders that are never indexed aren't walked.
    """
    base = root.removeprefix("file://")
    found = [("", os.path.join(base, ".git", "info", "exclude"))]
    for folder, below, files in os.walk(base):
        below[:] = sorted(d for d in below if d not in EXCLUDED_DIRS)
        if ".gitignore" in files:
            found.append((os.path.relpath(folder, base).replace(os.sep, "/").removeprefix("."), os.path.join(folder, ".gitignore")))
    lines = []
    for folder, file in found:
        if os.path.isfile(file):
            with open(file, encoding="utf-8", errors="replace") as f:
                lines += [(folder, line) for line in f.read().split("\n")]
    return ignore_rules(lines)


def scan(spark: SparkSession, root: str, submodules: tuple[str, ...] = (), rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(path, mtime_ns, size, lang, content) of the files below root worth indexing, and not ignored by the rules (``rules_of``).

    Listing, size and time come from file metadata, so unwanted files are dropped before they are read.
    Hidden files are skipped; submodule folders are walked even where a pruned name leads to them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.substring_index(F.regexp_replace("path", r"^file:/*", "/"), base, -1)
    rows = files.select(rel.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")
    wanted = is_indexed_path(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.")
    for sub in submodules:
        inner = F.substring(F.col("path"), F.lit(len(sub) + 2), F.length("path"))
        wanted = wanted | (F.col("path").startswith(sub + "/") & is_indexed_path(inner))
    if rules:
        wanted = wanted & ~ignored(F.col("path"), rules)
    return rows.where(wanted & (F.col("size") <= MAX_BYTES)).withColumn("lang", detect_lang(F.col("path")))


def texts(scanned: DataFrame) -> DataFrame:
    """scanned with ``text``; files that aren't UTF-8 are dropped."""
    return scanned.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where("text is not null").drop("content")


def changed(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files of disk (path, size, mtime_ns, ...) that the index lacks or knows with another size or time."""
    known = indexed.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    joined = disk.join(known, F.col("path") == F.col("_p"), "left")
    hit = joined.where(F.col("_p").isNull() | (F.col("size") != F.col("_s")) | (F.col("mtime_ns") != F.col("_m")))
    return hit.withColumn("is_new", F.col("_p").isNull()).drop("_p", "_s", "_m")


def upsert(old: DataFrame, new: DataFrame, vanished: DataFrame | None = None) -> DataFrame:
    """Rows of old of paths that are neither in new nor vanished, and the rows of new."""
    kept = old.join(new.select("path").distinct(), "path", "left_anti")
    if vanished is not None:
        kept = kept.join(vanished.select("path"), "path", "left_anti")
    return kept.unionByName(new)


def freshness(paths: DataFrame, disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, stale) of the different paths asked for: stale if the index lacks one, the disk does, or size or time differ.

    Both sides are cut to these paths before they meet."""
    asked = paths.select("path").distinct()
    known = indexed.join(asked, "path", "left_semi").select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    now = disk.join(asked, "path", "left_semi").select("path", "size", "mtime_ns")
    both = asked.join(known, "path", "left").join(now, "path", "left")
    same = (F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m"))
    return both.select("path", (~F.coalesce(same, F.lit(False))).alias("stale"))


def stale_count(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """(stale, files): indexed files that the disk lacks or has with another size or time."""
    return freshness(indexed, disk, indexed).agg(F.count_if("stale").alias("stale"), F.count("*").alias("files"))


def reindex(old: DataFrame, disk: DataFrame, paths: DataFrame, extract) -> DataFrame:
    """Rows of old with those of the given paths made anew by ``extract`` from what is on disk; rows of paths that are gone go."""
    asked = paths.select("path").distinct()
    return upsert(old, extract(disk.join(asked, "path", "left_semi")), vanished(asked, disk))


def open_index(spark: SparkSession, *places: str) -> DataFrame | None:
    """The table at the first place that holds one that can be read."""
    for place in places:
        try:
            table = spark.read.parquet(place)
        except Exception as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            continue
        return table
    return None


class Lock:
    """One writer at a time, by a file that only one can create. One older than ``stale`` seconds is taken over; if the
    file can't be made for another reason, work goes on without (``held`` tells)."""

    def __init__(self, spark: SparkSession, path: str, stale: int = 300):
        self.spark, self.stale, self.held = spark, stale, False
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def acquire(self) -> bool:
        """False if another writer holds the lock."""
        for _ in range(2):
            try:
                self.fs.create(self.path, False).close()
                self.held = True
                return True
            except Exception:
                if not self.fs.exists(self.path):
                    return True
            if time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000 < self.stale:
                return False
            self.fs.delete(self.path, False)
        return False

    def release(self) -> None:
        if self.held:
            self.fs.delete(self.path, False)
            self.held = False


def vanished(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    return indexed.join(disk.select("path"), "path", "left_anti")


def submodule_paths(gitmodules: DataFrame) -> DataFrame:
    """path of each submodule declared in lines (value) of .gitmodules: inside the tree, not absolute."""
    line = F.trim("value")
    rows = gitmodules.where(~line.rlike("^[#;]") & line.contains("=")).select(F.trim(F.substring_index(line, "=", 1)).alias("k"), F.trim(F.expr("substring(trim(value), instr(trim(value), '=') + 1)")).alias("path"))
    inside = (F.col("path") != "") & ~F.col("path").rlike(r"^[/\\]|^.:") & ~F.exists(F.split("path", r"[/\\]"), lambda p: p == "..")
    return rows.where((F.col("k") == "path") & inside).select("path")


def crate_names(manifests: DataFrame) -> DataFrame:
    """name of each package declared in lines (value) of manifests, dashes made underscores."""
    name = F.regexp_extract(F.trim("value"), r'^name\s*=\s*"*([^"]*)"*\s*$', 1)
    return manifests.select(F.replace(name, F.lit("-"), F.lit("_")).alias("name")).where("name <> ''").distinct()


def manifests(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """(path, value): the lines of the manifests (Cargo.toml) at most ``depth`` steps below root, outside of folders that are never indexed. Other
    files aren't read."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "Cargo.toml").text(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    rel = F.substring_index(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/"), base, -1)
    rows = lines.select(rel.alias("path"), "value")
    parts = F.split("path", "/")
    return rows.where((F.size(parts) <= depth) & ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*sorted(EXCLUDED_DIRS)) | p.startswith(".")))


def storage_bytes(spark: SparkSession, root: str) -> DataFrame:
    """bytes: the size of all files below root, from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
