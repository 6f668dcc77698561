"""Projects, notes, settings and the usage log: appends, lookups, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import is_ephemeral
from ..functions.text import name_tail

# Seconds between two rounds of upkeep.
TIDY_EVERY = 86_400


# Projects (hash, path, files, symbols, last_indexed) ---------------------------------------------------------------------


def totals(projects: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return projects.agg(F.count("*").alias("projects"), zero("files"), zero("symbols"))


def listing(projects: DataFrame) -> DataFrame:
    """The latest indexed first."""
    return projects.orderBy(F.desc("last_indexed"), "path")


def paths(projects: DataFrame) -> DataFrame:
    return projects.select("path").orderBy("path")


def orphans(projects: DataFrame, existing: DataFrame, purge: bool = False, temporary: tuple[str, ...] = ()) -> DataFrame:
    """Projects whose path isn't among the existing ones: those in folders for temporary files, or all with ``purge``."""
    gone = projects.join(existing.select("path").distinct(), "path", "left_anti")
    return gone if purge else gone.where(is_ephemeral(F.col("path"), temporary))


def forget(projects: DataFrame, usage: DataFrame, notes: DataFrame, gone: DataFrame, keep_stats: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """projects, usage and notes (project, ...) without the projects gone (path); usage stays with ``keep_stats``, notes never do."""
    names = gone.select("path").distinct()
    without = lambda rows, c: rows.join(names.withColumnRenamed("path", c), c, "left_anti").select(*rows.columns)
    return without(projects, "path"), usage if keep_stats else without(usage, "project"), without(notes, "project")


# Index -------------------------------------------------------------------------------------------------------------------


def index_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(files, symbols) in one row: two counts that never meet in a join of rows."""
    tagged = files.select(F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(symbols.select(F.lit(0).alias("f"), F.lit(1).alias("s")))
    return tagged.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"))


def has_files(files: DataFrame) -> bool:
    return not files.limit(1).isEmpty()


def syntax_totals(checked: DataFrame) -> DataFrame:
    """(errors, files) of files checked (path, errors array<...>)."""
    return checked.agg(F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.count("*").alias("files"))


def line_width(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, width): a file's size over the last line that a symbol of it reaches; 0 lines count as one."""
    last = symbols.groupBy("path").agg(F.max("end_line").alias("last"))
    return files.join(last, "path").select("path", F.floor(F.col("size") / F.greatest("last", F.lit(1))).cast("long").alias("width"))


# Notes (id, symbol, note, ts) --------------------------------------------------------------------------------------------


def note_add(notes: DataFrame, symbol: str, note: str, ts: int) -> DataFrame:
    """notes and one more, with the next id."""
    new = notes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select("id", F.lit(symbol).alias("symbol"), F.lit(note).alias("note"), F.lit(ts).cast("long").alias("ts"))
    return notes.select("id", "symbol", "note", "ts").unionByName(new)


def note_remove(notes: DataFrame, ids: list[int]) -> DataFrame:
    return notes.where(~F.col("id").isin(ids))


def notes_all(notes: DataFrame) -> DataFrame:
    return notes.orderBy("symbol", "ts", "id")


def notes_for(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """symbols (symbol, ...) with id, note and ts of the notes for them: an equal key, or an equal last part of the name.

    Equal keys have equal last parts, so one equi-join on these finds both."""
    n = notes.select(F.col("id"), F.col("symbol").alias("noted"), "note", "ts", name_tail(F.col("symbol")).alias("_tail"))
    return symbols.withColumn("_tail", name_tail(F.col("symbol"))).join(n, "_tail").drop("_tail")


# Settings (key, value) ---------------------------------------------------------------------------------------------------


def meta_set(meta: DataFrame, key: str, value: str) -> DataFrame:
    new = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta_delete(meta, key).unionByName(new)


def meta_delete(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") != key)


def meta_get(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).first()
    return row["value"] if row else None


def tidy_due(meta: DataFrame, now: int) -> bool:
    """Whether the last round of upkeep is a day ago; an unreadable time counts as never."""
    last = meta_get(meta, "last_tidy") or ""
    return now - (int(last) if last.lstrip("-").isdigit() else 0) >= TIDY_EVERY


# Usage -------------------------------------------------------------------------------------------------------------------


def log(usage: DataFrame, events: DataFrame) -> DataFrame:
    """usage and the events (ts, project, cmd, ms, results, tokens_out, tokens_saved, detail), with ids after the last.

    Savings below 0 count 0, a null detail is "". Ids rise but may leave gaps, so no task numbers all events."""
    last = usage.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    rows = events.withColumn("tokens_saved", F.greatest("tokens_saved", F.lit(0))).withColumn("detail", F.coalesce("detail", F.lit(""))).withColumn("_k", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(last), F.lit(True)).withColumn("id", F.col("last") + 1 + F.col("_k"))  # one row
    return usage.unionByName(rows.select(*usage.columns))


# Listings ----------------------------------------------------------------------------------------------------------------


def with_headers(rows: DataFrame, order: list) -> DataFrame:
    """rows (path, ...) with ``header``: whether a row is the first of its path in the order within it."""
    return rows.withColumn("header", F.row_number().over(Window.partitionBy("path").orderBy(*order)) == 1)


def top_symbols(symbols: DataFrame, limit: int) -> DataFrame:
    """The longest symbols, earlier ones first among equals."""
    return symbols.orderBy(F.desc(F.col("end_line") - F.col("start_line")), "start_line", "path", "ord").limit(limit)


def sorted_commands(per_command: DataFrame, by: str = "tokens_saved") -> DataFrame:
    """Commands by what they saved, how often they ran or how long they took."""
    if by not in ("tokens_saved", "calls", "avg_ms"):
        raise ValueError(by)
    return per_command.orderBy(F.desc(by), "cmd")
