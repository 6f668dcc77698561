"""Analytics and upkeep of the usage log (id, ts, project, cmd, ms, results, tokens_out, tokens_saved, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import NUDGE_EVERY, PARTIAL_STREAK, READ_STREAK, fires, is_maintenance

# Retention.
KEEP_SECONDS, KEEP_ROWS = 90 * 86_400, 200_000


def scoped(usage: DataFrame, project=None) -> DataFrame:
    return usage if project is None else usage.where(F.col("project") == project)


def totals(usage: DataFrame, *by: str) -> DataFrame:
    """calls, tokens_out, tokens_saved, ms, blocks, baseline, pct_saved in one row, or in one for each value of ``by``."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = usage.groupBy(*by).agg(F.count("*").alias("calls"), s("tokens_out"), s("tokens_saved"), s("ms"), F.count_if(F.col("cmd").like("hook:%-block")).alias("blocks"))
    t = t.withColumn("baseline", F.col("tokens_out") + F.col("tokens_saved"))
    return t.withColumn("pct_saved", F.when(F.col("baseline") <= 0, 0.0).otherwise(F.round(100.0 * F.col("tokens_saved") / F.col("baseline"), 6)))


def per_command(usage: DataFrame) -> DataFrame:
    return usage.groupBy("cmd").agg(F.count("*").alias("calls"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens_saved").alias("tokens_saved"))


def top_targets(usage: DataFrame, limit: int) -> DataFrame:
    rows = usage.where("detail <> ''").groupBy("detail").agg(F.count("*").alias("calls"), F.sum("tokens_saved").alias("tokens_saved"))
    return rows.orderBy(F.desc("calls"), F.desc("tokens_saved"), "detail").limit(limit)


def recent(usage: DataFrame, limit: int, queries_only: bool = True) -> DataFrame:
    rows = usage.where(~is_maintenance(F.col("cmd"))) if queries_only else usage
    return rows.orderBy(F.desc("id")).limit(limit)


def tidy(usage: DataFrame, now: int, keep_seconds: int = KEEP_SECONDS, keep_rows: int = KEEP_ROWS, projects: DataFrame | None = None) -> DataFrame:
    """What upkeep leaves: rows young enough, of them the newest by id, of them those of known projects.

    The id at which the row cap cuts comes from a top-k, not from numbering every row in one task.
    """
    young = usage.where(F.col("ts") >= now - keep_seconds)
    cut = young.select("id").orderBy(F.desc("id")).limit(keep_rows).agg(F.min("id").alias("least"))
    kept = young.join(F.broadcast(cut), F.col("id") >= F.col("least"), "left_semi")
    return kept if projects is None else kept.join(projects, "project", "left_semi")


def last_write_wins(rows: DataFrame, key: list[str], order) -> DataFrame:
    """One row for each key, the newest."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def rereads(log: DataFrame) -> DataFrame:
    """log (session, path, seq, ...) with nth (the how manieth read of the path) and reread."""
    w = Window.partitionBy("session", "path").orderBy("seq")
    return log.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("reread", F.col("nth") > 1)


def streaks(log: DataFrame, every: int) -> DataFrame:
    """log with count (reads of the session so far, re-reads not counted) and fires on every so manieth."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = rereads(log).withColumn("count", F.sum((~F.col("reread")).cast("long")).over(w))
    return n.withColumn("fires", ~F.col("reread") & (F.col("count") % every == 0) & (F.col("count") > 0))


def cadence(log: DataFrame, every: int) -> DataFrame:
    """log (session, seq, ...) with nth (the how manieth event of the session) and fires on every so manieth."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    return log.withColumn("nth", n).withColumn("fires", fires(F.col("nth"), every))


def session_policy(decided: DataFrame, every: int = 25) -> DataFrame:
    """decided (session, seq, path, partial, tracked, fresh, again: see streaming.guard) with action, reads, calls and remind, as the stream gives them.

    A redirect doesn't depend on earlier reads, so running values by path and by session say all: whether the path was denied before, whether a
    read of it went through before, and then how many unadvised ones did."""
    path, session = Window.partitionBy("session", "path").orderBy("seq"), Window.partitionBy("session").orderBy("seq")
    before = path.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    redirect = ~F.col("partial") & (F.col("fresh") == "redirect")
    rows = decided.withColumn("_red", redirect).withColumn("_denied", F.coalesce(F.max("_red").over(before), no))
    through = ~F.col("partial") & F.col("tracked") & (F.col("fresh").isin("allow", "advise") | (F.col("_red") & F.col("_denied")))
    rows = rows.withColumn("_through", through).withColumn("_seen", F.coalesce(F.max("_through").over(before), no))
    rows = rows.withColumn("_say", F.when(F.col("partial"), "slice").when(F.col("tracked") & F.col("_seen"), F.col("again")).otherwise(F.col("fresh")))
    counted = (F.col("_say") == "allow") & F.col("tracked")
    rows = rows.withColumn("_slices", F.sum(F.col("partial").cast("long")).over(upto(path))).withColumn("reads", F.sum(counted.cast("long")).over(upto(session)))
    rows = rows.withColumn("_nudges", F.sum((F.col("_say") == "nudge").cast("long")).over(upto(session))).withColumn("calls", F.count("*").over(upto(session)))
    action = (
        F.when(F.col("partial"), F.when(fires(F.col("_slices"), PARTIAL_STREAK), "slices").otherwise("allow"))
        .when(F.col("_say") == "redirect", F.when(F.col("_denied"), "advise").otherwise("deny"))
        .when(F.col("_say") == "nudge", F.when((F.col("_nudges") == 1) | fires(F.col("_nudges") - 1, NUDGE_EVERY), "nudge").otherwise("allow"))
        .when(counted & fires(F.col("reads"), READ_STREAK), "streak")
        .otherwise(F.col("_say"))
    )
    out = rows.withColumn("action", action).withColumn("remind", fires(F.col("calls"), every))
    return out.select(*decided.columns, "action", "reads", "calls", "remind")


def expiry(log: DataFrame, ttl_seconds: float) -> DataFrame:
    """log (session, seq, ts, ...) with expired: a session's first event, or one whose predecessor is more than the time to live
    older, meets no state."""
    before = F.lag("ts").over(Window.partitionBy("session").orderBy("seq"))
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    return log.withColumn("expired", F.coalesce(age > ttl_seconds, F.lit(True)))
