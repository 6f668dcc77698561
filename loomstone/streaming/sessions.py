"""Session policies over a stream of tool events, with the state that they need.

Events (session, path, seq, partial, redirect): redirect says that the read policy would send a whole read elsewhere.
State is kept for each path of a session (three counters) and for each session (one), so it has a fixed size for each
key, and ends a week after the key's last event. A first redirect of a path denies, later ones advise; every so manieth
new read of a session and slice of a path fires. The same as expressions over windows is in operators.usage, against
which the tests hold these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.policy import PARTIAL_STREAK, READ_STREAK, decide_read

TTL_MS = 7 * 86_400_000
PATHS = "session string, path string, seq long, partial boolean, nth long, reread boolean, denied boolean"
OUT = PATHS + ", count long, fires boolean"


def _path_step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    whole, slices, redirects = state.get if state.exists else (0, 0, 0)
    rows = []
    for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        slices, whole = slices + bool(e.partial), whole + (not e.partial)
        first = bool(e.redirect) and not redirects
        redirects += bool(e.redirect)
        rows.append((*key, e.seq, bool(e.partial), slices if e.partial else whole, not e.partial and whole > 1, first))
    state.update((whole, slices, redirects))
    state.setTimeoutDuration(TTL_MS)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATHS.split(", ")])


def _session_step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    (count,) = state.get if state.exists else (0,)
    events = pd.concat(list(batches)).sort_values("seq")
    new = ~events["partial"] & ~events["reread"]
    events["count"] = count + new.cumsum()
    events["fires"] = (new & (events["count"] % READ_STREAK == 0)) | (events["partial"] & (events["nth"] % PARTIAL_STREAK == 0))
    state.update((int(events["count"].iloc[-1]),))
    state.setTimeoutDuration(TTL_MS)
    yield events[[c.split()[0] for c in OUT.split(", ")]]


def by_path(events: DataFrame) -> DataFrame:
    """The events numbered within their paths."""
    redirect = F.col("redirect") if "redirect" in events.columns else F.lit(False)
    rows = events.select("session", "path", "seq", "partial", redirect.alias("redirect"))
    return rows.groupBy("session", "path").applyInPandasWithState(_path_step, PATHS, "whole long, slices long, redirects long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def by_session(numbered: DataFrame) -> DataFrame:
    """What ``by_path`` gives, with the session's count of new reads and what fires."""
    return numbered.groupBy("session").applyInPandasWithState(_session_step, OUT, "count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def track(events: DataFrame, folder: str, out: str, **trigger):
    """Start both steps: one query can't hold two such states, so a table in folder lies between them. Returns both queries.

    With once=True the first ends before the second starts, so it sees all of it."""
    spark = events.sparkSession
    first = by_path(events).writeStream.format("parquet").option("checkpointLocation", f"{folder}/paths.state").trigger(**trigger).start(f"{folder}/paths")
    if trigger.get("once"):
        first.awaitTermination(600)
    numbered = spark.readStream.schema(PATHS).parquet(f"{folder}/paths")
    return first, by_session(numbered).writeStream.format("parquet").option("checkpointLocation", f"{folder}/sessions.state").trigger(**trigger).start(out)


def decide(events: DataFrame, reread) -> DataFrame:
    """events with the read policy's decision; a pure expression, so batch and stream share it."""
    facts = [F.col(c) for c in ("partial", "is_code", "indexed", "in_repo", "lines", "callable")]
    return events.withColumn("decision", decide_read(*facts, reread))


def with_redirect(events: DataFrame) -> DataFrame:
    """events with redirect: whether the read policy redirects them, which doesn't depend on earlier reads."""
    return decide(events, F.lit(False)).withColumn("redirect", F.col("decision") == "redirect").drop("decision")
