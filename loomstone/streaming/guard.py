"""The whole read policy of a session as one stateful query: denials, advice, read streaks, slices, hints and reminders.

Events (session, seq, path, partial, is_code, indexed, in_repo, lines, callable), one for each read. State (Spark's transformWithState) is
a map by path (seen, slices, denied) and one row of counters for each session, both with a time to live of a week, so
idle sessions go by themselves, and a path costs an entry, not a read of the session's log:

- a first redirect of a path denies; later ones go through, advised. A denied read isn't recorded.
- a read that goes through marks its path as seen, so that the next one is a re-read; only those without advice count
  towards the streak, and every ``READ_STREAK``th of them says so.
- every ``PARTIAL_STREAK``th slice of a path says so. Slices are neither seen nor counted as reads.
- the hint that a project isn't indexed is due at first and after every ``NUDGE_EVERY`` suppressed ones.
- every call counts for the reminder, due at every ``every`` of them.

``operators.usage.session_policy`` is the same over a table, by windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.policy import NUDGE_EVERY, PARTIAL_STREAK, READ_STREAK, decide_read

TTL_MS = 7 * 86_400_000
OUT = "session string, seq long, path string, action string, reads long, calls long, remind boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided(events: DataFrame) -> DataFrame:
    """events with what the policy says of a new path (``fresh``) and of a re-read (``again``), and whether reads are tracked."""
    facts = [F.col(c) for c in ("partial", "is_code", "indexed", "in_repo", "lines", "callable")]
    return events.select("session", "seq", "path", "partial", (F.col("indexed") & F.col("callable")).alias("tracked"), decide_read(*facts, F.lit(False)).alias("fresh"), decide_read(*facts, F.lit(True)).alias("again"))


class Guard(StatefulProcessor):
    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "seen boolean, slices long, denied boolean", TTL_MS)
        self.counts = handle.getValueState("counts", "calls long, reads long, nudges long", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, reads, nudges = self.counts.get() if self.counts.exists() else (0, 0, 0)
        held: dict[str, list] = {}
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if e.path not in held:
                held[e.path] = list(self.paths.getValue((e.path,))) if self.paths.containsKey((e.path,)) else [False, 0, False]
            state, action, calls = held[e.path], "allow", calls + 1
            if e.partial:
                state[1] += 1
                action = "slices" if state[1] % PARTIAL_STREAK == 0 else "allow"
            else:
                decision = e.again if e.tracked and state[0] else e.fresh
                if decision == "redirect":
                    action, state[2], again = "advise" if state[2] else "deny", True, state[2]
                    state[0] |= bool(e.tracked and again)
                elif decision == "nudge":
                    nudges += 1
                    action = "nudge" if nudges == 1 or (nudges - 1) % NUDGE_EVERY == 0 else "allow"
                else:
                    action = decision
                    state[0] |= bool(e.tracked)
                    if decision == "allow" and e.tracked:
                        reads += 1
                        action = "streak" if reads % READ_STREAK == 0 else "allow"
            out.append((key[0], e.seq, e.path, action, reads, calls, self.every > 0 and calls % self.every == 0))
        for path, state in held.items():
            self.paths.updateValue((path,), (bool(state[0]), int(state[1]), bool(state[2])))
        self.counts.update((int(calls), int(reads), int(nudges)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def guard(events: DataFrame, every: int = 25) -> DataFrame:
    """(session, seq, path, action, reads, calls, remind) of a stream of events. Needs the RocksDB state store (``ROCKS``) in the session.

    The time to live keeps asking for batches without data: end a run with trigger(once=True), not availableNow."""
    return decided(events).groupBy("session").transformWithStateInPandas(Guard(every), OUT, "Append", "ProcessingTime")
