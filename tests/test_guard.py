"""The stateful read policy: its rules, the stream against the windows, and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import usage
from loomstone.streaming import guard

SCHEMA = "session string, seq long, path string, partial boolean, is_code boolean, indexed boolean, in_repo boolean, lines int, callable boolean"


def batch(spark, rows, every=25):
    got = usage.session_policy(guard.decided(spark.createDataFrame(rows, SCHEMA)), every).collect()
    return {(r.session, r.seq): (r.action, r.reads, r.calls, r.remind) for r in got}


def event(k, path, lines=50, partial=False, indexed=True, code=True, callable_=True, repo=True, session="s"):
    return (session, k, path, partial, code, indexed, repo, lines, callable_)


def test_rules(spark):
    said = lambda rows, **more: [v[0] for _, v in sorted(batch(spark, rows, **more).items())]
    # A first redirect denies, the second goes through with advice, and then the path counts as read.
    assert said([event(1, "a", 900), event(2, "a", 900), event(3, "a", 50), event(4, "b", 900)]) == ["deny", "advise", "advise", "deny"]
    # A denied read isn't a read.
    assert said([event(1, "a", 900), event(2, "a", 50)]) == ["deny", "allow"]
    # Advised reads mark the path but don't count towards the streak.
    rows = [event(1, "a"), event(2, "b"), event(3, "m", 200), event(4, "c"), event(5, "a"), event(6, "d")]
    assert said(rows) == ["allow", "allow", "advise", "allow", "advise", "streak"]
    # Neither do slices, files that aren't code or can't be called.
    assert said([event(1, "a", partial=True), event(2, "a", partial=True), event(3, "a", partial=True), event(4, "a"), event(5, "t", code=False, callable_=False)]) == ["allow", "allow", "slices", "allow", "allow"]
    # The hint comes at first, and after every tenth that was held back.
    hints = said([event(k, f"p{k}", 900, indexed=False) for k in range(23)])
    assert [k for k, x in enumerate(hints) if x == "nudge"] == [0, 10, 20] and set(hints) == {"nudge", "allow"}
    assert [v[3] for _, v in sorted(batch(spark, [event(k, "a") for k in range(1, 7)], 3).items())] == [False, False, True, False, False, True]
    assert not any(v[3] for v in batch(spark, [event(1, "a")], 0).values())


def test_stream_equals_windows_over_restarts(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"s{r.randrange(3)}", k, f"p{r.randrange(5)}", r.random() < 0.25, r.random() < 0.9, r.random() < 0.7, r.random() < 0.9, r.choice([20, 150, 900]), r.random() < 0.9) for k in range(180)]
    source = spark.createDataFrame(rows, SCHEMA)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, guard.ROCKS)
    try:
        for lo, hi in ((0, 60), (60, 61), (61, 180)):  # three runs: what one leaves is the next one's state
            source.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = guard.guard(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 7)
            q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out"))
            assert q.awaitTermination(240)
    finally:
        spark.conf.set(key, before)
    got = {(x.session, x.seq): (x.action, x.reads, x.calls, x.remind) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = batch(spark, rows, 7)
    assert got == want and {v[0] for v in want.values()} >= {"deny", "advise", "streak", "slices", "nudge", "allow"}
