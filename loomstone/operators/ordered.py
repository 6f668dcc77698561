"""Scans over a whole project's order: positions, running sums, runs of neighbours and budgets without one task that sees all rows.

``Ordered`` deals the rows into ranges of their order and numbers them. What crosses the ranges is one row for each: its
totals and its first and last keys. These few rows (their number is a setting, not a size of the data) are added up on the
driver; every range then only needs what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import est_tokens
from ..plans.shared import Steps


class Ordered:
    """rows in the order of ``order``, with ``_id`` that grows along it. Equal rows may stand in any order; give an order without ties."""

    def __init__(self, rows: DataFrame, order: list, step: Steps | None = None, ranges: int | None = None):
        self.spark = rows.sparkSession
        self.step = step or Steps(self.spark)
        n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        # The id's upper bits are the range, the lower ones the row in it.
        self.rows = self.step(dealt.withColumn("_id", F.monotonically_increasing_id()), "ordered")

    _part = staticmethod(lambda: F.shiftright("_id", 33))

    def _offsets(self, totals: list) -> DataFrame:
        """(_part, _before) of (range, total) pairs."""
        out, sum_ = [], 0
        for part, total in sorted(totals):
            out.append((part, sum_))
            sum_ += total
        return self.spark.createDataFrame(out, "_part long, _before long")

    def running(self, value: Column, name: str) -> DataFrame:
        """The rows with the sum of ``value`` up to and with each of them."""
        marked = self.rows.withColumn("_part", self._part()).withColumn(name, value.cast("long"))
        totals = [tuple(r) for r in marked.groupBy("_part").agg(F.sum(name)).collect()]  # one row for each range
        inside = F.sum(name).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
        summed = marked.withColumn(name, inside).join(F.broadcast(self._offsets(totals)), "_part")  # one row for each range
        return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")

    def positions(self, name: str = "pos") -> DataFrame:
        """The rows with their place in the whole order, from 1."""
        return self.running(F.lit(1), name)

    def runs(self, same: list[str]) -> DataFrame:
        """The rows with ``_run``, equal for neighbours with equal ``same``, across ranges too, and growing along the order."""
        marked = self.rows.withColumn("_part", self._part()).withColumn("_key", F.struct(*same))
        ends = marked.groupBy("_part").agg(F.min_by("_key", "_id").alias("f"), F.max_by("_key", "_id").alias("l")).collect()  # one row for each range
        new, last = [], None
        for r in sorted(ends, key=lambda r: r["_part"]):
            new.append((r["_part"], last is None or r["f"] != last))
            last = r["l"]
        borders = F.broadcast(self.spark.createDataFrame(new, "_part long, _opens boolean"))
        prior = F.lag("_key").over(Window.partitionBy("_part").orderBy("_id"))
        first = F.row_number().over(Window.partitionBy("_part").orderBy("_id")) == 1
        begun = marked.join(borders, "_part").withColumn("_new", F.when(first, F.col("_opens")).otherwise(~prior.eqNullSafe(F.col("_key"))).cast("long"))
        totals = self.step(begun.drop("_opens", "_key"), "begun")
        offsets = self._offsets([tuple(r) for r in totals.groupBy("_part").agg(F.sum("_new")).collect()])
        inside = F.sum("_new").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
        return totals.withColumn("_run", inside).join(F.broadcast(offsets), "_part").withColumn("_run", F.col("_run") + F.col("_before")).drop("_part", "_before", "_new")

    def within(self, cost: Column, budget: int) -> DataFrame:
        """The rows before the first whose cost, added to those of all rows before it, exceeds the budget (costs aren't negative)."""
        return self.running(cost, "_spent").where(F.col("_spent") <= budget).drop("_spent")


def collapsed(ordered: Ordered, same: list[str], least: int = 3) -> DataFrame:
    """The rows, those of runs of ``least`` or more as their first row alone, with ``run``, the number of rows that each stands for (1 in shorter ones)."""
    runs = ordered.step(ordered.runs(same), "runs")
    # Long runs are partial sums before they meet; only their first rows stay.
    long = runs.groupBy("_run").agg(F.count("*").alias("run"), F.min("_id").alias("_first")).where(F.col("run") >= least)
    marked = runs.join(long, "_run", "left")
    return marked.where(F.col("run").isNull() | (F.col("_id") == F.col("_first"))).withColumn("run", F.coalesce("run", F.lit(1))).drop("_run", "_first")


def tree_rank(fan: DataFrame, budget: int = 2000, ranges: int | None = None) -> DataFrame:
    """(pos, fan_in, kind, name, symbol, path, start_line, end_line, run) of top-level symbols (path, name, qualified, kind, start_line, end_line, fan_in) by falling
    fan-in, names together; three or more neighbours of one name, kind and fan-in are one row; as many rows as a budget of tokens holds.

    Modules of a single line are left out."""
    rows = fan.where("not (kind = 'mod' and start_line = end_line)")
    order = [F.desc("fan_in"), "name", "path", "start_line", "qualified"]
    first = Ordered(rows, order, ranges=ranges)
    lines = collapsed(first, ["fan_in", "name", "kind"])
    said = F.when(F.col("run") >= 3, F.concat(F.lpad(F.col("fan_in").cast("string"), F.greatest(F.lit(4), F.length(F.col("fan_in").cast("string"))), F.lit(" ")), F.lit("×  "), "kind", F.lit(" "), "name", F.lit("  (×"), F.col("run").cast("string"), F.lit(" files)\n")))
    said = said.otherwise(F.concat(F.lpad(F.col("fan_in").cast("string"), F.greatest(F.lit(4), F.length(F.col("fan_in").cast("string"))), F.lit(" ")), F.lit("×  "), "kind", F.lit(" "), "qualified", F.lit("  "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n")))
    again = Ordered(lines.drop("_id").withColumn("_cost", est_tokens(F.octet_length(said))), order, first.step, ranges)
    kept = Ordered(again.within(F.col("_cost"), budget).drop("_id"), order, first.step, 1 if ranges is None else ranges)
    return kept.positions().select("pos", "fan_in", "kind", "name", F.col("qualified").alias("symbol"), "path", "start_line", "end_line", "run")
