"""Keeping the symbol table of a source tree up to date: new, changed and deleted files at every trigger.

A file source tells of new files only, so each trigger lists the tree (metadata alone) and compares it with what is
indexed. Only buckets of paths that changed are written, into new folders; then a small file that names each bucket's
folder appears as the next version by one rename. The number of buckets doubles as the tree grows, when all are written once anew, so a changed file
costs a bounded number of rows whatever the tree's size. So a reader sees the old or the new table, and a crash leaves the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete
from ..sources import extract
from ..sources.index import Lock, changed, rules_of, scan, texts, vanished

#: Buckets of a small tree, and files of a bucket beyond which their number doubles.
BUCKETS, PER_BUCKET = 64, 512
STATE = "path string, size long, mtime_ns long, bucket int"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, table: str) -> list[str]:
    where, fs = _fs(spark, f"{table}/versions")
    if not fs.exists(where):
        return []
    return sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))


def current(spark: SparkSession, table: str) -> dict[str, dict[str, str]]:
    """The folders of the buckets, of files and of symbols; empty before the first run."""
    if not (known := _versions(spark, table)):
        return {"files": {}, "symbols": {}}
    return json.loads("".join(r.value for r in spark.read.text(f"{table}/versions/{known[-1]}").collect()))


def _publish(spark: SparkSession, table: str, now: dict) -> None:
    """The next version's file, by a rename; the last few stay for readers that have just looked."""
    known = _versions(spark, table)
    number = int(known[-1].split(".")[0]) + 1 if known else 1
    aside, fs = _fs(spark, f"{table}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    if not fs.rename(aside, _fs(spark, f"{table}/versions/{number:012d}.json")[0]):
        raise RuntimeError("another writer was faster")
    for old in known[:-2]:
        delete(spark, f"{table}/versions/{old}")


def read(spark: SparkSession, table: str, part: str = "symbols") -> DataFrame | None:
    """The symbols, or the files (path, size, mtime_ns), as they are; None before the first run. Also for polling."""
    folders = current(spark, table)[part]
    return spark.read.parquet(*[f"{table}/{f}" for f in sorted(set(folders.values()))]) if folders else None


def refresh(spark: SparkSession, root: str, table: str) -> int:
    """Bring the table up to date; how many files were new, changed or gone. One writer at a time; another one returns 0.

    A local tree's ignore rules hold as they are now, so files that become ignored count as gone."""
    lock = Lock(spark, f"{table}/LOCK")
    if not lock.acquire():
        return 0
    try:
        now = current(spark, table)
        size = {"buckets": BUCKETS, "count": 0} | now.get("size", {})
        of = lambda n: F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")
        bucket = of(size["buckets"])
        local = "://" not in root or root.startswith("file://")
        disk = scan(spark, root, rules=rules_of(root) if local else None).withColumn("bucket", bucket)
        known = read(spark, table, "files")
        if known is not None and "size" not in now:
            size["count"] = known.count()
        known = spark.createDataFrame([], STATE) if known is None else known
        listed = disk.select("path", "size", "mtime_ns", "bucket")
        work = changed(listed, known).select("path", "bucket", F.lit(False).alias("gone"), F.col("is_new").cast("int").alias("more")).unionByName(vanished(known, listed).select("path", bucket.alias("bucket"), F.lit(True).alias("gone"), F.lit(-1).alias("more")))
        work = work.persist()
        try:
            touched = sorted(r[0] for r in work.select("bucket").distinct().collect())  # at most the number of buckets
            if not touched:
                return 0
            here = F.col("bucket").isin(touched)
            size["count"] += work.agg(F.sum("more")).first()[0]
            regrown = size["count"] > size["buckets"] * PER_BUCKET
            if regrown:
                while size["count"] > size["buckets"] * PER_BUCKET // 2:
                    size["buckets"] *= 2
                bucket, here, touched = of(size["buckets"]), F.lit(True), list(range(size["buckets"]))
                listed = listed.withColumn("bucket", bucket)
            new = texts(disk.where(here).join(work.where("not gone").select("path"), "path", "left_semi"))
            symbols = extract.symbols(new.drop("bucket")).withColumn("bucket", bucket)
            old = read(spark, table)
            if old is not None:
                symbols = old.where(here).withColumn("bucket", bucket).join(work.select("path"), "path", "left_anti").select(*symbols.columns).unionByName(symbols)
            version, replaced = uuid.uuid4().hex, set()
            for part, rows in (("files", listed.where(here)), ("symbols", symbols)):
                rows.withColumn("part", F.col("bucket")).write.partitionBy("part").parquet(f"{table}/{part}-{version}")
                where, fs = _fs(spark, f"{table}/{part}-{version}")
                there = {n.removeprefix("part=") for x in fs.listStatus(where) if (n := x.getPath().getName()).startswith("part=")}
                written = {k: f"{part}-{version}/part={k}" for k in map(str, touched) if k in there}
                replaced |= set(now[part].values()) if regrown else {now[part].pop(str(k), None) for k in touched} - {None}
                now[part] = {} if regrown else now[part]
                now[part].update(written)
            # Folders that this version replaces are deleted with the next one, so that readers can end.
            gone, now["before"], now["size"] = now.get("before", []), sorted(replaced), size
            found = work.count()
            _publish(spark, table, now)
            for folder in gone:
                delete(spark, f"{table}/{folder}")
            return found
        finally:
            work.unpersist()
    finally:
        lock.release()


def watch(spark: SparkSession, root: str, table: str, checkpoint: str, every: str = "300 milliseconds", once: bool = False):
    """Keep the table up to date at every trigger, a burst of changes at once; ``once`` refreshes and ends."""
    if once:
        refresh(spark, root, table)
        return None
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda batch, _: refresh(batch.sparkSession, root, table) and None
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
