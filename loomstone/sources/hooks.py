"""Tool events as JSON lines, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "tool_name string, tool_input struct<file_path:string,path:string,pattern:string,command:string,offset:long,limit:long,output_mode:string>, cwd string, session_id string"


def payloads(lines: DataFrame, *keep: str) -> DataFrame:
    """(tool_name, tool_input, cwd, session_id, valid) of lines (value), one JSON object each, and the columns to keep; broken
    lines have nulls."""
    parsed = lines.select(*keep, F.from_json("value", PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"), "value")
    return parsed.select(*keep, "p.*", F.coalesce(F.is_valid_utf8("value") & F.expr("try_parse_json(value) is not null") & F.col("p.tool_name").isNotNull(), F.lit(False)).alias("valid"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads of files that appear in a folder, as a stream."""
    return payloads(spark.readStream.format("text").load(folder))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def structured(rows: DataFrame, under: str, limit: int = 1000) -> DataFrame:
    """(value): one JSON object with the first ``limit`` rows in a list under a name, as tools return results."""
    first = rows.limit(limit)  # a result for display; what is longer stays a table
    return first.agg(F.collect_list(F.struct(*rows.columns)).alias("r")).select(F.to_json(F.struct(F.col("r").alias(under))).alias("value"))
