"""The relations of a source tree, carried by the tables at hand, in Spark and as DuckDB SQL.

files := documents (path = source/lang/doc_id); symbols := blocks of ten lines (s0, s1, ...) that each hold
blocks of three (s0.b0, ...); idents := identifier tokens of the lines; commits := orders with their lineitems;
usage := events; call edges := supplier -> part pairs of lineitems; sources := parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line_signature, identifiers, lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "lang", F.octet_length("text").cast("long").alias("size"), "text")


def file_lines(spark, sf_dir) -> DataFrame:
    rows = files(spark, sf_dir).select("path", F.posexplode(lines(F.col("text"))).alias("p", "line"))
    return rows.select("path", (F.col("p") + 1).alias("ln"), "line")


def symbols(spark, sf_dir) -> DataFrame:
    """(path, name, qualified, kind, parent, start_line, end_line, signature, ord), built without leaving the row."""
    f = files(spark, sf_dir).select("path", "lang", lines(F.col("text")).alias("ls")).withColumn("n", F.size("ls")).where("n > 0")
    outer = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10).cast("int"))))
    block = outer.withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(2)))).withColumn("start_line", F.col("k") * 10 + 1 + F.when(F.col("j") > 0, F.col("j") * 3).otherwise(0))
    block = block.where("start_line <= n").withColumn("end_line", F.least("n", F.col("start_line") + F.when(F.col("j") < 0, 9).otherwise(2)))
    top, s = F.col("j") < 0, F.concat(F.lit("s"), F.col("k").cast("string"))
    name = F.when(top, s).otherwise(F.concat(F.lit("b"), F.col("j").cast("string")))
    kind = F.when(top, F.element_at(F.array(*map(F.lit, ("class", "struct", "fn"))), F.pmod("k", F.lit(3)) + 1)).when(F.pmod("j", F.lit(2)) == 0, "method").otherwise("const")
    return block.select(
        "path", "lang", name.alias("name"), F.when(top, s).otherwise(F.concat(s, F.lit("."), name)).alias("qualified"), kind.alias("kind"),
        F.when(~top, s).alias("parent"), "start_line", "end_line", first_line_signature(F.get("ls", F.col("start_line") - 1)).alias("signature"), (F.col("k") * 4 + F.col("j") + 1).alias("ord"),
    )


def idents(spark, sf_dir) -> DataFrame:
    return file_lines(spark, sf_dir).select("path", "ln", F.explode(identifiers(F.col("line"))).alias("name"))


def commit_files(spark, sf_dir) -> DataFrame:
    """(hash, author, ts, seq, path, adds, dels): seq orders orders from new to old."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    o = o.select(F.col("o_orderkey").alias("hash"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), ts.alias("ts"))
    l = l.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.floor("l_quantity").cast("long").alias("adds"), (F.col("l_linenumber") - 2).cast("long").alias("dels"), "l_linenumber")
    return l.join(o, "hash").withColumn("seq", F.struct(-F.col("ts"), -F.col("hash"), "l_linenumber")).drop("l_linenumber")


def usage(spark, sf_dir) -> DataFrame:
    """Errors are hook blocks and signups index runs, so that every class of command occurs."""
    e = table(spark, sf_dir, "events")
    cmd = F.when(F.col("event_type") == "error", "hook:read-block").when(F.col("event_type") == "signup", "index").otherwise(F.col("event_type"))
    tokens = F.floor(F.abs("value")).cast("long")
    detail = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    return e.select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("project"), cmd.alias("cmd"), F.pmod("event_id", F.lit(97)).alias("ms"), tokens.alias("tokens_out"), (tokens * 3).alias("tokens_saved"), detail.alias("detail"))


def edges(spark, sf_dir) -> DataFrame:
    """Directed edges (src, dst): a supplier's number points at the numbers of the parts that it ships, so low numbers lead on."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst").distinct()


def sources(spark, sf_dir) -> DataFrame:
    """Source files (path, lang, text) made of parts: each imports the file of another part in its language's ways."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    lang = F.element_at(F.array(*map(F.lit, ("rust", "python", "typescript"))), F.pmod(k, F.lit(3)).cast("int") + 1)
    ext = F.element_at(F.array(*map(F.lit, (".rs", ".py", ".ts"))), F.pmod(k, F.lit(3)).cast("int") + 1)
    folder = F.concat(F.lit("src/b"), F.regexp_extract("p_brand", "([0-9]+)", 1))
    other = s(k + 3 * F.col("p_size"))
    rust = F.concat(F.lit("use crate::"), F.lit("m"), other, F.lit("::{Item, self};\nuse serde::{\n    de::Error,\n};\nmod m"), other, F.lit(";\nfn f() {}\n"))
    python = F.concat(F.lit("import os, m"), other, F.lit("\nfrom .m"), other, F.lit(" import x\n"))
    script = F.concat(F.lit("import { x } from './m"), other, F.lit(".js'\nconst r = require(\"react\")\n"))
    text = F.when(lang == "rust", rust).when(lang == "python", python).otherwise(script)
    return p.select("p_partkey", F.concat(folder, F.lit("/m"), s(k), ext).alias("path"), lang.alias("lang"), text.alias("text"), folder.alias("folder"), other.alias("other"))


def reads(spark, sf_dir) -> DataFrame:
    """Session read log: (session, path, seq) from events of one user and their properties."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.coalesce("props", F.lit("")).alias("path"), F.struct("ts", "event_id").alias("seq"), "event_id")


SQL_FILES = "files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, lang, strlen(text)::BIGINT AS size, text FROM documents)"
SQL_LINES = f"{SQL_FILES}, fl AS (SELECT path, lang, string_split(text, chr(10)) AS l0 FROM files), fl1 AS (SELECT path, lang, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS ls FROM fl), lines AS (SELECT path, generate_subscripts(ls, 1)::INT AS ln, unnest(ls) AS line FROM fl1)"
SQL_SYMBOLS = f"""{SQL_LINES}, sy0 AS (SELECT path, lang, ls, len(ls) AS n, unnest(range(0, (len(ls) - 1) // 10 + 1)) AS k FROM fl1 WHERE len(ls) > 0),
sy1 AS (SELECT *, k * 10 + 1 + CASE WHEN j > 0 THEN j * 3 ELSE 0 END AS st FROM (SELECT *, unnest([-1, 0, 1, 2]) AS j FROM sy0)),
sy2 AS (SELECT *, trim(regexp_replace(trim(ls[st]), '\\{{$', '')) AS sg FROM sy1 WHERE st <= n),
symbols AS (SELECT path, lang, CASE WHEN j < 0 THEN 's' || k ELSE 'b' || j END AS name, CASE WHEN j < 0 THEN 's' || k ELSE 's' || k || '.b' || j END AS qualified,
  CASE WHEN j < 0 THEN ['class', 'struct', 'fn'][k % 3 + 1] WHEN j % 2 = 0 THEN 'method' ELSE 'const' END AS kind, CASE WHEN j >= 0 THEN 's' || k END AS parent,
  st::INT AS start_line, least(n, st + CASE WHEN j < 0 THEN 9 ELSE 2 END)::INT AS end_line, CASE WHEN length(sg) > 120 THEN sg[:120] || '…' ELSE sg END AS signature, (k * 4 + j + 1)::INT AS ord FROM sy2)"""
SQL_IDENTS = "idents AS (SELECT path, ln, name FROM (SELECT path, ln, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS name FROM lines) WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]+$'))"
SQL_COMMITS = "cf AS (SELECT l_orderkey AS hash, 'c' || o_custkey AS author, floor(epoch(o_orderdate))::BIGINT AS ts, l_partkey AS path, floor(l_quantity)::BIGINT AS adds, (l_linenumber - 2)::BIGINT AS dels, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SQL_USAGE = """usage AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS ts, user_id AS project, CASE event_type WHEN 'error' THEN 'hook:read-block' WHEN 'signup' THEN 'index' ELSE event_type END AS cmd,
  event_id % 97 AS ms, floor(abs(value))::BIGINT AS tokens_out, floor(abs(value))::BIGINT * 3 AS tokens_saved, CASE WHEN event_type = 'view' THEN '' ELSE props END AS detail FROM events)"""
SQL_EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey)"
SQL_SOURCES = """src AS (SELECT p_partkey, ['rust', 'python', 'typescript'][p_partkey % 3 + 1] AS lang, 'src/b' || regexp_extract(p_brand, '([0-9]+)', 1) AS folder, ['.rs', '.py', '.ts'][p_partkey % 3 + 1] AS ext, (p_partkey + 3 * p_size)::VARCHAR AS other FROM part),
files AS (SELECT folder || '/m' || p_partkey || ext AS path, lang, folder, ext, other FROM src),
specs AS (SELECT path AS importer, lang, folder, ext, other, unnest(CASE lang WHEN 'rust' THEN ['crate::m' || other || '::Item', 'crate::m' || other, 'serde::de::Error', 'serde', 'mod:m' || other]
  WHEN 'python' THEN ['os', 'm' || other, '.m' || other] ELSE ['./m' || other || '.js', 'react'] END) AS spec FROM files),
found AS (SELECT DISTINCT importer, spec, path FROM (SELECT s.importer, s.spec, f.path, row_number() OVER (PARTITION BY s.importer, s.spec ORDER BY length(f.path), f.path) AS rn
  FROM specs s JOIN files f ON f.ext = s.ext AND f.path LIKE '%/m' || s.other || s.ext AND contains(s.spec, 'm' || s.other) AND (f.folder = s.folder OR starts_with(s.spec, 'crate::') OR starts_with(s.spec, 'm') AND NOT starts_with(s.spec, 'mod:'))) WHERE rn = 1)"""
SQL_READS = "reads AS (SELECT user_id AS session, coalesce(props, '') AS path, ts, event_id FROM events)"
