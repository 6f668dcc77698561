"""Inverted indexes: fuzzy lookup that reads postings by length, and trigram postings that prefilter regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex_grams import Need, grams_of, required
from ..functions.text import ascii_lower
from . import search

# Fuzzy lookup ----------------------------------------------------------------------------------------------------------


def name_index(symbols: DataFrame) -> DataFrame:
    """(gram, size, path, ord, name, qualified): a posting for each character and pair of characters of a symbol's folded name or
    qualified name, and the byte length of the shorter of these that holds it. No shuffle: a symbol makes its own postings."""
    def grams(c: Column) -> Column:
        low = ascii_lower(c)
        pairs = F.regexp_extract_all(low, F.lit(r"(?s)(?=(..))"), 1)
        return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"(?s)(.)"), 1), pairs))

    each = symbols.select("path", "ord", "name", "qualified", F.explode(F.array(*[F.struct(grams(F.col(c)).alias("g"), F.octet_length(c).alias("size")) for c in ("name", "qualified")])).alias("x"))
    rows = each.select(F.explode("x.g").alias("gram"), F.col("x.size").alias("size"), "path", "ord", "name", "qualified")
    return rows


def write_name_index(symbols: DataFrame, path: str) -> None:
    """The index as a table sorted by gram and length, so that a lookup reads the row groups of its gram and lengths alone. Ranges of a
    common gram are cut by length, path and order, so none is one task's work."""
    key = ["gram", "size", "path", "ord"]
    name_index(symbols).repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def fuzzy(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    """(path, qualified, ord, score): the same symbols as ``search.fuzzy`` finds, from the index at ``path``.

    A name of s bytes scores at most 1000 - (s - n) if it holds the query of n bytes, and at most 500 - (s - n) / 2 if it only holds its
    characters in order. So lengths are read upwards, in windows that double; substrings from the postings of the query's
    rarest pair, the others from those of its rarest character; each side ends once its bound falls below the score of the last of the
    best so far, of which the driver holds ``limit``."""
    index, q = spark.read.parquet(path), search.fold(query)
    keys = ["path", "qualified", "ord", "score"]
    if not q:
        return index.select("path", "qualified", "ord", F.lit(None).cast("long").alias("score")).where("false")
    n = len(q.encode())
    pairs = sorted({q[k : k + 2] for k in range(len(q) - 1)}) or [q]
    counts = {r.gram: (r.n, r.longest) for r in index.where(F.col("gram").isin(pairs + sorted(set(q)))).groupBy("gram").agg(F.count("*").alias("n"), F.max("size").alias("longest")).collect()}  # a row for each gram of the query

    def rarest(grams) -> tuple[str | None, int]:
        held = [(counts[g][0], g) for g in grams if g in counts]
        return (min(held)[1], counts[min(held)[1]][1]) if len(held) == len(grams) else (None, 0)

    score = F.greatest(search.fuzzy_score(query, F.col("name")), search.fuzzy_score(query, F.col("qualified")))
    order = [F.desc("score"), F.octet_length("qualified"), "path", "ord"]
    best: list = []

    def read(gram: str, least: int, most: int) -> None:
        nonlocal best
        rows = index.where((F.col("gram") == gram) & F.col("size").between(least, most)).select("path", "name", "qualified", "ord").distinct()
        found = rows.withColumn("score", score).where("score is not null").select(*keys).orderBy(*order).limit(limit).collect()  # the best few
        place = lambda r: (-r.score, len(r.qualified.encode()), r.path.encode(), r.ord)
        best = sorted({tuple(r): r for r in [*best, *found]}.values(), key=place)[:limit]

    # Scores of scattered characters are above 0; those of substrings may fall below.
    for grams, bound, lowest in ((pairs, lambda s: 1000 - (s - n), None), (sorted(set(q)), lambda s: 500 - (s - n) // 2, 1)):
        gram, longest = rarest(grams)
        least, width = n, 8
        while gram is not None and least <= longest and (len(best) < limit or bound(least) >= best[-1].score) and (lowest is None or bound(least) >= lowest):
            read(gram, least, least + width - 1)
            least, width = least + width, width * 2
    return spark.createDataFrame([tuple(r) for r in best], index.select("path", "qualified", "ord", F.lit(0).cast("long").alias("score")).schema)


# Regular expressions ---------------------------------------------------------------------------------------------------


def trigram_index(files: DataFrame) -> DataFrame:
    """(gram, path): the different trigrams of each file's lines, A-Z folded. No shuffle."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"(?=([^\n]{3}))"), 1))).alias("gram")).select("gram", "path")


def candidates(index: DataFrame, pattern: str, regex: bool = True, ignore_case: bool = False) -> DataFrame | None:
    """(path) of the files that hold the trigrams which lines matching the pattern must; None if it asks for none, so all files may match.

    The postings of all these trigrams are read in one scan and become one mask for each file, by partial aggregates."""
    need = required(pattern, regex, ignore_case)
    if need is True:
        return None
    asked = sorted(grams_of(need))
    words = -(-len(asked) // 62)
    place = {g: divmod(k, 62) for k, g in enumerate(asked)}
    hit = index.where(F.col("gram").isin(asked))
    numbers = F.create_map(*[F.lit(x) for g, (w, b) in place.items() for x in (g, w * 64 + b)])
    at = hit.select("path", F.element_at(numbers, F.col("gram")).alias("at"))
    masks = [F.bit_or(F.when(F.floor(F.col("at") / 64) == w, F.expr("shiftleft(1L, cast(at % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(words)]
    held = at.groupBy("path").agg(*masks)

    def test(q: Need) -> Column:
        if q is True or q is False:
            return F.lit(q)
        if isinstance(q, str):
            w, b = place[q]
            return F.col(f"m{w}").bitwiseAND(F.lit(1 << b)) != 0
        kind, parts = q
        out = None
        for p in sorted(parts, key=str):
            t = test(p)
            out = t if out is None else (out & t if kind == "and" else out | t)
        return out

    return held.where(test(need)).select("path")


def grep(files: DataFrame, index: DataFrame, pattern: str, regex: bool = True, ignore_case: bool = False) -> DataFrame:
    """(path, ln, line): as ``search.grep`` finds them, reading the texts of candidate files alone."""
    found = candidates(index, pattern, regex, ignore_case)
    rows = files if found is None else files.join(found, "path", "left_semi")
    return search.grep(rows, pattern, regex, ignore_case)


def scan_share(files: DataFrame, index: DataFrame, pattern: str, regex: bool = True, ignore_case: bool = False) -> DataFrame:
    """(files, bytes, all_files, all_bytes): what a search has to read, of files (path, size)."""
    found = candidates(index, pattern, regex, ignore_case)
    marked = files.withColumn("_in", F.lit(True)) if found is None else files.join(found.withColumn("_in", F.lit(True)), "path", "left")
    size = lambda rows: F.coalesce(F.sum(rows), F.lit(0)).cast("long")
    return marked.agg(F.count_if(F.coalesce("_in", F.lit(False))).alias("files"), size(F.when(F.col("_in"), F.col("size"))).alias("bytes"), F.count("*").alias("all_files"), size(F.col("size")).alias("all_bytes"))
