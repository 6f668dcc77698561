"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are lower-cased and stripped of everything but letters and digits. Every common word of ``ANCHORS``
(and the start of the text, so that texts without one aren't all alike) is an anchor; its signature
joins it with the next two content words, skipping common words. At the start fewer content words are
enough. A fingerprint is the sorted set of signatures, each as 16 hexadecimal digits. Built-in functions
only: with C the content words and S the anchors (word, position), the j-th anchor at position p has
p - j content words before it, so its chain is C[p - j], C[p - j + 1]: one pass, no search.

Likeness is the Jaccard similarity of the sets. A text without any word has the empty fingerprint;
two empty fingerprints have likeness 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can for from had has have he her his i if in is it its not of on or that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die du ein eine einen er es haben ich im ist mit nach nicht noch oder sein sich sie so sind und von war wie wird zu zum zur "
    "au aux avec ce ces dans de elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui que sa se ses son sont sur un une vous "
    "al como con del el ella esta este fue ha las lo los mas muy para pero por sin su sus una y"
).split()
START = "^"


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text (array of strings)."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return _chains(F.filter(F.split(plain, SPACE), lambda w: w != ""))


def _chains(words: Column) -> Column:
    # A struct binds the arrays once; referring to them by expression would compute them again for each anchor.
    parts = F.struct(
        F.filter(words, lambda w: ~w.isin(ANCHORS)).alias("c"),
        F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda s: s["w"].isin(ANCHORS)).alias("s"),
    )

    def chains(x: Column) -> Column:
        chain = lambda s, j: F.when(F.get(x["c"], s["p"] - j + 1).isNotNull(), F.concat_ws(" ", s["w"], F.get(x["c"], s["p"] - j), F.get(x["c"], s["p"] - j + 1)))
        first = F.concat_ws(" ", F.lit(START), F.get(x["c"], F.lit(0)), F.get(x["c"], F.lit(1)))
        start = F.when((F.size(x["c"]) > 0) | (F.size(x["s"]) > 0), F.array(first)).otherwise(F.array().cast("array<string>"))
        return F.sort_array(F.transform(F.array_distinct(F.concat(start, F.filter(F.transform(x["s"], chain), lambda v: v.isNotNull()))), _digest))

    return F.get(F.transform(F.array(parts), chains), F.lit(0))


def _digest(s: Column) -> Column:
    return F.substring(F.md5(s), 1, 16)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures, " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def similar_pairs(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id", set_col: str = "signatures") -> DataFrame:
    """(a, b, likeness) of classes of equal sets with likeness of at least ``least``; a < b are smallest ids.

    Sets are partitioned by length: class p holds lengths from least^-p to least^-(p+1), and a set meets its
    own and the next class only, as sets further apart are too unequal. Within them, sets meet if they share
    one of their first n - ceil(least * n) + 1 signatures, rarest first, which loses no pair; then lengths
    are compared, then the sets.
    """
    sets = prints.select(F.col(id_col).alias("id"), F.col(set_col).alias("sig")).where(F.size("sig") > 0).groupBy("sig").agg(F.min("id").alias("id"))
    rarity = sets.select(F.explode("sig").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.explode("sig").alias("s")).join(rarity, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    prefix = ranked.withColumn("n", F.size("r")).withColumn("part", F.floor(F.log("n") / F.lit(-math.log(least)) + 1e-9))
    prefix = prefix.select("id", "n", "part", F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("x")).select("id", "n", "part", F.col("x.s").alias("s"))
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "s")
    near = prefix.join(other, ["part", "s"]).where((F.col("id") != F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9))
    near = near.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("id").alias(k), F.col("sig").alias(f"s{k}")) for k in "ab")
    scored = near.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return scored.where(F.col("likeness") >= least).select("a", "b", "likeness")


def with_next(docs: DataFrame, keep: list[str], side: int | None = None) -> DataFrame:
    """docs (ord long, text, ...) with ``next``: a struct of the columns keep of the next row by (ord, text).

    The last row is followed by the first. Rows are dealt into ranges of ord, whose limits are approximate
    quantiles: side * side of them, a bounded list (at most 65,536). Each range also gets, as a guest, the
    first row of the next one that isn't empty. So rows are shuffled once, and no task sees more than a range.
    """
    n, low = docs.agg(F.count("*"), F.min("ord")).first()
    if not n:
        return docs.withColumn("next", F.struct(*keep))
    side = side or min(256, max(1, math.ceil(math.sqrt(n / 1000))))
    k = side * side
    cuts = docs.agg(F.percentile_approx("ord", [i / k for i in range(1, k)] or [0.5], max(10_000, 10 * k))).first()[0] if k > 1 else []
    cuts = [low, *cuts]
    outer, inner = cuts[::side], [cuts[i : i + side] for i in range(0, k, side)]
    literal = lambda xs: F.lit([int(x) for x in xs]).cast("array<bigint>")
    # The last limit that isn't above ord, by two short scans.
    i = F.size(F.filter(literal(outer), lambda c: c <= F.col("ord"))) - 1
    dealt = docs.withColumn("i", i)
    rows = F.array(*[literal(x) for x in inner])
    dealt = dealt.withColumn("block", F.col("i") * side + F.size(F.filter(F.get(rows, F.col("i")), lambda c: c <= F.col("ord"))) - 1).drop("i")
    firsts = sorted(dealt.groupBy("block").agg(F.min("ord")).collect())
    into = {first: firsts[p - 1][0] for p, (_, first) in enumerate(firsts)}
    guest_of = F.create_map(*[F.lit(int(x)) for pair in into.items() for x in pair])
    # Guests are found by a filter on the bounded list of first values, not by a join.
    guests = dealt.where(F.col("ord").isin([int(x) for x in into])).withColumn("block", F.element_at(guest_of, F.col("ord")).cast("int"))
    both = dealt.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("block").orderBy("guest", "ord", "text")
    return both.withColumn("next", F.lead(F.struct(*keep)).over(order)).where("guest = 0").drop("guest", "block")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text ends in the next document's beginning, floor(n_chars / 4) code points, instead of its
    own last ones. Documents follow one another by id, null ids first, equal ids by text. Null texts count as
    empty. (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("ord"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_next(rows, ["text"]).withColumn("n", F.char_length("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    df = df.withColumn("edit", F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), F.substring("next.text", F.lit(1), quarter)))
    df = df.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), signatures(F.col("text")).alias("sig"), signatures(F.col("next.text")).alias("next_sig"), signatures(F.col("edit")).alias("edit_sig"))
    return df.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edit_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edit_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def oracle() -> str:
    """The same in DuckDB."""
    stop = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS nxt
           FROM documents WINDOW w AS (ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, length(text) AS n, substring(text, 1, length(text) - length(text) // 4) || substring(nxt, 1, length(text) // 4) AS edit FROM d),
t AS (SELECT DISTINCT x AS text FROM (SELECT text AS x FROM e UNION ALL SELECT edit FROM e)),
w AS (SELECT text, [x FOR x IN regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM t),
s AS (SELECT text, [x FOR x IN ws IF NOT list_contains({stop}, x)] AS c, [{{'w': x, 'p': k}} FOR x, k IN ws IF list_contains({stop}, x)] AS a FROM w),
f AS (SELECT text, list_sort(list_distinct(list_concat(
        CASE WHEN len(c) + len(a) > 0 THEN [md5(concat_ws(' ', '^', c[1], c[2]))[1:16]] ELSE [] END,
        [md5(concat_ws(' ', x.w, c[x.p - k + 1], c[x.p - k + 2]))[1:16] FOR x, k IN a IF x.p - k + 2 <= len(c)]))) AS sig FROM s)
SELECT doc_id, n AS n_chars, sha256(edit) AS edited_sha256, array_to_string(f1.sig, ' ') AS fingerprint, array_to_string(f2.sig, ' ') AS edited_fingerprint,
  CASE WHEN len(f1.sig) + len(f2.sig) = 0 THEN 1.0 ELSE len(list_intersect(f1.sig, f2.sig)) / len(list_distinct(list_concat(f1.sig, f2.sig))) END::DOUBLE AS near_edited,
  CASE WHEN len(f1.sig) + len(f3.sig) = 0 THEN 1.0 ELSE len(list_intersect(f1.sig, f3.sig)) / len(list_distinct(list_concat(f1.sig, f3.sig))) END::DOUBLE AS near_next
FROM e JOIN f f1 ON e.text = f1.text JOIN f f2 ON e.edit = f2.text JOIN f f3 ON e.nxt = f3.text"""
