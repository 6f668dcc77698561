"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full sets confirm them.

A document's set holds its distinct five-word shingles (A-Z lower-cased; with fewer words the whole
sequence is one shingle; without words the set is empty and linked with nothing). Two documents are
linked if 100 * |A n B| >= 85 * |A u B|. Steps:

1. Exact copies (equal sets, by a 128-bit digest) are folded onto their smallest id with a partial
   aggregate, so a group of copies of any size costs one row from here on.
2. 125 MinHash samples per representative make 25 bands of 5 rows. A pair at the threshold shares no
   band with probability (1 - 0.85^5)^25 < 5e-7.
3. The same 125 samples are folded into a 512-bit odd sketch: every (sample number, sample) flips one
   bit. The XOR of two sketches is the sketch of the symmetric difference, so its population count p
   estimates the similarity as 1 + n/(4k) ln(1 - 2p/n), most precisely for similar sets. d differing
   samples give p <= 2d; p > 84 therefore means more than 42 of 125 samples differ, which a linked
   pair does with probability below 1e-7. Such pairs are dropped without reading their texts.
4. Remaining pairs are confirmed on the full sets, rebuilt from the texts.

Only connectivity is asked for, so a bucket isn't compared with itself. First every member meets the
smallest id of its bucket, which joins a group of near copies at one comparison for each member. In
buckets that still hold several components, the pairs left to compare have a member outside the
component that holds most of the bucket. Buckets of up to 32 members emit those pairs. Larger ones are
dealt into blocks of some 256 x 256 members that are compared within a task, by matrices, and emit
links alone; a pair is compared in the first band that it shares. So no pair that could join two
components goes uncompared, no group is gathered in one task, and no group emits all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import Bounded, map_slices

BANDS, ROWS, SKETCH_BITS, MOST_XOR = 25, 5, 512, 84
#: Members of a bucket that emits its pairs, and of a side of a block; bytes of text that a block holds, about.
FEW, SIDE, BLOCK_BYTES = 32, 256, 16 << 20
WORDS = SKETCH_BITS // 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for each number."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased. bytes.lower and bytes.split treat ASCII alone, as asked."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def word_hashes() -> Bounded:
    """64-bit hashes of words."""
    return Bounded(xxhash.xxh3_64_intdigest)


def shingle_hashes(words: list[bytes], hashes: Bounded, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n, step = max(1, len(h) - size + 1), min(size, len(h))
    out = np.full(n, step, np.uint64)
    for i in range(step):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def min_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum for each multiply-add function, in blocks so that very long texts need no more memory."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(best, (a[:, None] * shingles[None, at : at + 4096] + b[:, None]).min(axis=1), out=best)
    return best


def sketch_functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set {(i, sample i)} as 64-bit words."""
    at = mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _sketch_batches(batches):
    hashes, (a, b) = word_hashes(), sketch_functions()
    for batch in batches:
        n, digests, odd, bands = [], [], [], []
        for text in batch["text"]:
            s = shingle_hashes(tokens(text), hashes)
            n.append(len(s))
            digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
            if len(s):
                m = min_hashes(s, a, b)
                odd.append(odd_sketch(m))
                bands.append(band_keys(m))
            else:
                odd.append(np.zeros(WORDS, np.int64))
                bands.append(np.empty(0, np.int64))
        digests, odd = np.array(digests, np.int64).reshape(-1, 2), np.array(odd, np.int64).reshape(-1, WORDS)
        yield pd.DataFrame({"id": batch["id"], "n": n, "h1": digests[:, 0], "h2": digests[:, 1], **{f"s{i}": odd[:, i] for i in range(WORDS)}, "bands": bands})


def _confirm(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """The linked pairs of a block, by the full sets of the texts that it needs."""
    hashes = word_hashes()
    sets = {key: shingle_hashes(tokens(text), hashes) for key, text in zip(texts["id"], texts["text"])}
    keep = []
    for a, b in zip(pairs["a"], pairs["b"]):
        p, q = sets[a], sets[b]
        both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= 85 * max(len(p), len(q)) else 0
        keep.append(100 * both >= 85 * (len(p) + len(q) - both))
    return pairs.loc[keep, ["a", "b"]]


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that the full sets link. They are dealt into a square of blocks by both ids, each of about
    4,000 pairs, with at most some 2,000 partners of one id and about ``BLOCK_BYTES`` of texts, so a text is sent
    once for each block, not pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    size, most, n_bytes = ends.join(texts.select("id", "bytes"), "id").agg(F.sum("n"), F.max("n"), F.sum("bytes")).first()
    side = max(1, math.ceil(math.sqrt((size or 0) / 8000)), math.ceil((most or 0) / 2000), math.ceil(2 * (n_bytes or 0) / BLOCK_BYTES))
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(side)).cast("long") * side + F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side)))
    needed = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select(F.col("g").alias("block"), "id", "text")
    return pairs.groupBy("g").cogroup(needed.groupBy("block")).applyInPandas(_confirm, "a long, b long")


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the outside members (side 0) and the members (side 1) of one block of a bucket."""
    x, y = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if not len(x) or not len(y):
        return rows.loc[[], ["id", "id"]].set_axis(["a", "b"], axis=1)
    parts = [(d["id"].to_numpy(), d["comp"].to_numpy(), (d["comp"] != d["most"]).to_numpy(), np.stack(d["bands"].to_numpy()), d[[f"s{i}" for i in range(WORDS)]].to_numpy()) for d in (x, y)]
    (i, ic, _, ib, isk), (j, jc, jo, jb, jsk) = parts
    band = int(np.argmax(ib[0] == rows["key"].iloc[0]))
    todo = (ic[:, None] != jc[None, :]) & (~jo[None, :] | (i[:, None] < j[None, :]))
    for k in range(band):
        todo &= ib[:, k, None] != jb[None, :, k]
    for at in range(0, len(i), 64):
        todo[at : at + 64] &= np.bitwise_count(isk[at : at + 64, None] ^ jsk[None]).sum(axis=2, dtype=np.int64) <= MOST_XOR
    p, q = np.nonzero(todo)
    if not len(p):
        return pd.DataFrame({"a": i[:0], "b": i[:0]})
    hashes = word_hashes()
    sets = [[shingle_hashes(tokens(t), hashes) for t in d["text"]] for d in (x, y)]
    sizes = [np.array([len(v) for v in part]) for part in sets]
    vocabulary = np.intersect1d(np.unique(np.concatenate(sets[0])), np.unique(np.concatenate(sets[1])), assume_unique=True)
    both = np.zeros((len(i), len(j)), np.float32)
    for at in range(0, len(vocabulary), 8192):
        some = vocabulary[at : at + 8192]
        one = [np.stack([np.isin(some, v, assume_unique=True) for v in part]).astype(np.float32) for part in sets]
        both += one[0] @ one[1].T
    both = both[p, q].astype(np.int64)
    keep = 100 * both >= 85 * (sizes[0][p] + sizes[1][q] - both)
    p, q = i[p[keep]], j[q[keep]]
    return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})


def in_blocks(many: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of large buckets: rows (key, id, comp, most, n, o)."""
    # Blocks of at most about SIDE members and half of BLOCK_BYTES on either side.
    held = many.join(texts.select("id", "bytes"), "id").groupBy("key").agg(F.ceil(2 * F.sum("bytes") / BLOCK_BYTES).alias("shares"))
    rows = many.join(held, "key").join(reps, "id").join(texts.drop("bytes"), "id")
    count = lambda c: F.greatest(F.ceil(F.col(c) / SIDE), F.least("shares", c), F.lit(1)).cast("int")
    wide, high = count("n"), count("o")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, high).otherwise(wide)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, wide).otherwise(high) - 1)
    dealt = rows.withColumn("side", F.explode(F.when(F.col("comp") != F.col("most"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    return dealt.drop("n", "o", "shares", "own", "other").groupBy("key", "i", "j").applyInPandas(_compare_block, "a long, b long")


def components(edges: DataFrame, step: Steps | None = None) -> DataFrame:
    """(id, comp) of every node of the edges (a, b) that isn't the smallest of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each needs one aggregate and one
    equi-join and never gathers a component; the edges become stars after O(log^2 n) steps at worst.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    step = step or Steps(edges.sparkSession)
    e = step(e, "edges")
    mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
    last = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, step(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "stars")
        step.drop(old)
        now = mark(e)
        if now == last:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        last = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Null and empty texts have no shingles and form components of their own, as do rows without an id
    (component_id null, kept true). Repeated rows get the same component_id. Other columns are not read.
    """
    spark, step = docs.sparkSession, Steps(docs.sparkSession)
    shape = "id long, n long, h1 long, h2 long, " + ", ".join(f"s{i} long" for i in range(WORDS)) + ", bands array<long>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = step(map_slices(rows, _sketch_batches, shape), "sketches")
    copies = sketched.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # Only groups with several rows need the join; every other row is its own representative.
    folded = sketched.select("id", "n", "h1", "h2").join(copies.where("copies > 1"), ["h1", "h2"], "left")
    folded = step(folded.select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep")), "copies")
    reps = sketched.where("n > 0").join(folded.where("n > 0 and id is not null and id = rep").select("id").distinct(), "id", "left_semi")
    reps = step(reps.drop("h1", "h2", "n"), "representatives")

    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = step(banded.join(shared, "key").select("key", "id"), "buckets")
    texts = rows.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).withColumn("bytes", F.octet_length("text"))
    texts = step(texts, "texts")
    sketch = reps.drop("bands")
    left = sketch.select(F.col("id").alias("a"), *[F.col(f"s{i}").alias(f"p{i}") for i in range(WORDS)])
    right = sketch.select(F.col("id").alias("b"), *[F.col(f"s{i}").alias(f"q{i}") for i in range(WORDS)])
    odd = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))))
    comps = spark.createDataFrame([], "id long, comp long")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = pairs.distinct().join(left, "a").join(right, "b").where(odd <= MOST_XOR).select("a", "b")
        return step(confirm(step(likely, "likely"), texts), "links")

    pivots = members.groupBy("key").agg(F.min("id").alias("a"))
    links = linked(members.join(pivots, "key").where("id > a").select("a", F.col("id").alias("b")))
    if not links.isEmpty():
        comps = components(links, step)
    rest = members.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    by_comp = rest.groupBy("key", "comp").agg(F.count("*").alias("m"))
    most = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("n"), F.max_by("comp", F.struct("m", "comp")).alias("most"), F.max("m").alias("m")).where("comps > 1")
    # n members, o of them outside; the smallest id has met all others already
    rest = rest.join(most.select("key", "most", "n", (F.col("n") - F.col("m")).alias("o")), "key").join(pivots, "key").where("id <> a").drop("a")
    rest = step(rest, "open")
    few, many = rest.where(f"n <= {FEW}"), rest.where(f"n > {FEW}")
    outer = few.where("comp <> most").select("key", F.col("id").alias("x"), F.col("comp").alias("xc"))
    more = linked(few.join(outer, "key").where("comp <> xc").select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")))
    if not many.isEmpty():
        more = more.unionByName(step(in_blocks(many, reps, texts), "links"))
    if not more.isEmpty():
        comps = components(links.unionByName(more), step)
    comps = step(comps, "components")
    step.drop_all_but(folded, comps)
    out = folded.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
