"""Phrase collocations by merged count-min sketches and one exact pass over what survives them.

Texts, A-Z lower-cased, fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``; phrases lie in pieces.

First pass: every task counts its words and its phrases of 2, 3 and 4 words, by language, into count-min sketches (Cormode and
Muthukrishnan, 2005), two rows of 8-bit cells for each length, which stop at 255. The tasks' sketches travel in compressed blocks and
are added up, first those of 32 tasks, then all. A cell is never below the count of a phrase that
falls in it (or is 255, which is above ``least``), so a phrase whose estimate is below ``least`` is rare. A task never holds whole
sketches: it gathers the cells of some texts, sorts them and hands on the blocks that they fall in. What is kept of the sum is one bit for each
cell, whether it reaches ``least``.

Second pass: a phrase survives if its own estimate and those of the phrases in it reach ``least``. Survivors, single words
among them, are counted exactly: by text and language, after counts within a task, where 128 bits of hash tell phrases apart.
Only these counts decide. The bits have a bounded size, at most 2^``MOST_BITS`` bytes for all lengths and rows on the driver and in a worker; on corpora beyond what they tell apart more
phrases survive and are counted, with the same result.

Every cut of a candidate looks up the exact counts of its two parts (frequent as well, as the whole is) by
one join of keys; the lowest score counts. A candidate goes if a longer one around it, dropped or not, has ``share`` percent
of its count; the longer ones hand their counts down by one aggregate. Ranks are taken within language and salt, then
within language.

Null texts are empty, a null language is ``und``. Repeated rows count each. Other columns aren't read. Languages without
candidates have no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import Bounded, release, slices

ORDERS, ROWS = (1, 2, 3, 4), 2
LEAST_BITS, MOST_BITS = 16, 26
#: Bytes of text for a cell; tokens whose cells a task gathers before it hands their blocks on.
CELL_BYTES, GATHER = 64, 4_000_000
#: Cells of a travelling block as a power of two; tasks whose blocks meet first; ways of the first ranking; different phrases of a task before it hands them on; words whose hashes it remembers.
BLOCK_BITS, TASKS, SALTS, FLUSH, MEMO = 18, 32, 32, 800_000, 80_000
#: Rows and bytes of text in a slice; bytes of text for a task, so that smaller partitions are read together and hand on each phrase once.
SLICE, TASK_BYTES = (2048, 1 << 20), 256 << 20
#: Ends of pieces become full stops, tabs become blanks, A-Z become a-z.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ODD = np.array([xxhash.xxh3_64_intdigest(f"word {k}") | 1 for k in range(max(ORDERS))], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words and, as full stops, the ends of pieces."""
    return (text or "").encode().translate(_BYTES).replace(b".", b" . ").split()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _other(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


class Tokens:
    """The tokens of some texts in a row, with a hash and a number for each; texts and pieces end at 0."""

    def __init__(self, texts: list[str | None], langs: list[str | None], hashes: Bounded, others: Bounded | None = None):
        self.words: list[bytes] = []
        lang = []
        for text, of in zip(texts, langs):
            found = tokens(text)
            self.words += found
            self.words.append(b".")
            lang.append((of if of is not None else "und", len(found) + 1))
        names = sorted({n for n, _ in lang})
        number = {n: k for k, n in enumerate(names)}
        self.langs = names
        self.lang = np.repeat(np.array([number[n] for n, _ in lang], np.int64), [k for _, k in lang])
        self.hash = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.other = np.fromiter(map(others.__getitem__, self.words), np.uint64, len(self.words)) if others is not None else self.hash
        self.stop = np.fromiter((w == b"." for w in self.words), bool, len(self.words))
        self.salt = np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], np.uint64)[self.lang]

    def checks(self, order: int, start: np.ndarray) -> np.ndarray:
        """Another hash of the phrases of a length at some places, from other hashes of their words."""
        h = self.salt[start] * _MIX
        for k in range(order):
            h = (h ^ (h >> np.uint64(29))) * _ODD[k] + self.other[start + k]
        return h

    def phrases(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all phrases of a length, hashed with their language."""
        n = len(self.hash) - order + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        stopped = self.stop[:n].copy()
        h = self.salt[:n].copy()
        for k in range(order):
            stopped |= self.stop[k : k + n]
            h += self.hash[k : k + n] * _ODD[k]
            h ^= h >> np.uint64(31)
            h *= _MIX
        start = np.flatnonzero(~stopped)
        return start, h[start]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of a sketch: its upper or lower half, mixed again."""
    part = h if not row else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (part >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int):
    """Blocks (block, salt, data) of a task's sketches, without those that are all zero; a block comes once for each gathering of texts."""

    def go(batches):
        size = 1 << min(bits, BLOCK_BITS)
        per = (1 << bits) // size
        hashes = Bounded(_hash, MEMO)
        salt = TaskContext.get().partitionId() // TASKS  # a task that runs again gives the same rows
        held: list[list[np.ndarray]] = [[] for _ in ORDERS]
        n = 0

        def blocks():
            for k in range(len(ORDERS)):
                key = np.concatenate(held[k]) if held[k] else np.empty(0, np.uint64)
                held[k].clear()
                for row in range(ROWS):
                    at = np.sort(cells(key, row, bits).astype(np.uint32))
                    ends = np.searchsorted(at, np.arange(per + 1, dtype=np.int64) * size)
                    for block in np.flatnonzero(np.diff(ends)).tolist():
                        found = at[ends[block] : ends[block + 1]] - np.uint32(block * size)
                        cells_ = np.minimum(255, np.bincount(found, minlength=size)).astype(np.uint8)
                        yield pa.RecordBatch.from_pydict({"block": pa.array([(k * ROWS + row) * per + block], pa.int32()), "salt": pa.array([salt], pa.int32()), "data": pa.array([pa.compress(cells_.tobytes(), "zstd", asbytes=True)], pa.binary())})

        for whole in batches:
            for batch in slices(whole, *SLICE):
                t = Tokens(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), hashes)
                for k, order in enumerate(ORDERS):
                    held[k].append(t.phrases(order)[1])
                n += len(t.hash)
                if n >= GATHER:
                    yield from blocks()
                    n = 0
        yield from blocks()
        release()

    return go


def _merge(size: int):
    """Adds blocks up as they come; a task holds one array for each of its (block, salt)."""

    def go(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, data in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "data"))):
                more = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8)
                held[block, salt] = np.minimum(255, held[block, salt].astype(np.uint16) + more).astype(np.uint8) if (block, salt) in held else more
        for (block, salt), cells_ in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "data": pa.array([pa.compress(cells_.tobytes(), "zstd", asbytes=True)], pa.binary())})

    return go


BLOCKS = "block int, salt int, data binary"


def _sums(rows: DataFrame, bits: int) -> tuple[DataFrame, int, int]:
    """Added blocks of all texts, how many there are at most, and their cells."""
    size = 1 << min(bits, BLOCK_BITS)
    blocks = len(ORDERS) * ROWS * ((1 << bits) // size)
    parts = rows.mapInArrow(_sketch(bits), BLOCKS)
    some = parts.repartition(min(blocks, 1024), "block", "salt").mapInArrow(_merge(size), BLOCKS)
    return some.withColumn("salt", F.lit(0)).repartition(min(blocks, 32), "block").mapInArrow(_merge(size), BLOCKS), blocks, size


def sketches(rows: DataFrame, bits: int) -> np.ndarray:
    """The sketches of all texts, by length and row."""
    whole, blocks, size = _sums(rows, bits)
    out = np.zeros((blocks, size), np.uint8)
    for block, data in whole.select("block", "data").toLocalIterator():
        out[block] = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8)
    return out.reshape(len(ORDERS), ROWS, 1 << bits)


def _bits(size: int, least: int):
    """Of each added block, a bit for each cell that reaches ``least``."""

    def go(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                packed = np.packbits(np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8) >= least, bitorder="little")
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([packed.tobytes()], pa.binary())})

    return go


def reached(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """A bit for each cell of the sketches of all texts, by length and row: whether it reaches ``least``."""
    whole, blocks, size = _sums(rows, bits)
    out = np.zeros((blocks, -(-size // 8)), np.uint8)
    for block, data in whole.mapInArrow(_bits(size, least), BLOCKS).select("block", "data").toLocalIterator():
        out[block] = np.frombuffer(data, np.uint8)
    return out.reshape(len(ORDERS), ROWS, -1)


def _batch(lang: list, size: list, phrase: list[bytes], n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])


class Counts:
    """Counts of phrases by two 64-bit hashes of independent word hashes, in sorted arrays; the phrases themselves once each."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.key, self.check, self.n = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.lang, self.size, self.phrase = np.empty(0, np.int32), np.empty(0, np.int8), np.empty(0, object)
        self.rest: dict[tuple[str, int, bytes], int] = {}

    def add(self, t: Tokens, order: int, start: np.ndarray, h: np.ndarray) -> None:
        """Counts the phrases of a length that start at some places."""
        if not len(start):
            return
        check = t.checks(order, start)
        key, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        # Equal keys of different phrases, if they ever occur, are counted by the phrases.
        odd = check != check[first][back]
        if odd.any():
            n = np.bincount(back[~odd], minlength=len(key))
            for at in start[odd].tolist():
                self.one(t, order, at, 1)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        met = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        same = met.copy()
        same[met] = self.check[at[met]] == check[first[met]]
        self.n[at[same]] += n[same]
        for k in np.flatnonzero(met & ~same).tolist():
            self.one(t, order, int(start[first[k]]), int(n[k]))
        new = ~met
        if new.any():
            begins = start[first[new]]
            into = np.searchsorted(self.key, key[new])
            number = np.array([self.langs.setdefault(x, len(self.langs)) for x in t.langs], np.int32)
            words = np.empty(len(begins), object)
            words[:] = [b" ".join(t.words[b : b + order]) for b in begins.tolist()]
            put = {"key": key[new], "check": check[first[new]], "n": n[new], "lang": number[t.lang[begins]], "size": np.full(len(begins), order, np.int8), "phrase": words}
            for name, values in put.items():
                setattr(self, name, np.insert(getattr(self, name), into, values))

    def one(self, t: Tokens, order: int, at: int, n: int) -> None:
        key = (t.langs[t.lang[at]], order, b" ".join(t.words[at : at + order]))
        self.rest[key] = self.rest.get(key, 0) + n

    def __len__(self) -> int:
        return len(self.key) + len(self.rest)

    def rows(self):
        names = np.array([*self.langs, ""], object)
        rest = list(self.rest.items())
        for k in range(0, len(self.n), 20_000):
            cut = slice(k, k + 20_000)
            yield _batch(names[self.lang[cut]].tolist(), self.size[cut].tolist(), self.phrase[cut].tolist(), self.n[cut].tolist())
        for k in range(0, len(rest), 20_000):
            keys, n = zip(*rest[k : k + 20_000])
            yield _batch(*map(list, zip(*keys)), list(n))
        self.clear()


def _survivors(sent, bits: int, least: int):
    """(lang, size, phrase, n): counts within a task of the phrases that the sketches leave, and of all words under size 0."""

    def go(batches):
        made, hashes, others, held = sent.value, Bounded(_hash, MEMO), Bounded(_other, MEMO), Counts()
        for whole in batches:
            for batch in slices(whole, *SLICE):
                t = Tokens(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), hashes, others)
                for lang, n in zip(t.langs, np.bincount(t.lang[~t.stop], minlength=len(t.langs)).tolist()):
                    held.rest[lang, 0, b""] = held.rest.get((lang, 0, b""), 0) + n
                inside = None  # whether the phrase of the length before survives at each place
                for k, order in enumerate(ORDERS):
                    start, h = t.phrases(order)
                    alive = np.ones(len(start), bool) if inside is None else inside[start] & inside[start + 1]
                    start, h = start[alive], h[alive]
                    for row in range(ROWS):
                        at = cells(h, row, bits)
                        alive = (made[k, row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                        start, h = start[alive], h[alive]
                    held.add(t, order, start, h)
                    inside = np.zeros(len(t.hash) + 1, bool)
                    inside[start] = True
                if len(held) > FLUSH:
                    yield from held.rows()
        yield from held.rows()
        release()

    return go


def frequent(docs: DataFrame, least: int, bits: int | None, step: Steps, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, n) of all phrases of 1 to 4 words that occur ``least`` times, (lang, n) of all words)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)))
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / CELL_BYTES + 1))))
    if least > 255:
        raise ValueError("cells stop at 255")
    sent = rows.sparkSession.sparkContext.broadcast(reached(rows, bits, least))
    counts = step(rows.mapInArrow(_survivors(sent, bits, least), "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")), "counts")
    return counts.where((F.col("size") > 0) & (F.col("n") >= least)), counts.where("size = 0").select("lang", "n")


def candidates(docs: DataFrame, least: int = 30, share: int = 80, bits: int | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score, kept): every candidate; kept unless a longer one takes its place."""
    step = Steps(docs.sparkSession)
    found, words = frequent(docs, least, bits, step, lang_col, text_col)
    known = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    long = found.where("size > 1").withColumn("w", F.split("phrase", " "))

    def between(a, n):
        return F.array_join(F.slice("w", a, n), " ")

    # Every cut's two parts, looked up by one join; side 0 is the first part.
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), between(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), between(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    parts = cut.select("lang", "phrase", "size", F.col("n").alias("a"), "k", sides.alias("s")).select("lang", "phrase", "size", "a", "k", "s.side", "s.part")
    parts = parts.join(known, ["lang", "part"])
    by_cut = parts.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # 2000000 * a may pass 64 bits: decimals of 38 digits divide exactly.
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = by_cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")
    # Longer candidates hand their counts to the candidates inside them.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: F.array_join(F.slice("w", a, n), " ")))))
    around = long.where("size > 2").select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    out = scored.join(around, ["lang", "phrase"], "left").withColumn("kept", F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    totals = F.broadcast(words) if words.count() <= 10_000 else words
    return out.join(totals, "lang").select("lang", "phrase", "size", "a", "l", "r", "n", "score", "kept")


def collocations(docs: DataFrame, top: int = 2000, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` kept candidates."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    rows = candidates(docs, **more).where("kept").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: All phrases counted, by list positions.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM p),
g AS (SELECT lang, s AS size, unnest([array_to_string(ws[k:k + s - 1], ' ') FOR k IN range(1, greatest(len(ws) - s + 2, 1))]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS s)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 30),
k AS (SELECT lang, phrase, a, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp, k FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * a // (x.n + y.n))::BIGINT AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = lp JOIN f y ON y.lang = k.lang AND y.phrase = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[j:j + m - 1], ' ') FOR j IN range(1, size - m + 2)]) AS phrase FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n, score
  FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a) WHERE rank <= 2000"""
