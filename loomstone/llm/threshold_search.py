"""Ranked lexical search by Fagin's threshold algorithm (Fagin, Lotem and Naor, 2001).

Documents are dealt over tasks as they lie; nothing of them is shuffled. A first pass reads each text once and writes the
forward index: for each document its number of terms and, of the terms that some item asks for, the numbers and counts.
N, L and the document frequencies are aggregates of that table.

A second pass runs the algorithm over slices of the forward index. A slice's postings, sorted by term and falling impact, are
the lists; an item's lists are read round-robin, a block of equal depth from each, and each document met for the first
time is looked up in the slice's forward index, which gives its whole score. The threshold is the score that a
document would have with the next impact of every list; an item is done once the threshold falls strictly below
its k-th score (so equal scores are all seen) or its lists end. The k best of a task's slices stand as the next slice's bound.
A task hands on k rows for each item; these meet in two steps, by item and salt, then by item.

Items are a stated query set: they go to the tasks in blocks of ``block_bytes`` of text, each block with a vocabulary, and so arrays,
of its own; more items are more blocks, never a larger one.

Null texts have no terms; items and documents without terms have no rows. Rows of ``items`` that are
equal in id and text are one item; one id with two texts is two, ranked each for itself. Repeated documents are
ranked each, as equals; of equal scores smaller doc_ids come first, null last. Other columns aren't read.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..plans.shared import Steps
from .common import release, slices

#: Bytes of item texts in a block; rows and bytes of a slice of the forward index; entries of a list read in the first round; ways of the first merge.
BLOCK_BYTES, SLICE, DEPTH, SALTS = 8 << 20, (16_384, 24 << 20), 16, 64
#: Separators of terms become blanks and A-Z becomes a-z; every byte of a longer character is part of a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms with repeats; numbers and counts of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def go(batches):
        number = {t: k for k, t in enumerate(sent.value)}
        for whole in batches:
            for batch in slices(whole):
                tokens = [terms(t) for t in batch.column("text").to_pylist()]
                n = np.fromiter(map(len, tokens), np.int64, len(tokens))
                ids = np.fromiter(map(number.get, (t for ts in tokens for t in ts), repeat(-1)), np.int64, int(n.sum()))
                key = np.repeat(np.arange(len(n)), n) << 32 | ids
                key, tf = np.unique(key[ids >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(key >> 32, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in ((key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, in 64-bit integers."""
    m = 100 - 25 + (25 * n * docs) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Best:
    """The k best (score, document) of an item so far; null ids come last among equals."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def kth(self) -> int:
        """A score must reach this to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        at = np.flatnonzero(score >= self.kth())
        if len(at):
            score, doc, null = (np.concatenate([a, b[at]]) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
            first = np.lexsort((doc, null, -score))[: self.k]
            self.score, self.doc, self.null = score[first], doc[first], null[first]


class Lists:
    """A slice of the forward index and its postings by term and falling impact."""

    def __init__(self, batch: pa.RecordBatch, size: int, docs: int, length: int):
        lists = batch.column("terms")
        self.start = lists.offsets.to_numpy().astype(np.int64)
        self.start -= self.start[0]
        self.term = lists.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(self.start))
        self.impact = impacts(batch.column("tfs").flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()[owner], docs, length)
        self.null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.doc = batch.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((-self.impact, self.term))
        self.owner, self.falling = owner[order], self.impact[order]
        self.bounds = np.searchsorted(self.term[order], np.arange(size + 1))
        self.seen = np.zeros(batch.num_rows, bool)

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from the forward index."""
        first, many = self.start[rows], self.start[rows + 1] - self.start[rows]
        begin = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(first - begin, many)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], begin)  # a document met in a list has terms

    def search(self, asked: np.ndarray, worth: np.ndarray, weight: np.ndarray, best: Best, depth: int = DEPTH) -> int:
        """Round-robin over the lists of ``asked`` until no unseen document can matter; returns how many documents were looked up."""
        first, end = self.bounds[asked], self.bounds[asked + 1]
        touched, step = [], depth
        while True:
            open_ = first < end
            first, end, worth = first[open_], end[open_], worth[open_]
            if not len(first) or int((worth * self.falling[first]).sum()) < best.kth():
                break
            many = np.minimum(step, end - first)
            begin = np.cumsum(many) - many
            met = self.owner[np.arange(int(many.sum())) + np.repeat(first - begin, many)]
            new = np.unique(met[~self.seen[met]])
            if len(new):
                self.seen[new] = True
                touched.append(new)
                best.add(self.scores(new, weight), self.doc[new], self.null[new])
            first, step = first + many, step * 2
        for new in touched:
            self.seen[new] = False
        return sum(map(len, touched))


def _top(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, docs: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): the k best of each task."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def go(batches):
        best: dict[int, Best] = {}
        weight = np.zeros(size, np.int64)
        for whole in batches:
            for batch in slices(whole, *SLICE):
                lists = Lists(batch, size, docs, length)
                for q, (asked, worth) in enumerate(sent.value):
                    weight[asked] = worth
                    lists.search(asked, worth, weight, best.setdefault(q, Best(k)))
                    weight[asked] = 0
        for q, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q, np.int32)), pa.array(b.doc, pa.int64(), mask=b.null), pa.array(b.score)], names=["q", "doc_id", "score"])
        release()

    return index.mapInArrow(go, "q int, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int):
    """The items in lists of pairs (id, terms); each list comes from about ``block_bytes`` of text."""
    many = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for b in range(many):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b) if many > 1 else items
        yield [(r.item_id, t) for r in rows.toLocalIterator() if (t := terms(r.text))]


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0."""
    spark, step = docs.sparkSession, Steps(docs.sparkSession)
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    names = items.select("item_id").schema.add("q", IntegerType())
    found = None
    for block in _blocks(items, block_bytes):
        vocabulary = sorted({t for _, ts in block for t in ts})
        if not vocabulary and found is not None:
            continue
        index = step(forward_index(docs, vocabulary, id_col, text_col), "forward")
        counts = index.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for batch in index.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow().to_batches():  # a row for each term of the block's items
            df[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        worth = [math.floor(1000 * math.log((2 * counts.docs + 2) / (2 * d + 1))) for d in df.tolist()]
        number = {t: n for n, t in enumerate(vocabulary)}
        queries = []
        for _, ts in block:
            asked, times = np.unique([number[t] for t in ts], return_counts=True)
            queries.append((asked, times * np.array([worth[t] for t in asked], np.int64)))
        tops = step(_top(index, queries, len(vocabulary), counts.docs, counts.length or 0, k), "tops")
        step.drop(index)
        by = Window.partitionBy("q", "salt").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        some = tops.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        last = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(item, q) for q, (item, _) in enumerate(block)], names)
        out = ranked.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")  # ids of one block
        found = out if found is None else found.unionByName(out)
    return found


#: The same by joining all postings.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS length FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM t) GROUP BY term),
g AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score FROM t JOIN w USING (term) JOIN p USING (term), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0) WHERE rank <= 20"""
