"""Threshold search against scoring every document, on generated tables and with small blocks and slices."""

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomstone.llm import threshold_search as ts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    found = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in found if t]
    many, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * many) // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(text.translate(UPPER)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20, **more):
    d = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, n int, terms string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, q int")
    return sorted((tuple(r) for r in ts.search(d, i, k, **more).collect()), key=str)


words = st.lists(st.sampled_from(["a", "b", "C", "d9", "é", "É", "the", "The", "rare"]), max_size=12).map(" ".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(words, max_size=40), st.lists(words, min_size=1, max_size=6), st.integers(1, 5))
def test_equals_scoring_all(spark, monkeypatch, texts, asked, k):
    monkeypatch.setattr(ts, "SLICE", (7, 1 << 20))
    monkeypatch.setattr(ts, "DEPTH", 1)
    docs, items = list(enumerate(texts)), list(enumerate(asked))
    assert run(spark, docs, items, k) == plain(docs, items, k)


def test_edges(spark):
    docs = [(1, "Cat dog, cat!"), (1, "Cat dog, cat!"), (None, "Cat dog, cat!"), (2, None), (3, ""), (4, "..."), (5, "fish " * 30_000 + "cat"), (6, "ÀB éb"), (7, "dog\tdog\ndog")]
    items = [(1, "cat CAT dog"), (1, "cat CAT dog"), (1, "fish"), (2, None), (3, ""), (None, "éb"), (4, "unknown"), (5, "àb éB")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, 2) == plain(docs, items, 2)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == []


def test_many_blocks(spark):
    docs = [(k, f"w{k % 5} w{k % 7} w{k % 3} tail") for k in range(60)]
    items = [(k, f"w{k % 7} w{k % 5} tail") for k in range(12)]
    assert run(spark, docs, items, block_bytes=30) == plain(docs, items)


def test_stops_before_the_lists_end():
    """Of a long list only the first documents are looked up."""
    import numpy as np
    import pyarrow as pa

    n = 5000
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "n": pa.array(rng.integers(3, 400, n)), "terms": pa.array(rows, pa.list_(pa.int32())), "tfs": pa.array([[1 + int(x) % 3 for x in rng.integers(0, 50, len(r))] for r in rows], pa.list_(pa.int32()))})
    lists = ts.Lists(batch, 6, n, 5 * n)
    weight = np.array([0, 900, 0, 700, 0, 20], np.int64)
    asked = np.flatnonzero(weight)
    best = ts.Best(20)
    looked = lists.search(asked, weight[asked], weight, best)
    every = ts.Best(20)
    every.add(lists.scores(np.arange(n), weight), lists.doc, lists.null)
    assert best.score.tolist() == every.score.tolist() and best.doc.tolist() == every.doc.tolist()
    assert looked < n / 4 and not lists.seen.any()
