"""Collocations against a plain counter, with wide and with overfull sketches."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomstone.llm import collocations as co
from loomstone.llm.common import Bounded

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, share=80, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in (1, 2, 3, 4):
                f.setdefault(lang, Counter()).update(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in held.items()):
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(spark, docs, top=2000, **more):
    d = spark.createDataFrame([(*r, 3, "x", 1) for r in docs], "lang string, text string, n int, phrase string, size int").repartition(3)
    return sorted(tuple(r) for r in co.collocations(d, top, **more).collect())


words = st.lists(st.sampled_from(["New", "york", "city", "of", "é", ".", ",", "\n", "\t", "a\x1cb", "x  y", ";z"]), max_size=30).map(" ".join)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["en", "fr", None]), words), max_size=25), st.sampled_from([3, 16]))
def test_equals_a_plain_counter(spark, docs, bits):
    assert run(spark, docs, least=3, bits=bits) == plain(docs, 3)


def test_edges(spark):
    long = "the quick brown fox. " * 20_000
    docs = [("en", long), ("en", None), ("en", ""), (None, "a b c d e " * 40), ("und", "a b"), ("", "...,,,;"), ("fr", "mot " * 29), ("de", "so so so")] + [("es", "uno dos tres, uno dos")] * 15
    got = run(spark, docs)
    assert got == plain(docs, 30) and {r[0] for r in got} == {"en", "und", "es"}
    assert run(spark, docs, top=1) == plain(docs, 30, top=1)
    assert run(spark, []) == []
    with pytest.raises(ValueError, match="255"):
        run(spark, docs, least=256)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 6 * 10**12
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    found = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    monkeypatch.setattr(co, "frequent", lambda *a: (found, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    (r,) = co.candidates(spark.createDataFrame([("en", "x")], "lang string, text string")).collect()
    assert r.score == 2000000 * (big - 1) // (3 * big + 1)


def test_cells_are_never_below_counts(spark):
    texts = ["one two three four five " * 20, "one two, three four " * 10, "x y z"] * 4
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    for bits in (2, 8, 19):
        made = co.sketches(docs, bits)
        t = co.Tokens(texts, ["en"] * len(texts), Bounded(co._hash))
        for k, order in enumerate(co.ORDERS):
            key, n = np.unique(t.phrases(order)[1], return_counts=True)
            for row in range(co.ROWS):
                assert (made[k, row, co.cells(key, row, bits)] >= np.minimum(n, 255)).all()
        assert bits < 19 or (made.astype(int) > 0).sum() <= 80  # wide ones hold little else


def test_equal_hashes_of_different_phrases(monkeypatch):
    class Sent:
        value = np.full((4, 2, 4), 255, np.uint8)

    import pyarrow as pa

    monkeypatch.setattr(co.Tokens, "phrases", lambda self, order: (lambda n: (n, np.zeros(len(n), np.uint64)))(np.array([s for s in range(len(self.words) - order + 1) if not self.stop[s : s + order].any()], np.int64)))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": ["a b c a b", "a b"]})
    monkeypatch.setattr(co, "SLICE", (1, 1 << 20))
    got = Counter()
    for out in co._survivors(Sent, 2, 1)([batch]):
        for r in out.to_pylist():
            got[r["phrase"]] += r["n"] if r["size"] else 0
    assert +got == Counter({"a": 3, "b": 3, "c": 1, "a b": 3, "b c": 1, "c a": 1, "a b c": 1, "b c a": 1, "c a b": 1, "a b c a": 1, "b c a b": 1})


def test_bits_say_which_cells_reach_the_least(spark, monkeypatch):
    texts = ["one two three four five " * 20, "one two, three four " * 10, "x y z"] * 4
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    for gather in (1, 1000):  # blocks for each slice of texts, and for all
        monkeypatch.setattr(co, "GATHER", gather)
        for bits in (2, 8, 19):
            sent = co.reached(docs, bits, 60)
            assert sent.nbytes <= max(1 << bits, 8)  # a byte before, eight times as much
            got = np.unpackbits(sent, axis=-1, bitorder="little")[..., : 1 << bits].astype(bool)
            assert (got == (co.sketches(docs, bits) >= 60)).all() and got.any()
