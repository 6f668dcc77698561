"""Toxic passages by maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Training reads a sample bounded by ``max_toxic`` and ``max_clean`` labelled documents, the first by a
hash of their ids, none of them held out (crc32 of the id as text divisible by 5). Three fifths of the
sample give token weights: the log-odds of a token's document frequency among toxic and clean
documents under an informative Dirichlet prior (Monroe et al., 2008), moved 1.65 standard deviations
towards zero. A token scores its weight minus a drift, so clean text scores below zero on average.
A linear-time scan (Ruzzo and Tompa, 1999) finds every maximal segment of a document. The other two
fifths calibrate: lambda solves E[exp(lambda s)] = 1 over clean tokens, K fits the extreme-value law
P(best > x) = 1 - exp(-K N exp(-lambda x)) to clean documents of N tokens (Karlin and Altschul,
1990), and a logistic curve turns the surprise -ln P of the best segment, and the sum of all segments'
excesses over ln K, into the probability of label 1. A text without segments has no surprise, however short.

Every row of the input gets a score. Null and empty texts have no segments and get the low score that
goes with that. Labels with nulls are ignored, repeated ones count once (the larger). Without
labels of both kinds the score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise
from .common import Bounded, map_slices, release, slices

DRIFT, PRIOR, SHRINK = 1.0, 2500.0, 1.65
MARKS = ".,;:!?\"'()[]{}<>#*$%&|~`_-+=/\\…«»¿¡“”„‘’"


def plain(word: str) -> str:
    return word.lower().strip(MARKS)


def token_scores(weights: dict[str, float]) -> Bounded:
    """Scores of raw words."""
    return Bounded(lambda word: weights.get(plain(word), 0.0) - DRIFT)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in order; only positive scores are visited."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    for at in np.nonzero(scores > 0)[0].tolist():
        low, high, start, end = total[at], total[at + 1], at, at + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= low:
                j -= 1
            if j < 0 or out[j][1] >= high:
                break
            low, start = out[j][0], out[j][2]
            del out[j:]
        out.append((low, high, start, end))
    return [(s, e, float(high - low)) for low, high, s, e in out]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, toxic, text) of the bounded sample. The ids' bound makes their broadcast safe."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = marked.where("toxic = 1").orderBy(order).limit(max_toxic).unionByName(marked.where("toxic = 0").orderBy(order).limit(max_clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.join(F.broadcast(ids), "doc_id"), "sample")


def _counts(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for toxic, text in zip(batch["toxic"], batch["text"]):
            for word in {plain(w) for w in (text or "").split()}:
                counts.setdefault(word, [0, 0])[toxic] += 1
        yield pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["token", "clean", "toxic"])


def _measures(weights):
    """(toxic, n, best) of each text: its words and the score of its best segment."""

    def run(batches):
        scores = token_scores(weights)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = np.fromiter(map(scores.__getitem__, text.split()), float) if isinstance(text, str) else np.empty(0)
                rows.append((len(s), max((x for _, _, x in segments(s)), default=0.0)))
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in rows], "best": [b for _, b in rows]})

    return run


def _features(model: "Model"):
    def run(batches):
        scores = token_scores(model.weights)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = np.fromiter(map(scores.__getitem__, text.split()), float) if isinstance(text, str) else np.empty(0)
                rows.append(model.features(len(s), [x for _, _, x in segments(s)]))
            yield pd.DataFrame({"toxic": batch["toxic"], "surprise": [x for x, _ in rows], "excess": [y for _, y in rows]})

    return run


class Model:
    """Weights of tokens and the calibration; a few tens of thousands of numbers, bounded by the sample."""

    def __init__(self, weights=None, lam=1.0, log_k=0.0, curve=(-math.inf, 0.0, 0.0)):
        self.weights, self.lam, self.log_k, self.curve = weights or {}, lam, log_k, curve

    def features(self, n: int, found: list[float]) -> tuple[float, float]:
        """Surprise of the best segment, -ln P(best), 0 without segments, and the sum of what the segments exceed ln K by."""
        if not len(found):
            return 0.0, 0.0
        excess = self.lam * max(found) - self.log_k - math.log(max(n, 1))
        chance = -math.expm1(-math.exp(min(-excess, 50.0)))
        surprise = min(excess, 40.0) if chance < 1e-15 else -math.log(chance)
        return surprise, math.log1p(sum(max(0.0, self.lam * x - self.log_k) for x in found))

    def score(self, n: int, found: list[float]) -> float:
        x, y = self.features(n, found)
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Coefficients by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 8000) -> Model:
    known = sample(docs, labels, max_toxic, max_clean)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))
    rows = map_slices(known.where(part < 3).select("toxic", "text"), _counts, "token string, clean long, toxic long")
    counts = rows.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n_clean, n_toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    if not n_clean or not n_toxic:
        return Model(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    # Rarer tokens have no weight that survives shrinking.
    table = counts.where("clean + toxic >= 3 and toxic >= 2").toArrow().to_pandas()
    prior = PRIOR * (table["clean"] + table["toxic"]) / (n_clean + n_toxic)
    odds = lambda k, n: np.log((k + prior) / (n + PRIOR - k - prior))
    delta = odds(table["toxic"], n_toxic) - odds(table["clean"], n_clean)
    sd = np.sqrt(1 / (table["toxic"] + prior) + 1 / (table["clean"] + prior))
    shrunk = np.sign(delta) * np.maximum(0, abs(delta) - SHRINK * sd)
    weights = {w: float(x) for w, x in zip(table["token"], shrunk) if x > 0}
    rest = known.where(part >= 3)
    found = map_slices(rest, _measures(weights), "toxic int, n long, best double").toArrow().to_pandas()
    clean = map_slices(known.where((part >= 3) & (F.col("toxic") == 0)).select("text"), _histogram(weights), "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    model = Model(weights)
    if len(clean) and clean["s"].max() > 0:
        s, p = clean["s"].to_numpy(), clean["n"].to_numpy() / clean["n"].sum()
        low, high = 1e-3, 50.0
        for _ in range(60):
            model.lam = (low + high) / 2
            low, high = (low, model.lam) if (p * np.exp(np.minimum(model.lam * s, 700))).sum() > 1 else (model.lam, high)
    own = found[(found["toxic"] == 0) & (found["n"] > 0)]
    if len(own):
        x = model.lam * own["best"].to_numpy(float) - np.log(own["n"].to_numpy(float))
        model.log_k = float(-np.log(np.mean(np.exp(-x))))
    y = found["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        # Rows and numbers that reach the driver are bounded by the sample, whatever its texts' lengths.
        table = map_slices(rest, _features(model), "toxic int, surprise double, excess double").toArrow().to_pandas()
        model.curve = tuple(logistic(table[["surprise", "excess"]].to_numpy(float), table["toxic"].to_numpy(float)).tolist())
    else:
        model.curve = (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0)
    return model


def _histogram(weights):
    def run(batches):
        scores = token_scores(weights)
        for batch in batches:
            all_ = np.concatenate([np.empty(0), *[np.fromiter(map(scores.__getitem__, t.split()), float) for t in batch["text"] if isinstance(t, str)]])
            s, n = np.unique(all_.round(6), return_counts=True)
            yield pd.DataFrame({"s": s, "n": n})

    return run


def _score(model: Model):
    def run(batches):
        scores = token_scores(model.weights)
        for batch in batches:
            out, parts = [], []
            for text in batch["text"]:
                words = text.split() if isinstance(text, str) else []
                s = np.fromiter(map(scores.__getitem__, words), float, len(words))
                found = segments(s)
                out.append(model.score(len(words), [x for _, _, x in found]))
                parts.append([(a, b) for a, b, x in found if model.lam * x - model.log_k - math.log(len(words)) > 0])
            yield batch.drop(columns="text").assign(score=out, passages=[[{"start": a, "end": b} for a, b in p] for p in parts])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): passages are the word ranges of significant segments."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, _score(model), "doc_id long, score double, passages array<struct<start:long,end:long>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they are."""
    return docs.mapInArrow(_keeper(train(docs, labels), docs.columns.index("text")), docs.schema)


def _keeper(model: Model, text_at: int):
    def run(batches):
        scores = token_scores(model.weights)
        try:
            for batch in batches:
                for part in slices(batch):
                    keep = []
                    for text in part.column(text_at).to_pylist():
                        words = text.split() if isinstance(text, str) else []
                        s = np.fromiter(map(scores.__getitem__, words), float, len(words))
                        keep.append(model.score(len(words), [x for _, _, x in segments(s)]) < 0.5)
                    yield part.filter(pa.array(keep, pa.bool_()))
        finally:
            release()

    return run
