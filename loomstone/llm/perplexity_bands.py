"""Quality rules with language-specific perplexity bands of a modified Kneser-Ney model.

The model predicts each character of a text's words, joined by single blanks, from the four before it, across
word boundaries: order 5. Spark counts the 5-grams of all documents by language and computes interpolated
modified Kneser-Ney probabilities (Chen and Goodman, 1999) from those by aggregates and equi-joins: raw counts at
the highest order, numbers of different left neighbours below, three discounts for each order and language from
the counts of counts. Nothing is sampled, cut or merged, so the model grows with what the corpus holds. A language's
few discounts are joined by salted keys, so no task gets all grams of a language; sums are of whole numbers, so
results don't depend on how rows are dealt. Scoring reads all documents that were counted, so the model holds every
5-gram that it is asked for.

The result, log-probabilities by a 64-bit hash of language and 5-gram, is kept in sorted hash arrays of at most
``most`` entries (12 bytes each, so 48 MB). One array is sent to the workers; a larger model is cut into several by the hash, which are
sent one after another, each adding its part to the documents' sums.

A document's perplexity is exp of minus the mean log-probability of its characters. Bands are set for each
language from all documents that pass the base rules: the median of log-perplexity less ``low`` and plus
``high`` times the robust deviation (1.4826 times the median absolute deviation, at least 0.02), both from a
histogram with bins of 0.001. Languages with fewer than ``least`` such documents share the band of all
documents. Null texts count as empty (they fail the base rules), a null language is one of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Steps
from .common import map_slices

ORDER, SALTS, BIN = 5, 64, 0.001
#: Robust deviations below and above the median that bands reach.
LOW, HIGH = 5.0, 3.5
BEGIN, END = "\u0002", "\u0003"
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: Different grams that a task holds before it hands them on.
FLUSH = 400_000
#: Odd multipliers of the gram hash, one for each place.
PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {k}") | 1 for k in range(ORDER)], np.uint64)


def marked(words: list[str]) -> str:
    return BEGIN * (ORDER - 1) + " ".join(words) + END


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashes(grams: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of the grams, one in each row, of a language."""
    h = np.full(len(grams), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for k in range(ORDER):
        h += grams[:, k].astype(np.uint64) * PLACES[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some word lists, one in each row, and how many each list has."""
    parts = [marked(words) if words else "" for words in texts]
    sizes = np.array([max(0, len(p) - ORDER + 1) for p in parts], np.int64)
    flat = points("".join(parts))
    if len(flat) < ORDER:
        return np.empty((0, ORDER), np.uint32), sizes
    every = np.lib.stride_tricks.sliding_window_view(flat, ORDER)
    # Windows that begin with a text's last places reach into the next one.
    return every[_inside(parts, len(every))], sizes


def _inside(parts: list[str], n: int) -> np.ndarray:
    keep = np.zeros(n, bool)
    at = 0
    for p in parts:
        keep[at : at + max(0, len(p) - ORDER + 1)] = True
        at += len(p)
    return keep


def _by_language(batch: pd.DataFrame):
    """(language, rows) of a frame."""
    langs = [lang if isinstance(lang, str) else "" for lang in batch["lang"]]
    rows: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        rows.setdefault(lang, []).append(k)
    return rows.items()


def _gram_batches(batches):
    """(lang, gram, n) of the texts, counted within a task as far as ``FLUSH`` different ones go."""
    held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (_, grams, n) in held.items():
            text = np.ascontiguousarray(grams, "<u4").view(f"<U{ORDER}").ravel().tolist()
            yield pd.DataFrame({"lang": lang, "gram": text, "n": n})
        held.clear()

    for batch in batches:
        texts = batch["text"].tolist()
        for lang, rows in _by_language(batch):
            grams, _ = windows([SPLIT.findall(texts[k]) if isinstance(texts[k], str) else [] for k in rows])
            if not len(grams):
                continue
            key, first, n = np.unique(hashes(grams, lang), return_index=True, return_counts=True)
            grams = grams[first]
            if lang in held:
                old_key, old_grams, old_n = held[lang]
                key, first, back = np.unique(np.concatenate([old_key, key]), return_index=True, return_inverse=True)
                grams, n = np.concatenate([old_grams, grams])[first], np.bincount(back, np.concatenate([old_n, n])).astype(np.int64)
            held[lang] = (key, grams, n)
        if sum(len(n) for *_, n in held.values()) > FLUSH:
            yield from out()
    yield from out()


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all 5-grams of all documents (lang, text)."""
    return map_slices(docs, _gram_batches, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(grams: DataFrame, step=lambda df, tag: df) -> DataFrame:
    """(lang, gram, p): interpolated modified Kneser-Ney probability of each 5-gram's last character.

    Each order's counts and probabilities are a table (``step``), as several joins read them."""
    orders = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        # The number of different characters before each shorter gram.
        orders[k] = step(orders[k + 1].select("lang", F.substring("gram", 2, k).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "order")
    lower = None
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    for k in range(1, ORDER + 1):
        t = orders[k]
        counts = t.groupBy("lang").agg(F.count("*").alias("types"), *[F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.col("c1") / F.greatest(F.lit(1), F.col("c1") + 2 * F.col("c2"))
        d = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.lit(float(i)) - (i + 1) * y * F.col(f"c{i + 1}") / F.greatest(F.lit(1), F.col(f"c{i}")))) for i in (1, 2, 3)]
        discounts = counts.select("lang", "types", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)], salts)
        head = F.substring("gram", 1, k - 1).alias("h")
        n = F.col("n")
        context = t.groupBy("lang", head).agg(F.sum("n").alias("all"), F.count_if(n == 1).alias("n1"), F.count_if(n == 2).alias("n2"), F.count_if(n > 2).alias("n3"))
        # Contexts are fewer than grams, so the discounts' part of them is computed here, once.
        context = context.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(discounts, ["lang", "salt"]).drop("salt")
        context = context.withColumn("back", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("all"))
        if k == 1:  # one context a language, of as many rows as it has characters
            context = context.drop("h").withColumn("salt", salts)
            t = t.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")).join(context, ["lang", "salt"])
        else:
            t = t.withColumn("h", head).join(context, ["lang", "h"])
        own = F.greatest(F.lit(0.0), n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("all")
        if k == 1:
            lower = step(t.select("lang", "gram", (own + F.col("back") / F.col("types")).alias("p")), "p")
        else:
            shorter = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            lower = t.withColumn("tail", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "tail"]).select("lang", "gram", (own + F.col("back") * F.col("q")).alias("p"))
            lower = step(lower, "p") if k < ORDER else lower
    return lower


class Model:
    """Sorted hashes and their log-probabilities; a gram of another array counts 0, as that array adds its part."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def sums(self, texts: list[list[str]], lang: str) -> np.ndarray:
        """Sum of the log-probabilities of each word list's characters."""
        grams, sizes = windows(texts)
        if not len(grams) or not len(self.keys):
            return np.zeros(len(texts))
        # Each different gram is looked up once, in order, which stays in the processor's caches.
        key, back = np.unique(hashes(grams, lang), return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        log = np.where(self.keys[at] == key, self.logs[at], 0.0).astype(np.float64)[back]
        total = np.concatenate([[0.0], np.cumsum(log)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def _keyed(batches):
    for batch in batches:
        for lang, rows in _by_language(batch):
            part = batch.iloc[rows]
            grams = points("".join(part["gram"])).reshape(-1, ORDER)
            yield pd.DataFrame({"key": hashes(grams, lang).view(np.int64), "log": np.log(np.maximum(part["p"].to_numpy(float), 1e-12)).astype(np.float32)})


def train(docs: DataFrame, step: Steps) -> DataFrame:
    """The model (key, log) of documents (lang, text), as a table."""
    grams = step(count_grams(docs), "grams")
    model = step(map_slices(probabilities(grams, step), _keyed, "key long, log float"), "model")
    step.drop_all_but(model)
    return model


def arrays(model: DataFrame, most: int):
    """The model in arrays of about ``most`` entries at most."""
    many = max(1, math.ceil(model.count() / most))
    for k in range(many):
        part = model.where(F.pmod(F.xxhash64("key"), F.lit(many)) == k) if many > 1 else model
        table = part.toArrow()  # columns, no row objects
        yield Model(table["key"].to_numpy().view(np.uint64), table["log"].to_numpy())


def base_counts(text: str | None, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    text = text if isinstance(text, str) else ""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        ids: dict[str, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        # Exact up to two million different words; beyond, pairs are numbered first.
        if len(ids) < 2_000_000:
            windows = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
        else:
            pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
            windows = pairs[:-1] * len(ids) + w[2:]
        _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
        hit = n[back] > 1
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeated = int(covered.sum())
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated


def _measure(model: Model, base: bool):
    """Sums of log-probabilities by ``row``; with ``base`` also what the base rules count."""

    def run(batches):
        for batch in batches:
            texts = [SPLIT.findall(t) if isinstance(t, str) else [] for t in batch["text"]]
            total = np.zeros(len(texts))
            for lang, rows in _by_language(batch):
                total[rows] = model.sums([texts[k] for k in rows], lang)
            out = pd.DataFrame({"row": batch["row"].to_numpy(), "total": total})
            if base:
                counted = [base_counts(t, w) for t, w in zip(batch["text"], texts)]
                out = pd.concat([out, pd.DataFrame(counted, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])], axis=1)
                out["doc_id"], out["lang"] = batch["doc_id"].to_numpy(), [x if isinstance(x, str) else "" for x in batch["lang"]]
            yield out

    return run


MEASURED = "row long, total double, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_id long, lang string"


def bands(measured: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """(lang, least, most): a row for each language, from a histogram of log-perplexities."""
    bins = measured.where("not base_failed and log_ppl is not null").groupBy("lang", F.round(F.col("log_ppl") / BIN).cast("long").alias("bin")).agg(F.count("*").alias("m"))

    def middle(rows: DataFrame, by: list[str], value: str) -> DataFrame:
        """The lower median of a histogram's values; its windows see bins, not documents."""
        w = Window.partitionBy(*by)
        run = rows.withColumn("_run", F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("m").over(w))
        return run.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*by).agg(F.min(value).alias("mid"), F.max("_all").alias("all"))

    def limits(rows: DataFrame, by: list[str]) -> DataFrame:
        mid = middle(rows, by, "bin")
        away = rows.join(mid, by).withColumn("away", F.abs(F.col("bin") - F.col("mid"))).groupBy(*by, "mid", "all", "away").agg(F.sum("m").alias("m"))
        spread = middle(away.withColumnRenamed("mid", "center").withColumnRenamed("all", "docs"), [*by, "center", "docs"], "away")
        sd = F.greatest(F.lit(0.02), 1.4826 * BIN * F.col("mid"))
        return spread.select(*by, (F.col("center") * BIN - low * sd).alias("least"), (F.col("center") * BIN + high * sd).alias("most"), F.col("docs").alias("docs"))

    own = limits(bins, ["lang"]).where(F.col("docs") >= least)
    pooled = limits(bins.groupBy("bin").agg(F.sum("m").alias("m")).withColumn("every", F.lit(1)), ["every"]).select(F.col("least").alias("pl"), F.col("most").alias("pm"))
    langs = measured.select("lang").distinct().join(own, "lang", "left")
    return langs.join(F.broadcast(pooled), F.lit(True), "left").select("lang", F.coalesce("least", "pl").alias("least"), F.coalesce("most", "pm").alias("most"))  # one pooled row


def measure(docs: DataFrame, most: int, step: Steps) -> DataFrame:
    """Base counts and log-perplexity (log_ppl) of each row of docs (doc_id, lang, text)."""
    model = train(docs.select("lang", "text"), step)
    parts = arrays(model, most)
    first = next(parts)
    rows = docs.withColumn("row", F.lit(None).cast("long"))
    others = []
    for part in parts:
        if not others:
            rows = step(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        others.append(step(map_slices(rows, _measure(part, False), "row long, total double"), "sums"))
    measured = step(map_slices(rows, _measure(first, True), MEASURED), "measured")
    for k, more in enumerate(others):
        measured = measured.join(more.select("row", F.col("total").alias(f"t{k}")), "row")
    total = sum((F.col(f"t{k}") for k in range(len(others))), F.col("total"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # A text's characters, the blanks between its words and its end.
    return measured.withColumn("base_failed", failed).withColumn("log_ppl", F.when(F.col("n_words") > 0, -total / (F.col("word_chars") + F.col("n_words"))))


def judge(docs: DataFrame, low: float = LOW, high: float = HIGH, least: int = 20, most: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity)."""
    step = Steps(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    measured = measure(rows, most, step)
    limits = bands(measured, low, high, least)
    inside = F.coalesce(F.col("log_ppl").between(F.col("least"), F.col("most")), F.lit(True))
    out = measured.join(F.broadcast(limits) if limits.count() <= 10_000 else limits, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))
