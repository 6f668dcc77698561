"""The pipeline's stages: their columns, and that each one's decisions take effect on what its predecessor kept."""

import random

import corpus_pipeline
from loomstone.llm import mixture, pii_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(50, 90))]
        toxic = i % 8 == 0
        if toxic:
            w[5], w[20], w[40] = "slurone", "slurtwo", "slurone"
        if i % 9 == 1:
            w[7] = f"+1 (555) 010-{1000 + i}"
        docs.append((i, " ".join(w), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 8]
    docs += [(1000 + k, clean[k][1], "en", "a", 0) for k in range(5)] + [(2000, None, "en", None, 0)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "personal_data", "mixing", "sentencepiece"]
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name != names[-1]:
            assert out.columns == COLUMNS
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        seen[name] = now.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    wrong = {d[0] for d in docs if d[0] < 1000 and (d[0] % 8 == 0) == (d[0] in ids["toxicity"])}
    assert len(wrong) <= 4
    assert ids["near_dedup"] == ids["toxicity"] - {1000 + k for k in range(5) if clean[k][0] in ids["toxicity"]}
    masked = {r.doc_id: r for r in seen["personal_data"]}
    assert ids["personal_data"] == ids["near_dedup"] and all(not any(pii_spans.base_spans(r.text or "")) for r in masked.values())
    assert any("[PHONE]" in (r.text or "") for r in masked.values()) and all(r.n_chars == len(r.text) for r in masked.values() if r.text and r.doc_id < 1000)
    assert ids["mixing"] <= ids["personal_data"] and len(seen["sentencepiece"]) == len(seen["mixing"])
    assert all(r.round_trip and r.parity and len(r.ids) == r.n_tokens for r in seen["sentencepiece"])


def test_null_and_repeated_ids_in_every_stage(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    docs = [(None, text(rng.randrange(20, 60)), "en", "abc"[i % 3], 0) for i in range(90)]
    docs += [(i, text(rng.randrange(20, 60)), "en", "abc"[i % 3], 0) for i in range(120)]
    docs += [(i, text(rng.randrange(20, 60)), "en", "abc"[(i + 1) % 3], 0) for i in range(60)]  # other texts and sources under the same ids
    labels = [(i, 1, 0) for i in range(120)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, now, path)
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        assert {(r.doc_id, r.text) for r in now.collect()} == {d[:2] for d in docs}, name
    mixed = corpus_pipeline.mixing(spark, now, path)
    mixed.write.parquet(f"{path}/mixing")
    mixed = spark.read.parquet(f"{path}/mixing")
    words, times = {}, {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        times[r.doc_id, r.text, r.source] = times.get((r.doc_id, r.text, r.source), 0) + 1
    target = {r.source: r.target for r in mixture.mix(now).select("source", "target").distinct().collect()}
    # Each source has its words to the word, and no row is repeated beyond its quota.
    assert all(abs(words.get(s, 0) - t) <= 1 for s, t in target.items())
    size = {s: sum(len(d[1].split()) for d in docs if d[3] == s) for s in target}
    assert set(times) <= {(d[0], d[1], d[3]) for d in docs} and all(n <= target[s] // size[s] + 1 for (_, _, s), n in times.items())
    tokens = corpus_pipeline.tokens(spark, mixed, path).collect()
    assert len(tokens) == sum(times.values()) and sum(r.doc_id is None for r in tokens) == sum(n for (i, *_), n in times.items() if i is None) > 0


def test_empty_very_long_and_clashing_input(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    docs = [(1, "", "en", "a", 0), (2, None, None, None, 0), (3, " \n\t ", "en", "a", 0), (4, text(60_000), "en", "b", 0), (5, "x" * 300_000, "de", "b", 0), (6, text(30), "en", "a", 0), (6, text(30), "en", "a", 0)]
    docs += [(7, "same text of a few words here", "en", "a", 0)] * 3
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [d + (9, 9, "x", 1.0, "y", [1]) for d in docs]
    clash = shape + ", size long, id long, row string, score double, key string, ids array<int>"
    for name, rows, columns in (("some", extra, clash), ("none", [], shape)):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, columns).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, now, path)
            out.write.parquet(f"{path}/{stage}")
            now = spark.read.parquet(f"{path}/{stage}")
            if stage != "sentencepiece":
                assert now.columns == COLUMNS
            if stage == "near_dedup":
                kept = sorted((str(r.doc_id), len(r.text or "")) for r in now.collect())
                # Copies go but for one; texts without words aren't copies of one another.
                assert kept == sorted((str(i), len(t or "")) for i, t in {d[:2] for d in rows})
        assert (now.count() > 0) == bool(rows)
