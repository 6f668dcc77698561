"""A corpus pipeline of five stages, each calling one operator of loomstone.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns
of documents; the last one adds the token ids. Between stages the rows are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.llm import mixture, odd_sketch, piece_backend, pii_spans, toxic_segments
from loomstone.plans.shared import Steps

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark, docs, sf_dir):
    """Documents predicted toxic go."""
    return toxic_segments.without_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies stays."""
    kept = odd_sketch.near_duplicates(docs).where("kept").select("doc_id").distinct()
    whole = docs.select(COLUMNS)
    same = whole.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return same.unionByName(whole.where("doc_id is null")).select(COLUMNS)


def personal_data(spark, docs, sf_dir):
    """Personal data is masked by its kind."""
    return pii_spans.mask(docs.select(COLUMNS))


def mixing(spark, docs, sf_dir):
    """Every document as many times as the mix takes it."""
    taken = mixture.mix(docs, carry=COLUMNS).where("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return taken.select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def tokens(spark, docs, sf_dir):
    """Token ids of every document."""
    encoded = piece_backend.tokenise(docs)
    return encoded.select("doc_id", "ids", "n_tokens", "ids_sha256", "round_trip", "parity")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("sentencepiece", tokens)]
#: SQL can't express the trained stages; the tests hold each against a plainer version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the documents table; every stage starts from its predecessor's table, and a table goes once its successor is written."""
    docs, step = spark.read.parquet(f"{sf_dir}/documents.parquet"), Steps(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, step(stage(spark, docs, sf_dir), name)
        step.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
