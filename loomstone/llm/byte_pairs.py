"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file (its size is checked against ``MOST_BYTES``) and sends its bytes once; every worker process builds one
encoding from them. Each match of the pattern is merged by itself, without special tokens.

Long texts are cut where a match of the pattern must end whatever stands around, so that the parts' ids are the text's ids
and a worker holds one part's ids at a time:

- before white space that follows something else, as no match goes on from another character to white space;
- between ASCII letters, digits and signs, in either order, but for a letter after an apostrophe.

White space of ``RUN`` characters or more, which overflows the library's stack, is one match but for its last character (which may belong to what
follows) and is merged as a single piece. A run of letters, digits or signs without such a place is one match, so it stays whole.

Null texts count as empty: no ids, and the hash of nothing. Rows are coded one by one, so repeated rows give equal rows;
columns other than the id and the text aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

#: Characters of a part, at which a cut is looked for; white space that goes to the merges without the pattern; bytes of a rank file.
CUT, RUN, MOST_BYTES = 1 << 17, 1 << 16, 64 << 20
#: The characters of Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SIGN = r"!-/:-@\[-`{-~"
_SAFE = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9{SIGN}])|(?<=[0-9])(?=[A-Za-z{SIGN}])|(?<=[{SIGN}])(?=[0-9])|(?<=[{SIGN}])(?<!')(?=[A-Za-z])")
_RUNS = re.compile(f"[{WHITE}]{{{RUN},}}")


def parts(text: str, cut: int = CUT, runs: re.Pattern = _RUNS):
    """(part, whether it is white space to be merged as a single piece) in order; together they are the text."""

    def pieces(a: int, b: int):
        while b - a > cut:
            found = _SAFE.search(text, a + cut, b)
            end = found.start() if found else b
            if end >= b:
                break
            yield text[a:end], False
            a = end
        if a < b:
            yield text[a:b], False

    at = 0
    for run in runs.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from pieces(at, run.start())
        yield text[run.start() : end], True
        at = end
    yield from pieces(at, len(text))


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_parts(encoding, text: str, cut: int = CUT, runs: re.Pattern = _RUNS):
    """The ids of each part of a text."""
    if len(text) <= cut:
        yield encoding.encode_ordinary(text)
        return
    for part, white in parts(text, cut, runs):
        yield encoding._encode_single_piece(part) if white else encoding.encode_ordinary(part)


def _digests(encoding, text: str | None) -> tuple[int, str, str]:
    ids_sha, decoded_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in encode_parts(encoding, text or ""):
        if ids:
            ids_sha.update((" " if n else "").encode() + " ".join(map(str, ids)).encode())
            decoded_sha.update(encoding.decode_bytes(ids))
            n += len(ids)
    return n, ids_sha.hexdigest(), decoded_sha.hexdigest()


def _run(docs: DataFrame, work, columns: str, ranks: str | None, pattern: str | None) -> DataFrame:
    import public_tokenizers

    path, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} holds more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def go(batches):
        encoding = _encoding(sent.value, pattern)
        try:
            for whole in batches:
                for batch in slices(whole):
                    yield work(encoding, batch)
        finally:
            release()

    return docs.mapInArrow(go, columns)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; ids are hashed as decimals joined by one space."""

    def work(encoding, batch):
        n, ids, decoded = zip(*(_digests(encoding, t) for t in batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _run(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ranks, pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row."""

    def work(encoding, batch):
        ids = [[k for part in encode_parts(encoding, t or "") for k in part] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _run(rows, work, "doc_id long, ids array<int>", ranks, pattern)


def decode(coded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids): raw bytes, as ids may end inside a character. Null ids give no bytes."""

    def work(encoding, batch):
        raw = [encoding.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _run(rows, work, "doc_id long, bytes binary", ranks, pattern)
