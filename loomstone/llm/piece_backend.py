"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf, read here field by field. From it the backend is rebuilt: the normaliser (its
compiled character map, white-space rules and the dummy prefix), the metaspace marker, and either the
unigram scores or, for a BPE model, merges in the order of the piece scores; both with byte fallback.
Control, byte, unknown and unused pieces never match text: BPE merges make none of them, and the unigram
lattice knows them by names with a blank, which no normalised text holds; what it doesn't know becomes bytes
here, by its place in the text.

Whole texts are encoded in multithreaded batches of bounded bytes. ``parity`` is the result of a comparison of each
whole text: the reference library's ids of the raw text equal the backend's, and so do its decoded texts. It is
null where nothing was compared (``checks`` off, null texts). Null texts give null results, empty ones no ids.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

MARK = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Rows and bytes of text that are encoded at once.
ROWS, BYTES = 512, 1 << 20


def fields(data: bytes):
    """(number, value) of the fields of a protobuf message; values are ints, bytes, or raw fixed-width bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire in (1, 2, 5):
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


class Spec:
    """What the model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.model, self.unk, self.byte_fallback, self.ignore_merges = UNIGRAM, 0, False, False
        self.charsmap, self.dummy_prefix, self.collapse, self.escape, self.suffix = b"", True, True, True, False
        self.surface = " ⁇ "
        for number, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                self.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        self.model = v
                    elif n == 24:
                        self.suffix = bool(v)
                    elif n == 35:
                        self.byte_fallback = bool(v)
                    elif n == 40:
                        self.unk = v
                    elif n == 44:
                        self.surface = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.collapse = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if self.model not in (UNIGRAM, BPE) or self.suffix:
            raise ValueError("only unigram and BPE models with markers before words are supported")
        if self.model == UNIGRAM and not self.escape:
            raise ValueError("unigram models without a marker for blanks aren't supported")
        #: Whether no piece crosses the place between a character and a marker.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best result first."""
    ids = {p: k for k, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL and len(piece) > 1:
            for i in range(1, len(piece)):
                if (a := ids.get(piece[:i])) is not None and (b := ids.get(piece[i:])) is not None:
                    found.append((-score, ids[piece], a, b, piece[:i], piece[i:]))
    return [(a, b) for *_, a, b in sorted(found)]


def backend(spec: Spec):
    """A tokenizers.Tokenizer for normalised text, in which markers already stand for spaces."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, pre_tokenizers

    if spec.model == UNIGRAM:
        least = min((s for _, s, kind in spec.pieces if kind == NORMAL), default=0.0)
        t = Tokenizer(models.Unigram([(p, s) if kind in (NORMAL, USER) else (" " + p, least) for p, s, kind in spec.pieces], spec.unk, False))
        if spec.splits:  # the library remembers what it has split, which had better be short
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), behavior="isolated")
    else:
        vocab = {p: k for k, (p, _, _) in enumerate(spec.pieces)}
        t = Tokenizer(models.BPE(vocab, merges(spec), unk_token=spec.pieces[spec.unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    users = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER]
    if users:
        t.add_tokens(users)
    return t


class Codec:
    """Encodes and decodes with the backend; ``checks`` loads the reference library to compare with."""

    def __init__(self, data: bytes, checks: bool = True):
        self.spec = Spec(data)
        self.tokenizer = backend(self.spec)
        self.names = [p for p, _, _ in self.spec.pieces]
        self.bytes_ = {k: int(p[3:-1], 16) for k, (p, _, kind) in enumerate(self.spec.pieces) if kind == BYTE}
        self.byte_ids = {value: k for k, value in self.bytes_.items()}
        self.is_byte = np.zeros(len(self.names), bool)
        self.is_byte[list(self.bytes_)] = True
        self.control = {k for k, (_, _, kind) in enumerate(self.spec.pieces) if kind == CONTROL}
        # Pieces that spell as they stand, but for the marker.
        self.spelled = [p.replace(MARK, " ") for p in self.names]
        self.plain = np.ones(len(self.names), bool)
        self.plain[[self.spec.unk, *self.control, *self.bytes_]] = False
        self.reference = None
        if checks:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.normalizer = None
        if self.spec.charsmap:
            from tokenizers import normalizers

            self.normalizer = normalizers.Precompiled(self.spec.charsmap)

    def normalise(self, text: str) -> str:
        """The text as pieces spell it."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if self.spec.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if self.spec.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.spec.escape else text

    def encode(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        if self.spec.model == BPE or not self.spec.byte_fallback:
            return [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]
        out = []
        for text, e in zip(normal, self.tokenizer.encode_batch(normal, add_special_tokens=False)):
            ids = e.ids
            if self.spec.unk in ids:
                parts = ([k] if k != self.spec.unk else [self.byte_ids[b] for b in text[i:j].encode()] for k, (i, j) in zip(ids, e.offsets))
                ids = [k for part in parts for k in part]
            out.append(ids)
        return out

    def agrees(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool | None]:
        """Whether the reference library encodes each raw text to the same ids and decodes those to the same text."""
        if self.reference is None:
            return [None] * len(texts)
        wanted = self.reference.encode(texts, num_threads=1) if texts else []
        return [a == b and self.reference.decode(b) == c for a, b, c in zip(wanted, ids, decoded)]

    def code(self, texts: list[str]) -> list[tuple[list[int], str, str, bool | None]]:
        """Ids, decoded text, normalised text and agreement with the reference of each text."""
        normal = [self.normalise(t) for t in texts]
        ids = self.encode(normal)
        back = [self.decode(x) for x in ids]
        return list(zip(ids, back, [self.without_prefix(x.replace(MARK, " ")) for x in normal], self.agrees(texts, ids, back)))

    def pieces(self, ids: list[int]) -> str:
        """Spelling of ids: bytes join to UTF-8 (invalid ones become U+FFFD), markers become spaces."""
        out: list[str] = []
        raw = bytearray()
        for k in ids:
            if k in self.bytes_:
                raw.append(self.bytes_[k])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if k == self.spec.unk:
                out.append(self.spec.surface)
            elif k not in self.control:
                out.append(self.names[k])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def without_prefix(self, text: str) -> str:
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the dummy prefix."""
        ordinary = self.plain[np.asarray(ids, np.int64)].all() if len(ids) else True
        return self.without_prefix("".join([self.spelled[k] for k in ids]) if ordinary else self.pieces(ids))


def _encode(data: bytes, checks: bool, with_ids: bool):
    def run(batches):
        codec = Codec(data, checks)
        try:
            for whole in batches:
                for batch in slices(whole, ROWS, BYTES):
                    all_texts = batch.column("text").to_pylist()
                    coded = codec.code([t for t in all_texts if t is not None])
                    arrays = [np.asarray(ids, "<i4") for ids, *_ in coded]
                    rows = ((x, len(x), int(codec.is_byte[x].sum()), hashlib.sha256(x.tobytes()).hexdigest(), back, back == wanted, same) for x, (_, back, wanted, same) in zip(arrays, coded))
                    none = (None,) * 7
                    columns = list(zip(*[next(rows) if t is not None else none for t in all_texts]))
                    out = {"doc_id": batch.column("doc_id")}
                    if with_ids:
                        offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in columns[0]])]).astype(np.int32)
                        flat = pa.array(np.concatenate([np.empty(0, "<i4"), *arrays]), pa.int32())
                        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([x is None for x in columns[0]]))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                    names = ("n_tokens", "n_bytes", "ids_sha256", "decoded", "round_trip", "parity")
                    out |= {n: pa.array(v, k) for n, v, k in zip(names, columns[1:], kinds)}
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        finally:
            release()

    return run


def default_model() -> str:
    """The public model among the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenise(docs: DataFrame, model: str | None = None, checks: bool = True, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, ids_sha256, decoded, round_trip, parity) for each row of docs.

    The driver reads the model, half a megabyte, and sends it with the plan. n_bytes counts byte-fallback
    ids, ids_sha256 is of the ids as little-endian 32-bit numbers, decoded is the text decoded from the ids,
    round_trip says that it equals the normalised text, parity that the reference library codes the whole text
    alike both ways (null without ``checks``).
    """
    with open(model or default_model(), "rb") as f:
        data = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = "ids array<int>, " if with_ids else ""
    return rows.mapInArrow(_encode(data, checks, with_ids), f"doc_id long, {ids}n_tokens long, n_bytes long, ids_sha256 string, decoded string, round_trip boolean, parity boolean")
