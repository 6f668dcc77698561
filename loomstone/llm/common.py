"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Word separators of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes that a Python function holds as objects at once; one row may be larger.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: the word starts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batch in order, in halves of halves until each is small."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def release() -> None:
    """Give freed memory back to the system, so that a reused worker doesn't carry one stage's peak into the next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_slices(rows: DataFrame, run, shape: str | StructType) -> DataFrame:
    """rows.mapInPandas(run, shape) with frames of bounded size; integers with nulls keep all their digits."""
    schema = StructType.fromDDL(shape) if isinstance(shape, str) else shape
    arrow = to_arrow_schema(schema)

    def frames(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.to_pandas(integer_object_nulls=True)

    def go(batches):
        try:
            for out in run(frames(batches)):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        finally:
            release()

    return rows.mapInArrow(go, schema)


class Bounded(dict):
    """A memo of function values by short strings, emptied when it holds ``most`` of them; longer keys aren't kept.

    So it stays below some tens of megabytes whatever the texts hold.
    """

    def __init__(self, function, most: int = 150_000, longest: int = 48):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
