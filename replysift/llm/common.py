"""Helpers the operators share: reading tables, per-batch text maps, seeded hashes.

Words everywhere are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``
(``bytes.split()`` splits exactly there), so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.sinks import new_stage_path, stage, stage_root

WORD_RE = r"[^\x20\x09-\x0D]+"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """Column by its exact name (dots and backticks are part of it)."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` other than ``names`` (Spark compares names without case)."""
    drop = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in drop]


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, mod ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "a long, b string"; needs the session, so call it on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: Rows of an Arrow batch while whole sets and texts move (Spark bounds batches by rows only).
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Smaller Arrow batches for the jobs run inside; the session's own setting comes back."""
    before = spark.conf.get(_BATCH, "10000")
    try:
        spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
        yield
    finally:
        spark.conf.set(_BATCH, before)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a string or binary column of about ``most`` bytes at most."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, end - start
        start = end


def text_slices(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch as UTF-8 bytes (null: empty), in slices of bounded size."""
    column = column.cast(pa.large_binary())
    for start, size in slices(column):
        yield [t or b"" for t in column.slice(start, size).to_pylist()]


def map_texts(df: DataFrame, fields: str, fn: Callable, text_col: str = "text",
              keep: list[str] | None = None) -> DataFrame:
    """Adds the columns ``fields`` ("a long, b double"), computed batch by batch.

    ``fn(texts)`` gets the texts of a slice as bytes (null: empty) and returns
    one list or array for each field. ``keep`` names the columns that stay
    (default: all); one with the name of a field is replaced by it. Extra state
    is set up once for each task by a ``fn`` that has a ``setup`` method.
    """
    ship_package(df.sparkSession)
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(fields)
    names = [f.name for f in out]
    stay = [c for c in without(df, names) if keep is None or c in keep]
    source = df.select(*[quoted(c) for c in stay], quoted(text_col).cast("string").alias("__text__"))
    schema = StructType([*source.select(*[quoted(c) for c in stay]).schema.fields, *out.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        work = fn.setup() if hasattr(fn, "setup") else fn
        for batch in batches:
            text, done = batch.column(batch.num_columns - 1), 0
            for texts in text_slices(text):
                part = batch.slice(done, len(texts))
                done += len(texts)
                made = work(texts)
                columns = [*part.columns[:-1], *[pa.array(m) if not isinstance(m, pa.Array) else m for m in made]]
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, target, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return source.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


__all__ = [
    "BLANKS", "WORD_RE", "arrow_schema", "fold_of", "map_texts", "mix64", "new_stage_path", "quoted", "read_table",
    "ship_package", "small_batches", "stage", "stage_root", "text_slices", "without",
]
