"""A classified listing stored by label, corrected in place without rewriting all of it.

Rows lie in ``<path>/rows-<n>/part=<slug>``, one part for each label. A version is a small table of
(part, rows): in which ``rows-<n>`` each part lies. A merge of corrections rewrites only the parts
that lose or gain a row and writes a version that names the new folders for those and the old ones for
the rest; files of other parts keep their names and times. Versions are ``Snapshots``, so a reader sees
the table before a merge or after it, and a merge that failed halfway left nothing that a version names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    CATEGORIES, CONFIDENCE, CORRECTED_CONFIDENCE, CORRECTED_REASONING, HUMAN_REVIEWED, INVALID_LABEL, LABEL, ORIGINAL_LABEL, REASONING, ROW_KEY,
)
from ..functions.text import category_slug
from ..operators.review import apply_corrections, latest_corrections
from .snapshots import Folder, Snapshots

PART = "part"


def part_of(categories=CATEGORIES):
    """The part of a row: its label's slug; labels outside ``categories`` and null share one."""
    known = F.col(LABEL).isin(*categories, INVALID_LABEL)
    return F.when(known, category_slug(LABEL)).otherwise(F.lit("other"))


class LabelTable:
    """One writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, path: str, categories=CATEGORIES, keep: int = 2):
        self.spark, self.path, self.categories = spark, path.rstrip("/"), categories
        self.versions, self.folder = Snapshots(spark, self.path + "/versions", keep), Folder(spark, self.path)

    def _write(self, rows: DataFrame, version: int, unchanged: list[tuple[str, int]]) -> None:
        parts = rows.withColumn(PART, part_of(self.categories))
        # rebalanced by part, large parts split: a file or more for each part, not one for each part and task
        parts.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/rows-{version}")
        made = [(n.split("=")[1], version) for n in Folder(self.spark, f"{self.path}/rows-{version}").names() if n.startswith(PART + "=")]
        schema = T.StructType([T.StructField(PART, T.StringType()), T.StructField("rows", T.LongType())])
        listed = self.spark.createDataFrame(sorted(made + unchanged), schema)  # a row for each label
        self.versions.write(listed.coalesce(1), version)
        self._forget()

    def _forget(self) -> None:
        """Removes row folders that no kept version names."""
        used = {r["rows"] for e in self.versions.epochs() for r in self.spark.read.parquet(self.versions.path_of(e)).select("rows").distinct().collect()}
        for name in self.folder.names():
            if name.startswith("rows-") and int(name[5:]) not in used:
                self.folder.remove(name)

    def create(self, classified: DataFrame) -> None:
        """The first version. ``Original_Classification`` is there from the start, null."""
        if ORIGINAL_LABEL not in classified.columns:
            classified = classified.withColumn(ORIGINAL_LABEL, F.lit(None).cast("string"))
        if self.versions.current() is not None:
            raise ValueError(f"{self.path} holds a table already")
        self._write(classified, 0, [])

    def parts(self) -> list[tuple[str, int]]:
        """(part, rows folder) of the current version."""
        return [(r[PART], r["rows"]) for r in self.versions.read().collect()]

    def _read(self, parts: list[tuple[str, int]]) -> DataFrame | None:
        if not parts:
            return None
        frames = [self.spark.read.parquet(f"{self.path}/rows-{n}/{PART}={p}") for p, n in parts]
        out = frames[0]
        for frame in frames[1:]:  # a frame for each label
            out = out.unionByName(frame)
        return out

    def read(self) -> DataFrame:
        """The current table; a table without rows has no part and can't be read."""
        out = self._read(self.parts())
        if out is None:
            raise ValueError(f"{self.path} holds no rows")
        return out

    def merge(self, corrections: DataFrame, key: str = ROW_KEY) -> list[str]:
        """Applies corrections (row_key, corrected_label, seq) as ``apply_corrections`` does; returns the
        parts rewritten. Rows that already stand as corrected count as untouched."""
        parts = self.parts()
        whole = self._read(parts)
        if whole is None:
            return []
        latest = latest_corrections(corrections, self.categories).select(F.col(ROW_KEY).alias("_ck"), F.col("corrected_label").alias("_cl"))
        stands = (F.col(LABEL).eqNullSafe(F.col("_cl")) & F.col(HUMAN_REVIEWED) & (F.col(CONFIDENCE) == CORRECTED_CONFIDENCE)
                  & (F.col(REASONING) == F.lit(CORRECTED_REASONING)) & F.col(ORIGINAL_LABEL).isNotNull())
        hits = whole.join(latest, F.col(key) == F.col("_ck")).where(~F.col(LABEL).eqNullSafe(F.lit(INVALID_LABEL)) & ~F.coalesce(stands, F.lit(False)))
        moves = hits.select(part_of(self.categories).alias("a"), F.col("_cl").alias(LABEL)).select("a", part_of(self.categories).alias("b")).distinct().collect()
        changed = sorted({p for m in moves for p in m})
        if not changed:
            return []
        fixed = apply_corrections(self._read([p for p in parts if p[0] in changed]), corrections, categories=self.categories, key=key)
        self._write(fixed, self.versions.current() + 1, [p for p in parts if p[0] not in changed])
        return changed
