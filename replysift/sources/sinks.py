"""Sinks: full CSV export (S8), one output per category (S9, S10) and stage
tables between steps (S11).

Stage tables live under the shared folder the cluster names in
``spark.checkpoint.dir``; a folder is chosen only when that is unset (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    CATEGORIES, CONFIDENCE, HUMAN_REVIEWED, IS_VALID, LABEL, ORIGINAL_LABEL,
)
from ..functions.text import category_slug
from ..functions.text import named
from .listing import read_listing_csv
from .snapshots import Folder

SLUG_COLUMN = "category_slug"


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir`` of the session.

    Only when it is unset and the master is local (tests, single machine) a
    folder is made and set. On a cluster a machine-local folder would be
    invisible to the other executors, so an unset directory is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # no context in a remote session
            root = None
    if not root:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder (e.g. on the "
                "cluster file system) for stage tables"
            )
        root = tempfile.mkdtemp(prefix="replysift-stage-")
        # spark.checkpoint.dir is a static setting (cannot be changed at run
        # time in Spark 4); the context's checkpoint folder is what later
        # calls and DataFrame.checkpoint() read.
        try:
            sc = spark.sparkContext
            sc.setCheckpointDir(root)
            # later calls read the folder back from the context (Spark adds a
            # sub-folder per context): use that one from the first call on
            root = sc.getCheckpointDir() or root
        except Exception:  # remote session: keep it in the session conf if allowed
            try:
                spark.conf.set("spark.checkpoint.dir", root)
            except Exception:
                pass
    return root.rstrip("/")


class StageScope:
    """Stage folders made inside ``stage_scope``; those of kept results outlive it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self._kept = spark, [], set()

    def keep(self, result: DataFrame) -> DataFrame:
        """``result``, whose stage folders stay until they are removed by hand (``remove_stages``)."""
        read = [f.split(":", 1)[-1].lstrip("/") for f in result.inputFiles()]
        for path in self.made:
            inside = path.split(":", 1)[-1].strip("/") + "/"
            if any(f.startswith(inside) for f in read):
                self._kept.add(path)
        return result

    def remove_stages(self, kept_too: bool = False) -> list[str]:
        gone = [p for p in self.made if kept_too or p not in self._kept]
        for path in gone:
            Folder(self.spark, path).remove()
        self.made = [p for p in self.made if p not in gone]
        return gone


_SCOPE: ContextVar[StageScope | None] = ContextVar("stage_scope", default=None)


@contextmanager
def stage_scope(spark: SparkSession):
    """The life of stage tables. Folders made inside are removed at its end, also after
    an error, but for those that a kept result still reads; an inner scope has folders of its own."""
    scope = StageScope(spark)
    token = _SCOPE.set(scope)
    try:
        yield scope
    except BaseException:
        scope._kept.clear()
        raise
    finally:
        _SCOPE.reset(token)
        scope.remove_stages()


def new_stage_path(spark: SparkSession, name: str) -> str:
    path = f"{stage_root(spark)}/replysift/{name}-{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.made.append(path)
    return path


def write_stage(df: DataFrame, path: str, partition_by=None) -> None:
    """Persist a step's output as Parquet (replaces a driver-side copy)."""
    if partition_by:
        # a part's rows meet in files of the advised size (large parts split), not in one file for each task and part
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def stage(df: DataFrame, name: str, partition_by=None) -> DataFrame:
    """Write ``df`` to a new stage table and read it back: cuts lineage, and
    makes later actions reuse the stored rows instead of recomputing them.

    ``partition_by`` (low-cardinality columns, e.g. the label) lays the table
    out in folders so that filters on them prune whole folders. The table is
    read back with the original schema (no type guessing from folder names)
    and the original column order."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    write_stage(df, path, partition_by)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*[F.col(f"`{c}`") for c in df.columns]) if partition_by else back


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header, quotes doubled, UTF-8. ``single_file`` funnels the
    output through one task; keep it for small exports only."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        # keep blanks around values: " N/A" must not come back as the token "N/A"
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


_TYPED = {
    IS_VALID: T.BooleanType(),
    CONFIDENCE: T.DoubleType(),
    HUMAN_REVIEWED: T.BooleanType(),
}


def read_classified_csv(spark: SparkSession, path: str, multiline: bool = True,
                        partition_columns: tuple[str, ...] = ()) -> DataFrame:
    """Read back an exported classified listing: strings, null tokens applied,
    then the known output columns cast back to their types (``try_cast``: a bad
    value becomes null instead of failing the job)."""
    df = read_listing_csv(spark, path, multiline=multiline, on_long_rows="raise_on_read", partition_columns=partition_columns)
    return df.withColumns({
        c: named(c).try_cast(t) for c, t in _TYPED.items() if c in df.columns
    })


def export_by_category(df: DataFrame, path: str, categories=CATEGORIES) -> None:
    """One CSV folder per category with rows, in one job (``partitionBy``).

    ``INVALID`` and unknown labels are left out; categories without rows
    produce nothing. Folder names are ``category_slug=<slug>`` (S10).
    """
    out = df.where(F.col(LABEL).isin(*categories)).withColumn(SLUG_COLUMN, category_slug(LABEL))
    (
        out.write.mode("overwrite")
        .partitionBy(SLUG_COLUMN)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_category_export(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """Read an S9 export back; ``slug`` reads one category only (partition pruning)."""
    df = read_classified_csv(spark, path, partition_columns=(SLUG_COLUMN,))
    if slug is not None:
        df = df.where(F.col(SLUG_COLUMN) == slug)
    return df


__all__ = [
    "SLUG_COLUMN", "StageScope", "stage_scope", "stage_root", "new_stage_path", "write_stage", "stage", "write_csv",
    "read_classified_csv", "export_by_category", "read_category_export", "ORIGINAL_LABEL",
]
