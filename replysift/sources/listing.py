"""Reading a listing and giving every row a stable identity (S1-S7, SURVEY 1.3).

A listing is any table with a free-text answer column; every other column
rides along untouched. Columns are read as strings: no type inference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_COLUMNS, NA_TOKENS, OUTPUT_COLUMNS, PREVIEW_ROWS, ROW_KEY, ListingColumns
from ..functions.text import named, null_if_token

CORRUPT_COLUMN = "_bad_record"
SURPLUS_COLUMN = "_surplus_record"


def csv_reader(spark: SparkSession, multiline: bool = True):
    """CSV options that read quoted fields with embedded commas, line breaks and
    doubled quotes. ``multiline=False`` lets Spark split large files, at the price
    of not supporting line breaks inside fields."""
    return (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
    )


def read_listing_csv(
    spark: SparkSession,
    path: str,
    na_tokens=NA_TOKENS,
    multiline: bool = True,
    on_long_rows: str = "raise",
    partition_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Read a CSV listing, all columns as strings, null tokens applied.

    Short rows are padded with null (kept). Rows with more fields than the
    header are an error, or kept (``"keep"``) with their whole record in the column
    ``_surplus_record`` (null in all other rows). ``"raise"`` checks at once,
    with one extra parse of the input. ``"raise_on_read"`` needs no extra
    pass: every column carries the check (``raise_error``), so the first job
    that reads any value of a long row fails. Column pruning cannot drop the
    check, but a job that reads no column at all (a bare ``count()``) does not
    run it. Use it for large inputs that are classified or staged anyway.
    ``partition_columns`` names columns that come from folder names, not from the file.
    """
    if on_long_rows not in ("raise", "raise_on_read", "keep"):
        raise ValueError(f"unknown on_long_rows {on_long_rows!r}")
    header = [c for c in csv_reader(spark, multiline).csv(path).columns if c not in partition_columns]
    if not header:
        raise ValueError(f"{path}: no header row")
    raw = (
        csv_reader(spark, multiline)
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .schema(T.StructType([*record_schema(header, path).fields, *[T.StructField(c, T.StringType()) for c in partition_columns]]))
        .csv(path)
    )
    if on_long_rows == "raise":
        # the reader flags records only when it also reads a value, so one is asked for
        if raw.where(is_long_row(len(header))).select(named(header[-1]), CORRUPT_COLUMN).take(1):
            raise ValueError(f"{path}: a row has more fields than the header")
    if on_long_rows == "raise_on_read":
        return normalise_null_tokens(guard_long_rows(raw, header, path, partition_columns), na_tokens)
    if on_long_rows == "keep":
        surplus = F.when(is_long_row(len(header)), F.col(CORRUPT_COLUMN)).alias(SURPLUS_COLUMN)
        kept = normalise_null_tokens(raw.select(*[named(c) for c in [*header, *partition_columns]], surplus), na_tokens, header)
        return kept
    return normalise_null_tokens(raw.drop(CORRUPT_COLUMN), na_tokens)


def record_schema(header: list[str], path: str) -> T.StructType:
    """All columns as strings, plus the raw record of rows with another number of fields."""
    for reserved in (CORRUPT_COLUMN, SURPLUS_COLUMN):
        if reserved in header:
            raise ValueError(f"{path}: column name {reserved!r} is reserved")
    return T.StructType([T.StructField(c, T.StringType(), True) for c in [*header, CORRUPT_COLUMN]])


def is_long_row(n_columns: int) -> Column:
    """The reader flagged the record, and it has more fields than the header: quoted
    parts are dropped (a doubled quote ends one and starts the next), separators counted."""
    record = F.col(CORRUPT_COLUMN)
    separators = F.regexp_count(F.regexp_replace(record, '"[^"]*+"', ""), F.lit(","))
    return record.isNotNull() & (separators >= F.lit(n_columns))


def guard_long_rows(raw: DataFrame, header: list[str], path: str, others: tuple[str, ...] = ()) -> DataFrame:
    """The header's columns, each failing the job on a row with surplus fields."""
    fail = F.raise_error(F.lit(f"{path}: a row has more fields than the header"))
    long_row = is_long_row(len(header))
    return raw.select(*[F.when(long_row, fail).otherwise(named(c)).alias(c) for c in header], *[named(c) for c in others])


def normalise_null_tokens(df: DataFrame, na_tokens=NA_TOKENS, columns=None) -> DataFrame:
    """Raw values equal to one of ``na_tokens`` become null, in every string column."""
    if not na_tokens:
        return df
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_if_token(named(c), na_tokens) for c in cols})


def listing_profile(df: DataFrame) -> DataFrame:
    """One row with the number of rows and of the listing's own columns (not
    the row key or the surplus record that this package adds)."""
    own = [c for c in df.columns if c not in (ROW_KEY, SURPLUS_COLUMN)]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(own)).cast("long")
    )


@dataclass(frozen=True)
class ColumnReport:
    missing: tuple[str, ...]
    available: tuple[str, ...]
    response_present: bool

    @property
    def ok(self) -> bool:
        return not self.missing


def check_columns(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, strict: bool = True) -> ColumnReport:
    """Which wanted role columns are missing. Runs no job.

    The response column is required (raises when ``strict``); the item column
    is wanted (reported, not required).
    """
    available = tuple(df.columns)
    missing = tuple(c for c in (cols.response, cols.item) if c not in available)
    report = ColumnReport(missing, available, cols.response in available)
    if strict and not report.response_present:
        raise ValueError(
            f"response column {cols.response!r} not found; available: {list(available)}"
        )
    return report


def column_fill(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """S5 + S6 as a table: for each role its column, whether the listing has it, how many rows fill
    it (not null) and how many rows there are; one aggregate, unpivoted."""
    roles = cols.roles()
    counts = [F.count(named(c) if c in df.columns else F.lit(None)).alias(f"_f{i}") for i, c in enumerate(roles.values())]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    rows = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"_f{i}").alias("n_filled"))
        for i, (role, c) in enumerate(roles.items())
    ])
    return one.select(F.inline(rows), "n_rows")


def check_no_output_collision(df: DataFrame) -> None:
    clash = [c for c in OUTPUT_COLUMNS if c in df.columns]
    if clash:
        raise ValueError(f"input already has output column(s) {clash}; rename them first")


def preview_rows(df: DataFrame, n: int = PREVIEW_ROWS, order_by: str = ROW_KEY) -> DataFrame:
    """First ``n`` rows in a fixed order (a top-k, not a full sort)."""
    if order_by in df.columns:
        return df.orderBy(named(order_by)).limit(n)
    return df.limit(n)


# ---------------------------------------------------------------------------
# Row identity
# ---------------------------------------------------------------------------

_SEP = "\x1f"


def row_fingerprint(df: DataFrame, columns=None) -> Column:
    """sha-256 hex of the row's values (null distinct from any string)."""
    cols = columns or df.columns
    parts = [
        F.when(named(c).isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), named(c).cast("string")))
        for c in cols
    ]
    return F.sha2(F.concat_ws(_SEP, *parts), 256)


def with_row_key(
    df: DataFrame,
    id_col: str | None = None,
    key_col: str = ROW_KEY,
    salts: int | None = None,
    trust_ids: bool = False,
) -> DataFrame:
    """Give every row a unique, stable ``row_key``.

    With ``id_col`` the key is that value where it is present and unique. Rows that
    share an id or have none are keyed by content instead (``fingerprint-ordinal``,
    with ``#`` before it), so they neither multiply in a join nor take each other's
    correction. The check is one narrow aggregate over the ids, run at once: ids that repeat
    or are missing go to a stage table. With none the key is a projection, and no row
    moves; otherwise those rows alone are stored and numbered, and the others stay where they
    are. ``trust_ids`` leaves the check out for ids known to be unique (a stream has no other choice). Without
    ``id_col`` the key is ``fingerprint-ordinal``: the sha-256 of
    the row plus its ordinal among exact copies (copies are interchangeable,
    so any assignment of ordinals is right).

    Copies of one row may be a large share of the table, so ordinals are not
    numbered in one task per fingerprint: rows are split by a salt (by default
    the input partition itself, so a salt group is never larger than one input
    split, however hot the row), numbered within (fingerprint, salt), and
    shifted by the sizes of the earlier salts of the same fingerprint. Only
    fingerprints present in more than one salt need a shift; that table is
    usually tiny and adaptive execution broadcasts it when it is. ``salts``
    folds partitions into fewer salts (tests).

    Persist the result (stage table) before keys are used across jobs.
    """
    if id_col is not None:
        key = named(id_col).cast("string")
        if trust_ids or df.isStreaming:
            return df.withColumn(key_col, key)
        from .sinks import stage  # that module imports this one

        shared = df.groupBy(key.alias("_rk_id")).agg(F.count(F.lit(1)).alias("_rk_n"))
        shared = stage(shared.where((F.col("_rk_n") > 1) | F.col("_rk_id").isNull()).select("_rk_id"), "shared-ids")
        if not shared.take(1):
            return df.withColumn(key_col, key)
        same = key.eqNullSafe(F.col("_rk_id"))
        bad = stage(df.join(shared, same, "left_semi"), "shared-id-rows")
        bad = with_row_key(bad, None, key_col, salts).withColumn(key_col, F.concat(F.lit("#"), named(key_col)))
        return df.join(shared, same, "left_anti").withColumn(key_col, key).unionByName(bad)

    data_cols = [c for c in df.columns if c != key_col]
    fp, salt, rn, off = "_rk_fp", "_rk_salt", "_rk_rn", "_rk_off"
    pid = F.spark_partition_id()
    d = df.withColumn(fp, row_fingerprint(df, data_cols)).withColumn(
        salt, pid if salts is None else F.pmod(pid, F.lit(salts))
    )
    group = Window.partitionBy(fp, salt)
    numbered = d.withColumn(rn, F.row_number().over(group.orderBy(fp)))
    # Group sizes by a hash aggregate: with the input partition as salt, the
    # map-side partial aggregate already holds the whole count of a (fp, salt)
    # group, so only one narrow row per group and split is shuffled (no sort,
    # no per-row exchange, however hot the row).
    sizes = d.groupBy(fp, salt).agg(F.count(F.lit(1)).alias("_n"))
    offsets = (
        sizes.withColumn("_nsalts", F.count(F.lit(1)).over(Window.partitionBy(fp)))
        .where(F.col("_nsalts") > 1)
        .withColumn(
            off,
            F.sum("_n").over(Window.partitionBy(fp).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(fp, salt, F.coalesce(F.col(off), F.lit(0)).alias(off))
    )
    keyed = numbered.join(offsets, [fp, salt], "left").withColumn(
        key_col,
        F.concat(
            F.col(fp), F.lit("-"),
            (F.col(rn) + F.coalesce(F.col(off), F.lit(0))).cast("string"),
        ),
    )
    return keyed.drop(fp, salt, rn, off)


def is_unique(df: DataFrame, column: str) -> bool:
    """Action: True when ``column`` is non-null and unique (check before keying by it)."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(named(column)).alias("d"),
        F.count(named(column)).alias("nn"),
    ).first()
    return row["n"] == row["d"] == row["nn"]


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of an unevenly split input over ``partitions`` tasks for the
    CPU-heavy text work; without ``partitions`` the input stays as it is split.
    The caller decides: nothing here looks at the size, and no job runs."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)
