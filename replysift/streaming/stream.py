"""Structured Streaming entry points.

Validation and the rule scorer are row-local, so ``classify`` applies to a
streaming DataFrame unchanged. A stream of listing files becomes a classified
table (file sink, exactly-once through the checkpoint), running category counts,
alerts by event time, and the deciding correction of each row (versioned tables:
``sources.snapshots``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    CONFUSION_ALERT_RATE, DEFAULT_COLUMNS, DEFAULT_RULES, LABEL, NA_TOKENS, ROW_KEY, ListingColumns, RuleSet,
)
from ..functions.text import named
from ..operators.analytics import valid_only
from ..operators.classify import classify
from ..operators.review import deciding_corrections
from ..sources.listing import CORRUPT_COLUMN, guard_long_rows, normalise_null_tokens, record_schema
from ..sources.sinks import new_stage_path
from ..sources.snapshots import Snapshots


def read_csv_listing_stream(spark: SparkSession, directory: str, columns: list[str],
                            na_tokens=NA_TOKENS, max_files_per_trigger: int | None = None) -> DataFrame:
    """A directory of CSV listings with a known header, all columns as strings.

    Each file's header is checked against ``columns`` (another order or other names
    fail the stream instead of putting values into the wrong columns), and a row
    with more fields than the header fails it too."""
    r = (spark.readStream.schema(record_schema(columns, directory)).option("header", True).option("multiLine", True)
         .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", False)
         .option("columnNameOfCorruptRecord", CORRUPT_COLUMN))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalise_null_tokens(guard_long_rows(r.csv(directory), columns, directory), na_tokens)


def read_parquet_stream(spark: SparkSession, directory: str, schema: T.StructType,
                        glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)


def classify_stream(stream: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS,
                    rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The batch ``classify`` on a streaming DataFrame (no state, append mode)."""
    return classify(stream, cols, rules)


def write_classified(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the file sink; with ``available_now`` it processes what is there and stops."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_category_counts(classified_stream: DataFrame) -> DataFrame:
    """A2 on a stream: label -> n over valid rows (state = one row per label)."""
    return (valid_only(classified_stream).where(F.col(LABEL).isNotNull())
            .groupBy(F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).cast("long").alias("n")))


def _started(writer, available_now: bool):
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def write_snapshots(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """A complete-mode stream as a versioned table (``sources.snapshots``): readers follow its
    pointer and never see an empty or half table; an epoch run again changes nothing."""
    table = Snapshots(stream.sparkSession, path)
    writer = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: table.write(batch, epoch) and None)
    return _started(writer.option("checkpointLocation", checkpoint), available_now)


def write_counts(counts_stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Complete-mode counts, a snapshot for each micro-batch."""
    return write_snapshots(counts_stream, path, checkpoint, available_now)


def write_upserts(changes: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  available_now: bool = True, mode: str = "append"):
    """Keyed state as a versioned table: each micro-batch is united with the table and reduced by
    ``merge`` (rows -> one row for each of ``keys``).

    ``merge`` must not depend on the order of its rows (a maximum, say): then rows that come late,
    out of order or twice leave the table that a batch over all rows gives, with no watermark to drop them,
    and the state is a table on the shared store, not executor memory."""
    table = Snapshots(changes.sparkSession, path)

    def fold(batch: DataFrame, epoch: int) -> None:
        before = table.read()
        merged = merge(batch if before is None else before.unionByName(batch))
        if len(set(keys) - set(merged.columns)):
            raise ValueError(f"merge lost the keys {keys}")
        table.write(merged, epoch)

    writer = changes.writeStream.outputMode(mode).foreachBatch(fold)
    return _started(writer.option("checkpointLocation", checkpoint), available_now)


def write_corrections(corrections: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """R3 on a stream of corrections (row_key, corrected_label, seq): the table at ``path``
    holds the deciding correction of each row, ready for ``apply_corrections``."""
    return write_upserts(corrections.select(ROW_KEY, "corrected_label", "seq"), [ROW_KEY], deciding_corrections, path, checkpoint, available_now)


def windowed_alerts(classified: DataFrame, time_col: str, window: str = "1 day", late: str = "2 days",
                    cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """D1 over time: valid and confused rows of each event-time window and study.

    On a stream, state is kept for windows above the watermark (``late`` behind the newest event
    time) and dropped below it; update mode gives a window again whenever it changes. Times without a
    zone are cut into windows by their own clock, whatever the session's zone."""
    time = named(time_col)
    no_zone = isinstance(classified.schema[time_col].dataType, T.TimestampNTZType)
    if no_zone:  # event time needs a zone: read the clock as UTC, and back below
        time = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time))
    timed = valid_only(classified).select(time.alias("_at"), named(cols.study).alias("study"), LABEL).where(F.col("_at").isNotNull())
    if classified.isStreaming:
        timed = timed.withWatermark("_at", late)
    by_window = timed.groupBy(F.window("_at", window).alias("w"), "study")
    counted = by_window.agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col(LABEL) == F.lit("Confused")).alias("n_confused"))
    start = F.col("w.start")
    if no_zone:
        start = F.timestamp_add("MICROSECOND", F.unix_micros(start), F.lit("1970-01-01").cast("timestamp_ntz"))
    return counted.select(start.alias("window_start"), "study", "n_valid", "n_confused")


def alert_rates(windows: DataFrame, rate: float = CONFUSION_ALERT_RATE) -> DataFrame:
    """``windowed_alerts`` with the confused rate and whether it exceeds ``rate``."""
    share = F.col("n_confused").cast("double") / F.col("n_valid").cast("double")
    return windows.withColumns({"confused_rate": share, "alert": share > F.lit(rate)})


def latest_windows(rows: DataFrame) -> DataFrame:
    """The last state of each window and study: counts only grow."""
    return rows.groupBy("window_start", "study").agg(F.max("n_valid").alias("n_valid"), F.max("n_confused").alias("n_confused"))


def write_windowed_alerts(windows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """``windowed_alerts`` of a stream in update mode, folded into a versioned table."""
    return write_upserts(windows, ["window_start", "study"], latest_windows, path, checkpoint, available_now, mode="update")


def run_to_table(spark: SparkSession, classified_stream: DataFrame, name: str = "stream-classified") -> DataFrame:
    """Run a classified stream to completion (available-now) into a stage table and
    return that table as a batch DataFrame."""
    path = new_stage_path(spark, name)
    q = write_classified(classified_stream, path, new_stage_path(spark, name + "-checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(path)


def run_counts_to_table(spark: SparkSession, classified_stream: DataFrame,
                        name: str = "stream-counts") -> DataFrame:
    path = new_stage_path(spark, name)
    write_counts(running_category_counts(classified_stream), path, new_stage_path(spark, name + "-checkpoint")).awaitTermination()
    return Snapshots(spark, path).read()


def run_corrections_to_table(spark: SparkSession, corrections: DataFrame, name: str = "stream-corrections") -> DataFrame:
    path = new_stage_path(spark, name)
    write_corrections(corrections, path, new_stage_path(spark, name + "-checkpoint")).awaitTermination()
    return Snapshots(spark, path).read()


def run_alerts_to_table(spark: SparkSession, windows: DataFrame, name: str = "stream-alerts") -> DataFrame:
    path = new_stage_path(spark, name)
    write_windowed_alerts(windows, path, new_stage_path(spark, name + "-checkpoint")).awaitTermination()
    return alert_rates(Snapshots(spark, path).read())
