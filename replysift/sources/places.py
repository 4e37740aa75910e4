"""Where a row stood in the files it was read from (L5, U1): input order without a global sort.

A place is (file, start of the split, number inside the task). Inside one split the
number grows with the line or record; splits of a file are ordered by their start and files by
name. How the reader cut the files changes places but not the order, so positions made
from them are the same for 1 split and for 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = "_place"


def with_place(scan: DataFrame, place: str = PLACE) -> DataFrame:
    """``scan``, as a file reader returns it, with the place of each row.

    It must come before any filter or shuffle, and the result must be stored (a stage table)
    before positions are made of it: numbers hold for one run of the scan."""
    where = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"))
    return scan.select("*", where.alias(place))


def input_positions(df: DataFrame, parts: list[Column] | None = None, pos_col: str = "row_pos", place: str = PLACE) -> DataFrame:
    """``df`` with the 0-based position of each row: by the first of ``parts`` (conditions) that it
    meets, rows that meet none last, and inside each part in input order.

    Rows of one split are numbered in a window over that split and part, so a group is never larger than
    an input split; whole splits are then shifted by a prefix sum over one row for each split and
    part. No row passes through a global sort."""
    part = F.lit(len(parts or []))
    for i, condition in reversed(list(enumerate(parts or []))):
        part = F.when(F.coalesce(condition, F.lit(False)), F.lit(i)).otherwise(part)
    d = df.withColumns({"_pp_part": part, "_pp_file": F.col(f"{place}.file"), "_pp_split": F.col(f"{place}.split")})
    keys = ["_pp_part", "_pp_file", "_pp_split"]
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pp_n"))
    # one row for each split and part: the only window that sees them all
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_pp_before", F.coalesce(F.sum("_pp_n").over(before), F.lit(0))).drop("_pp_n")
    inside = Window.partitionBy(*keys).orderBy(F.col(f"{place}.row"))
    numbered = d.withColumn("_pp_row", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, keys)
    return joined.withColumn(pos_col, (F.col("_pp_before") + F.col("_pp_row")).cast("long")).drop(*keys, "_pp_row", "_pp_before")
