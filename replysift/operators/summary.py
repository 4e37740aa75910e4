"""The run summary as Markdown, written by Spark string functions from the
A11 numbers (no model call). Percentages use integer arithmetic (tenths of a
percent, rounded down) so every engine prints the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_COLUMNS, TOP_ITEMS_SUMMARY, ListingColumns
from .analytics import summary_bundle


def summary_text(classified: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS,
                 k: int = TOP_ITEMS_SUMMARY) -> DataFrame:
    """One row, one column ``summary``. The bundle it reads has at most
    ``2 + labels + k`` rows, so the final one-group aggregate is tiny."""
    b = summary_bundle(classified, cols, k)
    total = b.where(F.col("section") == "total").select(F.col("n").alias("_total"))
    total_n = total.agg(F.max("_total")).scalar()
    tenths = F.expr("n * 1000").cast("long")
    # exact integer division: the numerator is made a multiple of the total first
    tenths = F.when(
        total_n > 0, ((tenths - F.pmod(tenths, total_n)) / total_n).cast("long")
    ).otherwise(F.lit(0)).cast("long")
    pct_txt = F.concat(
        ((tenths - F.pmod(tenths, F.lit(10))) / 10).cast("long").cast("string"), F.lit("."),
        F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%")
    )
    sec = F.col("section")
    line = (
        F.when(sec == "total", F.concat(F.lit("Total answers classified: "), F.col("n").cast("string")))
        .when(sec == "category", F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("n").cast("string"),
                                          F.lit(" ("), pct_txt, F.lit(")")))
        .otherwise(F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("n").cast("string")))
    )
    order = F.when(sec == "total", 0).when(sec == "category", 1).otherwise(2)
    lines = b.select(order.alias("o"), F.col("rank").alias("r"), line.alias("line"))
    agg = lines.agg(F.array_sort(F.collect_list(F.struct("o", "r", "line"))).alias("_l"))
    body = F.transform("_l", lambda x: x["line"])
    n_items = F.size(F.filter("_l", lambda x: x["o"] == 2))
    head = F.array(F.lit("## Classification summary"), F.lit(""))
    cat_head = F.array(F.lit(""), F.lit("### Answers per category"))
    item_head = F.array(F.lit(""), F.lit("### Form items with the most confused answers"))
    none_line = F.array(F.lit("- none"))
    parts = F.concat(
        head,
        F.slice(body, 1, 1),
        cat_head,
        F.filter(F.transform("_l", lambda x: F.when(x["o"] == 1, x["line"])), lambda s: s.isNotNull()),
        item_head,
        F.when(n_items > 0, F.filter(F.transform("_l", lambda x: F.when(x["o"] == 2, x["line"])),
                                     lambda s: s.isNotNull())).otherwise(none_line),
    )
    return agg.select(F.array_join(parts, "\n").alias("summary"))
