"""Documents with every odd case: nulls in any column, empty and long texts, ties, repeated rows."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
PROSE = "The committee met on Tuesday and agreed that the old bridge should be painted before winter comes again."
ROWS = [
    (5, PROSE, "en", "a", 104), (5, PROSE, "en", "a", 104),  # a repeated row
    (7, PROSE, "en", "b", 104),  # an equal text
    (9, PROSE.replace("Tuesday", "Monday"), None, "b", None),
    (None, "no id here\nat all", "en", "a", 17), (None, None, None, None, None),
    (11, None, "fr", None, 0), (12, "", "fr", "", 0), (13, " \t\n ", "fr", "c", 4), (14, "\n\n", None, None, 2),
    (15, LONG, "en", "a", len(LONG)), (16, "x" * 300_000, "en", "c", 300_000),
    (17, "été – 日本語 😀\nnaïve space end", "fr", "c", 20), (18, "one", "en", "a", 3), (19, "One\none\n ONE ", "en", "a", 12),
    (20, "a b c d e f g a b c d e f g", "en", "b", 27), (20, "same id, other text", "en", "b", 19),
]


def odd_documents(spark, clash=()):
    """``clash``: names of extra columns that an output also has."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("own") for c in clash}) if clash else df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
