"""Document fingerprints (10): winnowing over rolling k-gram hashes, in Spark expressions only.

A text is read as units: runs of characters other than blanks (``\\x20`` and
``\\x09-\\x0D``), longer runs cut after ``UNIT_CHARS`` characters. Every ``k``
units in a row give one hash; of every ``window`` consecutive hashes the least is
selected, the rightmost of equal ones, and kept with its position. Two texts that
share a run of at least ``k + window - 1`` units share a selected hash (the match
guarantee) and the positions say where; nothing shorter than ``k`` units is ever
matched. The cuts of a run without blanks are counted from its start: text without
blanks (Chinese, Japanese, Thai, minified code, long encodings) has the match guarantee
only where a shared passage lies at the same offset modulo ``UNIT_CHARS`` in its run; one
character put in before it may leave no hash in common. Units rather than characters: at the same guarantee in text length there
are about six times fewer hashes to make, and blanks don't count.

A hash (36 bits) and its position (27 bits, counted from the end) are packed in
one long, so the plain minimum of packed values is the least hash at its
rightmost place, and the minimum over a window comes from log2(window) pairwise
minima instead of one scan for each window.

Defined cases: a null text, an empty one or one of blanks has no fingerprint (an
empty string); a text below ``k`` units is one gram; one with fewer grams than a
window selects its least gram. Two empty fingerprints are alike to 1, an empty
and another to 0. Texts of 2**27 units or more raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, without

K, WINDOW = 4, 4
UNIT_CHARS = 16
POSITION_BITS = 27


def unit_hashes(text: Column) -> Column:
    """array<long>: a hash of every unit of a text."""
    units = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]{1,%d}" % UNIT_CHARS), F.lit(0))
    return F.coalesce(F.transform(units, lambda u: F.xxhash64(u)), F.array().cast("array<long>"))


def packed_grams(units: Column, k: int = K) -> Column:
    """array<long>: hash and position (from the end) of every ``k`` units in a row;
    the one gram of a shorter text is made of what there is."""
    limit = (1 << POSITION_BITS) - 1
    grams = F.greatest(F.size(units) - F.lit(k - 1), F.least(F.size(units), F.lit(1)))
    checked = F.when(grams < limit, grams).otherwise(F.raise_error(F.lit("text too long for a fingerprint")).cast("int"))

    def gram(unit, i):
        h = F.xxhash64(unit, *[F.get(units, i + F.lit(j)) for j in range(1, k)])
        return F.shiftleft(F.shiftright(h, 64 - 36), POSITION_BITS) + (F.lit(limit) - i).cast("long")

    return F.transform(F.slice(units, F.lit(1), checked), gram)


def selected(df: DataFrame, text_col: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: array<long> of selected packed grams, in text order.

    Minima over 2, 4, 8, ... neighbours are built in turn. Past the end ``get`` is
    null, which ``least`` skips. Neighbouring windows mostly select the same gram,
    and packed values are distinct, so ``array_distinct`` leaves each one once.
    """
    if window & (window - 1):
        raise ValueError("window is a power of two")
    name = "__w__"
    step = df.withColumn(name, unit_hashes(quoted(text_col))).withColumn(name, packed_grams(F.col(name), k))
    span = 1
    while span < window:
        ahead = F.lit(span)
        step = step.withColumn(name, F.transform(F.col(name), lambda x, i: F.least(x, F.get(F.col(name), i + ahead))))
        span *= 2
    full = F.greatest(F.size(name) - F.lit(window - 1), F.least(F.size(name), F.lit(1)))
    minima = F.slice(F.col(name), F.lit(1), full)
    return step.withColumn(name, minima).withColumn(out, F.array_distinct(F.col(name))).drop(name)


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POSITION_BITS)))


def positions(packed: Column) -> Column:
    """0-based unit positions of the selected grams."""
    limit = (1 << POSITION_BITS) - 1
    return F.transform(packed, lambda x: (F.lit(limit) - x.bitwiseAND(F.lit(limit))).cast("int"))


def as_string(packed: Column) -> Column:
    """``hash@position`` of every selected gram, hash in hex."""
    limit = (1 << POSITION_BITS) - 1
    mask = (1 << 36) - 1
    return F.array_join(F.transform(packed, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, POSITION_BITS).bitwiseAND(F.lit(mask)))), F.lit("@"),
        (F.lit(limit) - x.bitwiseAND(F.lit(limit))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct hash arrays; two empty ones: 1."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(df: DataFrame, text_col: str = "text", k: int = K, window: int = WINDOW,
                 out: str = "fingerprint") -> DataFrame:
    """Adds ``out``: array<struct<hash long, position int>> of the selected grams."""
    made = selected(df.select(*[quoted(c) for c in without(df, [out])]), text_col, "__s__", k, window)
    return made.withColumn(out, F.arrays_zip(
        F.transform("__s__", lambda x: F.shiftright(x, POSITION_BITS)).alias("hash"),
        positions(F.col("__s__")).alias("position"))).drop("__s__")


def next_in_order(docs: DataFrame, id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """(id, text, __b, __halo): rows dealt into ranges of the id, each range followed by a
    copy of the first rows of the next one (of the first range after the last).

    The range bounds are ids that occur (quantiles of one narrow pass; their
    number is a setting, not a function of the data), so every range starts with
    its bound. Rows without an id lie in ranges of their own, without neighbours.
    """
    ids = quoted(id_col).cast("long")
    share = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)]) if n_buckets > 1 else F.array(F.lit(0.5))
    found = docs.select(ids.alias("i")).agg(F.min("i"), F.percentile_approx("i", share, F.lit(10_000))).first()
    bounds = sorted({found[0], *(found[1] or [])}) if found[0] is not None else []
    values = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    rows = docs.select(ids.alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    own = F.when(F.col("id").isNull(), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(n_buckets)).cast("int")) \
        .otherwise(F.size(F.filter(values, lambda b: b <= F.col("id"))) - 1)
    before = F.pmod(F.array_position(values, F.col("id")).cast("int") - 2, F.lit(max(1, len(bounds))))
    starts = F.coalesce(F.array_contains(values, F.col("id")), F.lit(False))
    places = F.when(starts, F.array(F.struct(own.alias("b"), F.lit(False).alias("halo")),
                                    F.struct(before.alias("b"), F.lit(True).alias("halo")))) \
        .otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("halo"))))
    return rows.withColumn("__p", F.explode(places)).select("id", "text", F.col("__p.b").alias("__b"), F.col("__p.halo").alias("__halo"))


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                     window: int = WINDOW, n_buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next text; next is by ascending (id, text), after the
    last comes the first. A row without an id has no next text: its edited text
    is its first half. One shuffle of the texts by id range; each range is
    ordered in one task.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = next_in_order(docs, id_col, text_col, n_buckets or parts).repartition(parts, "__b")
    own = selected(placed, "text", "__fp", k, window).withColumn("__h", hashes(F.col("__fp")))
    order = W.partitionBy("__b").orderBy("__halo", "id", "text")
    known = F.col("id").isNotNull()
    rows = (
        own.withColumn("__nt", F.when(known, F.lead("text").over(order)))
        .withColumn("__nh", F.when(known, F.lead("__h").over(order)))
        .where(~F.col("__halo"))
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                           F.coalesce(F.left("__nt", half), F.lit(""))))
    return selected(rows, "edited", "__efp", k, window).withColumn("__eh", hashes(F.col("__efp"))).select(
        F.col("id").alias(id_col), "n_chars", "text", "edited", F.col("__fp").alias("selected"),
        F.col("__efp").alias("edited_selected"), as_string(F.col("__fp")).alias("fingerprint"),
        as_string(F.col("__efp")).alias("edited_fingerprint"),
        likeness(F.col("__h"), F.col("__eh")).alias("near_edited"),
        likeness(F.col("__h"), F.coalesce(F.col("__nh"), F.array().cast("array<long>"))).alias("near_next"),
    )


def q_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edit_and_compare(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")
