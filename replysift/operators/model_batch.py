"""Classification by an external model, as Spark jobs.

The model itself is not part of this package: the caller passes a factory
that returns ``call(prompt: str) -> str | None``. It is built once per task
(one client per partition) and called once per batch of rows.

Plan:

1. M1  valid rows get a bucket (a hash of the row key, or a numeric id divided by
       a fixed width, so that buckets grow in number with the table); inside a
       bucket ``row_number`` by row key gives ``batch`` and ``pos``. One shuffle
       (a fixed number of partitions, several buckets each); a hot study or item
       cannot make one bucket heavy.
2. M2/M3  one prompt per (bucket, batch): ``collect_list`` of at most
       ``batch_size`` lines, sorted by position. The grouping reuses the
       bucket partitioning: no second shuffle.
3. M4  ``mapInPandas`` calls the model; the batch's row keys ride along.
4. Replies are written to a stage table before anything reads them: a
       model is not idempotent, and a recomputed partition must not call it
       again with possibly different answers.
5. M5-M9  parse the reply with native expressions, match results to rows by
       position, fall back per position, then one equi-join on ``row_key``
       brings the results to the listing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import (
    BATCH_SIZE_DEFAULT, BATCH_SIZE_RANGE, CATEGORIES, CATEGORY_DESCRIPTIONS, DEFAULT_COLUMNS,
    FALLBACK_CONFIDENCE, FALLBACK_LABEL, FALLBACK_REASONING, IS_VALID, ROW_KEY, ListingColumns,
)
from ..functions.text import model_text, named, unicode_trim
from ..sources.sinks import stage
from ..sources.snapshots import Folder
from .classify import stamp_results, validate

#: Width of a bucket when rows are dealt by a numeric id.
BUCKET_ROWS = 300
REPLY_SCHEMA = "array<struct<index:int,classification:string,confidence:string,reasoning:string>>"


def default_instructions(categories=CATEGORIES, descriptions=None) -> str:
    """What the model is told before the rows. ``categories`` may be any names;
    ``descriptions`` says what each is for (default: the standard ones)."""
    descriptions = CATEGORY_DESCRIPTIONS if descriptions is None else descriptions
    named_ones = "\n".join(f"  {i}. {c}" + (f" = {descriptions[c]}" if descriptions.get(c) else "") for i, c in enumerate(categories, 1))
    return (
        "TASK: label answers that came back for questions about collected data.\n"
        f"LABELS:\n{named_ones}\n"
        "INPUT: JSON Lines. \"answer\" is what you label; \"item\" only tells where it was given.\n"
        "OUTPUT: one JSON list and nothing else, an entry for every input line in the same order, with keys "
        "index, classification (a label as spelled above), confidence (0 to 1), reasoning (short)."
    )


def batch_rows(
    validated: DataFrame,
    cols: ListingColumns = DEFAULT_COLUMNS,
    batch_size: int = BATCH_SIZE_DEFAULT,
    n_buckets: int | None = None,
    bucket_by: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """M1 + M2: ``(row_key, bucket, batch, pos, line)`` for every valid row.

    ``bucket_by`` (an integral column) replaces the hash: rows whose value divided by
    ``bucket_rows`` is the same share a bucket, whatever the size of the table. The last
    batch of a bucket may be short.
    ``n_buckets`` defaults to 8 per shuffle partition: buckets are hashed onto
    partitions, and with one bucket per partition about a third of the
    partitions would get none (and others two or more).
    """
    lo, hi = BATCH_SIZE_RANGE
    if not lo <= batch_size <= hi:
        raise ValueError(f"batch_size must be within {lo}-{hi}")
    if ROW_KEY not in validated.columns:
        raise ValueError("add a row key first (sources.listing.with_row_key)")
    spark = validated.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = n_buckets or 8 * n_parts
    key = F.col(ROW_KEY)
    if bucket_by is None:
        bucket = F.pmod(F.xxhash64(key), F.lit(n))
    else:
        bucket = F.floor(named(bucket_by).cast("long") / F.lit(bucket_rows))
    item = named(cols.item) if cols.item in validated.columns else None
    v = validated.where(F.col(IS_VALID)).select(
        key, bucket.cast("long").alias("bucket"),
        model_text(item).alias("_item"), model_text(named(cols.response)).alias("_resp"),
    )
    # A fixed-number hash repartition on the bucket takes the place of the
    # window's own exchange (no extra shuffle), and adaptive execution keeps
    # its partitions: the prompt table is small in bytes, so a coalesced
    # shuffle would put every model call of the job into one serial task.
    v = v.repartition(n_parts, "bucket")
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy(ROW_KEY)) - 1
    v = v.withColumn("_rn", rn)
    pos = F.pmod(F.col("_rn"), F.lit(batch_size))
    return v.select(
        key, "bucket",
        F.floor(F.col("_rn") / F.lit(batch_size)).cast("long").alias("batch"),
        pos.cast("long").alias("pos"),
        # a JSON object: quotes and line breaks in an answer cannot end it
        F.to_json(F.struct(F.col("_item").alias("item"), F.col("_resp").alias("answer"))).alias("line"),
    )


def build_prompts(batched: DataFrame, instructions: str | None = None) -> DataFrame:
    """M3: one row per (bucket, batch): ``n_rows``, ``row_keys`` in position
    order and the prompt text."""
    instructions = default_instructions() if instructions is None else instructions
    g = batched.groupBy("bucket", "batch").agg(
        F.array_sort(F.collect_list(F.struct("pos", ROW_KEY, "line"))).alias("_rows")
    )
    n = F.size("_rows")
    return g.select(
        "bucket", "batch",
        n.cast("long").alias("n_rows"),
        F.transform("_rows", lambda r: r[ROW_KEY]).alias("row_keys"),
        F.concat(
            F.lit(instructions), F.lit("\nLINES: "), n.cast("string"), F.lit("\n"),
            F.array_join(F.transform("_rows", lambda r: r["line"]), "\n"),
        ).alias("prompt"),
    )


ScorerFactory = Callable[[], Callable[[str], "str | None"]]


def call_model(prompts: DataFrame, scorer_factory: ScorerFactory, max_parallel: int | None = None) -> DataFrame:
    """M4: ``reply`` per prompt; a call that raises gives a null reply.
    ``max_parallel`` caps concurrent calls (one task calls serially)."""
    from ..session import ship_package

    ship_package(prompts.sparkSession)
    src = prompts.select("bucket", "batch", "row_keys", "prompt")
    if max_parallel:
        src = src.repartition(max_parallel)

    def run(frames):
        call = scorer_factory()
        for pdf in frames:
            replies = []
            for p in pdf["prompt"]:
                try:
                    r = call(p)
                except Exception:  # a failed call falls back like an unreadable reply
                    r = None
                replies.append(None if r is None else str(r))
            yield pd.DataFrame({
                "bucket": pdf["bucket"], "batch": pdf["batch"], "row_keys": pdf["row_keys"],
                "reply": pd.Series(replies, dtype=object),
            })

    return src.mapInPandas(run, "bucket long, batch long, row_keys array<string>, reply string")


def ledger_replies(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, reply) of the ledger, one reply for each prompt; empty before the first call."""
    schema = "digest string, reply string"
    if not Folder(spark, ledger).names():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger).groupBy("digest").agg(F.min("reply").alias("reply"))


def with_digest(prompts: DataFrame) -> DataFrame:
    """``prompts`` with ``digest``, the SHA-256 by which a ledger knows them."""
    return prompts.withColumn("digest", F.sha2("prompt", 256))


def open_prompts(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, prompt) of the prompts (see ``with_digest``) that the ledger ``known`` (digest) lacks, each once."""
    return keyed.select("digest", "prompt").join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("prompt").alias("prompt"))


def call_open_prompts(prompts: DataFrame, scorer_factory: ScorerFactory, ledger: str, max_parallel: int | None = None,
                      waves: int = 8) -> DataFrame:
    """M4 with a memory: replies are kept in a Parquet ledger by the SHA-256 of their prompt, and only
    prompts that it lacks are asked. Returns what ``call_model`` returns.

    Open prompts are asked in ``waves`` jobs (by digest), and each job's replies are in the
    ledger when it ends: a rerun after a lost job asks at most the wave that was lost again. Equal
    prompts are asked once. A call that failed leaves nothing behind and is asked again next time. One
    writer at a time."""
    if waves < 1:
        raise ValueError("waves must be at least 1")
    spark = prompts.sparkSession
    keyed = stage(with_digest(prompts), "model-prompts")
    asked = open_prompts(keyed, ledger_replies(spark, ledger))
    asked = stage(asked.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")), "model-open", partition_by=["wave"])
    for wave in [r["wave"] for r in asked.select("wave").distinct().orderBy("wave").collect()]:  # at most ``waves``
        one = asked.where(F.col("wave") == wave).select(
            F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.array("digest").alias("row_keys"), "prompt")
        replies = call_model(one, scorer_factory, max_parallel or int(spark.conf.get("spark.sql.shuffle.partitions")))
        replies.where(F.col("reply").isNotNull()).select(F.col("row_keys")[0].alias("digest"), "reply").write.mode("append").parquet(ledger)
    return keyed.join(ledger_replies(spark, ledger), "digest", "left").select("bucket", "batch", "row_keys", "reply")


def reply_array_text(reply: Column) -> Column:
    """M5 + M6: drop a Markdown fence, then take the first ``[`` to the last ``]``
    across lines; ``''`` when there is none."""
    t = unicode_trim(reply)
    fenced = F.regexp_replace(
        F.regexp_replace(t, "\\A[^\\n]*\\n", ""), "(?s)```(?:(?!```).)*\\z", ""
    )
    t = F.when(t.startswith("```"), fenced).otherwise(t)
    return F.regexp_extract(t, "(?s)\\[.*\\]", 0)


def parse_reply(reply: Column) -> Column:
    """M7: the JSON array as ``array<struct<...>>``; null when it is not valid JSON
    (the whole batch then falls back)."""
    return F.from_json(reply_array_text(reply), REPLY_SCHEMA)


def match_results(replies: DataFrame) -> DataFrame:
    """M8 + M9: one row per row key with label, confidence and reasoning.

    The i-th object of the reply belongs to the i-th row of the batch (the
    model's own ``index`` is ignored). A missing object, a null reply or a
    null classification falls back for that position only; surplus objects
    are dropped."""
    parsed = replies.select("row_keys", parse_reply(F.col("reply")).alias("_res"))
    ex = parsed.select(F.posexplode("row_keys").alias("pos", ROW_KEY), "_res")
    r = F.try_element_at(F.col("_res"), (F.col("pos") + 1).cast("int"))
    ok = r.isNotNull() & r["classification"].isNotNull()
    return ex.select(
        ROW_KEY,
        F.when(ok, r["classification"]).otherwise(F.lit(FALLBACK_LABEL)).alias("_m_label"),
        F.when(ok, r["confidence"].try_cast("double")).otherwise(F.lit(FALLBACK_CONFIDENCE)).alias("_m_conf"),
        F.when(ok, r["reasoning"]).otherwise(F.lit(FALLBACK_REASONING)).alias("_m_reason"),
    )


def classify_with_model(
    keyed: DataFrame,
    scorer_factory: ScorerFactory,
    cols: ListingColumns = DEFAULT_COLUMNS,
    batch_size: int = BATCH_SIZE_DEFAULT,
    n_buckets: int | None = None,
    bucket_by: str | None = None,
    max_parallel: int | None = None,
    instructions: str | None = None,
    persist_replies: bool = True,
    categories=CATEGORIES,
    descriptions=None,
    ledger: str | None = None,
) -> DataFrame:
    """Classified listing with an external model (M1-M9). ``keyed`` must have a
    unique ``row_key`` (``with_row_key`` gives one). Invalid rows never reach the model.
    ``categories`` and ``descriptions`` put own categories into the instructions. ``ledger`` (a folder on the shared
    store) keeps replies by prompt: a second run, or one after a lost job, asks only what is open."""
    validated = validate(keyed, cols)
    if instructions is None:
        instructions = default_instructions(categories, descriptions)
    prompts = build_prompts(batch_rows(validated, cols, batch_size, n_buckets, bucket_by), instructions)
    if ledger:
        replies = call_open_prompts(prompts, scorer_factory, ledger, max_parallel)
    else:
        replies = call_model(prompts, scorer_factory, max_parallel)
    if persist_replies:
        replies = stage(replies, "model-replies")
    return apply_results(validated, match_results(replies))


def apply_results(validated: DataFrame, results: DataFrame) -> DataFrame:
    """J1 + M9: results joined to their rows. A valid row without a result gets the
    fallback stamp; a result without a reasoning or confidence keeps its nulls."""
    j = validated.join(results, ROW_KEY, "left")
    missing = F.col("_m_label").isNull()
    out = stamp_results(
        j,
        F.coalesce(F.col("_m_label"), F.lit(FALLBACK_LABEL)),
        F.when(missing, F.lit(FALLBACK_CONFIDENCE)).otherwise(F.col("_m_conf")),
        F.when(missing, F.lit(FALLBACK_REASONING)).otherwise(F.col("_m_reason")),
    )
    return out.drop("_m_label", "_m_conf", "_m_reason")
