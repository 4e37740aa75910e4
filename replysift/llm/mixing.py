"""Mixing sources to target weights (2): Sainte-Lague apportionment of equal-token blocks.

1. Every source gets a target: its share by weight of all words, stopped at
   ``max_epochs`` times its own size, the excess shared again by weight among the
   others until none is above.
2. All words are ``N`` blocks of ``block_words``; the blocks go to the sources by
   the highest quotients target / (2 seats + 1), ties to the earlier source. A
   source's blocks go to its shards the same way, by the shards' sizes.
3. The documents of a shard stand in seeded order on a ring of words. Its quota of
   blocks is the arc of that many words from a seeded block on. An arc longer than
   the ring goes round again, so a document is taken whole as often as the arc
   passes it, and only the two ends of an arc can cut one.

The order is by md5 of seed and id: any rerun or layout gives the same result.

Only the table of sources (one row each, ``max_sources`` at most, else it raises)
reaches the driver. A shard has about ``docs_per_shard`` documents, so a hot source
has many shards; no window holds more than one shard.

Defined cases: a null source is a source of its own, after all others; a null or
empty text has size 0 and is never taken; a null id is ordered like the text "";
repeated rows are separate documents; a source without words has target 0; an
empty table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, quoted, ship_package, stage, without

BLOCK_WORDS, DOCS_PER_SHARD, MAX_EPOCHS, MAX_SOURCES, SEED = 64, 20_000, 3, 1_000_000, "mix-1"
OUTPUTS = ("size", "source_size", "target", "taken", "spans", "shard")


def targets(sizes: list[int], weights: list[int], max_epochs: int = MAX_EPOCHS, total: int | None = None) -> list[float]:
    """Words wanted of each source; integers up to the one division, so exact to the last bit."""
    left, open_weight = sum(sizes) if total is None else total, sum(weights)
    out: list[float | None] = [None] * len(sizes)
    while True:
        over = [i for i, t in enumerate(out) if t is None and weights[i] * left > max_epochs * sizes[i] * open_weight]
        if not over:
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
        left -= sum(max_epochs * sizes[i] for i in over)
        open_weight -= sum(weights[i] for i in over)
    return [t if t is not None else (weights[i] * left) / open_weight for i, t in enumerate(out)]


def sainte_lague(wanted, seats: int) -> np.ndarray:
    """Seats by the highest quotients wanted / (2 seats + 1), ties to the earlier entry.

    Starts at the rounded shares, then moves single seats until the given ones are
    those of the highest quotients; that takes a few steps for each entry at most."""
    import heapq

    wanted = np.asarray(wanted, float)
    got = np.zeros(len(wanted), np.int64)
    if seats <= 0 or not len(wanted) or wanted.sum() <= 0:
        return got
    got = np.floor(wanted * (seats / wanted.sum()) + 0.5).astype(np.int64)
    gain = lambda i: (-(wanted[i] / (2 * got[i] + 1)), i)  # noqa: E731  least first: the next seat to give
    loss = lambda i: (wanted[i] / (2 * got[i] - 1), -i)  # noqa: E731  least first: the last seat to take back
    give = [(*gain(i), int(got[i])) for i in range(len(wanted)) if wanted[i] > 0]
    take = [(*loss(i), int(got[i])) for i in range(len(wanted)) if got[i] > 0]
    heapq.heapify(give)
    heapq.heapify(take)

    def top(heap, at):
        while heap and got[at(heap[0])] != heap[0][2]:  # an entry from before a move
            heapq.heappop(heap)
        return heap[0] if heap else None

    def move(i, by):
        got[i] += by
        heapq.heappush(give, (*gain(i), int(got[i])))
        if got[i] > 0:
            heapq.heappush(take, (*loss(i), int(got[i])))

    while True:
        total = int(got.sum())
        up, down = top(give, lambda e: e[1]), top(take, lambda e: -e[1])
        if total < seats:
            move(up[1], 1)
        elif total > seats:
            move(-down[1], -1)
        elif down and (-up[0], -up[1]) > (down[0], down[1]):
            move(-down[1], -1)
            move(up[1], 1)
        else:
            return got


def cycling_weights(sources: list) -> list[int]:
    return [i % 3 + 1 for i in range(len(sources))]


def _number(seed: str, *parts):
    """60 bits of an md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``: words of the text."""
    words = F.coalesce(F.regexp_count(quoted(text_col).cast("string"), F.lit(WORD_RE)), F.lit(0))
    return docs.select(*[quoted(c) for c in without(docs, ["size"])], words.cast("long").alias("size"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                weights: Callable[[list], list[int]] = cycling_weights, seed: str = SEED,
                block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, docs_per_shard: int = DOCS_PER_SHARD,
                max_sources: int = MAX_SOURCES) -> DataFrame:
    """``docs`` (with ``size``, see ``sized``) plus ``source_size``, ``target``, ``taken``
    (words, repeats counted), ``shard`` and ``spans``: array<struct<from, to>>, one
    element for each time that words ``from`` to ``to`` of the document are taken."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(*[quoted(c) for c in without(docs, set(OUTPUTS) - {"size"})])
    table = docs.groupBy(quoted(source_col).cast("string").alias("s")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    rows = table.limit(max_sources + 1).collect()  # one narrow row for each source
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["s"] is None, r["s"] or ""))
    sizes = [int(r["w"]) for r in rows]
    wanted = targets(sizes, weights([r["s"] for r in rows]), max_epochs)
    seats = sainte_lague(wanted, (2 * sum(sizes) + block_words) // (2 * block_words))  # targets add up to all sizes
    plan = spark.createDataFrame(
        [(r["s"], i, sizes[i], float(wanted[i]), int(seats[i]), -(-int(r["n"]) // docs_per_shard)) for i, r in enumerate(rows)],
        "__s string, __i int, source_size long, target double, __seats long, __shards long")
    dealt = docs.join(F.broadcast(plan), quoted(source_col).cast("string").eqNullSafe(F.col("__s")))  # max_sources rows at most
    dealt = dealt.drop("__s").withColumn("shard", F.pmod(_number(seed + "-shard", quoted(id_col)), F.col("__shards")).cast("int"))

    def quotas(pdf):
        pdf = pdf.sort_values("shard")
        got = sainte_lague(pdf["w"].to_numpy(float), int(pdf["seats"].iloc[0]))
        pdf["quota"] = np.minimum(got * block_words, max_epochs * pdf["w"].to_numpy(np.int64))
        return pdf[["__i", "shard", "w", "quota"]]

    # one row for each shard; a source's shards are its documents / docs_per_shard
    shards = dealt.groupBy("__i", "shard").agg(F.sum("size").alias("w"), F.first("__seats").alias("seats"))
    shards = shards.groupBy("__i").applyInPandas(quotas, "__i int, shard int, w long, quota long")
    shards = shards.select("__i", "shard", F.col("w").alias("__w"), F.col("quota").alias("__q"))
    order = W.partitionBy("__i", "shard").orderBy(_number(seed + "-order", quoted(id_col)), quoted(id_col), "size") \
        .rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(shards, ["__i", "shard"]).withColumn("__a", F.coalesce(F.sum("size").over(order), F.lit(0)))
    blocks = F.greatest(F.ceil(F.col("__w") / F.lit(block_words)).cast("long"), F.lit(1))
    placed = placed.withColumn("__from", F.pmod(_number(seed + "-start", F.col("__i"), F.col("shard")), blocks) * F.lit(block_words))

    # the document lies at lap * w + a; the arc is [from, from + q)
    laps = F.sequence(F.lit(0), F.lit(max_epochs))

    def span(lap):
        at = lap * F.col("__w") + F.col("__a")
        first = F.least(F.greatest(F.col("__from") - at, F.lit(0)), F.col("size"))
        last = F.least(F.greatest(F.col("__from") + F.col("__q") - at, F.lit(0)), F.col("size"))
        return F.struct(first.cast("long").alias("from"), last.cast("long").alias("to"))

    placed = placed.withColumn("spans", F.filter(F.transform(laps, span), lambda x: x["from"] < x["to"]))
    placed = placed.withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["to"] - x["from"]))
    return placed.drop("__i", "__seats", "__shards", "__w", "__q", "__a", "__from")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: bytes, start: int, end: int) -> bytes:
    """Words ``start`` to ``end`` of a text with what stands between them."""
    first = last = 0
    for i, found in enumerate(_WORD.finditer(text)):
        if i == start:
            first = found.start()
        if i == end - 1:
            last = found.end()
            break
    return text[first:last]


def mixed_documents(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for every span of ``mix_sources``, its text cut to the span. Whole
    documents pass as they are; at most two in a shard are cut."""
    ship_package(mixed.sparkSession)
    rows = mixed.withColumn("__span", F.explode("spans")).drop("spans")
    whole = (F.col("__span.from") == 0) & (F.col("__span.to") == F.col("size"))
    cut = F.udf(lambda t, a, b: cut_words(t.encode(), a, b).decode(), "string")
    # the helper runs for cut rows only: whole ones give it a null
    part = F.when(~whole, quoted(text_col))
    piece = F.when(whole, quoted(text_col)).otherwise(F.when(part.isNotNull(), cut(F.coalesce(part, F.lit("")), F.col("__span.from"), F.col("__span.to"))))
    return rows.withColumn(text_col, piece).drop("__span")


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = stage(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    return mix_sources(narrow).select("doc_id", "size", "source_size", "target", "taken")
