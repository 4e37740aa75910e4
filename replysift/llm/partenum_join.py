"""N-gram Jaccard join (5): PartEnum signatures over word shingles.

A document is the set of its distinct ``n``-word shingles (A-Z lower-cased); with
fewer words the whole sequence is one shingle; without words the set is empty and
linked with nothing. Two sets link when ``den * |A & B| >= num * |A | B|``.

Candidates. Sets that can link differ in size by num/den at most, so sizes are cut
into bands of that ratio, and one signature scheme stands for each two
neighbouring bands: two sets of such a pair that link differ in at most ``k``
shingles. The shingle domain is cut into ``k // 2 + 1`` partitions by hash, so in one
of them they differ in one shingle at most; that partition is cut into three, and of
the three subsets of two parts one holds no difference. A set's signatures are the
hashes of its shingles in every such subset (the subset's number and the scheme
included): linking sets share at least one, for certain.

Verifying. Equal sets are one node from the start. ``settle`` turns the signature groups into
components: pairs first meet a bound from the parities of their shingles that never drops a link,
then their whole sets; nodes joined in one step aren't compared again, and no link between different
texts is lost.

Defined cases: a null or empty text has no shingles and is its own component; equal
texts are linked; rows that repeat an id count as one document (their sets are
linked by it); a row without an id is left out of the components and gets none;
an empty table gives an empty result; other columns stay, one named like an output
is replaced.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, quoted, read_table, stage
from .settle import check_groups, keys_from_texts, linked_components
from .shingle_sets import Rule, differing_bits, linked, may_link, set_hash, shingles, sketch

#: Parts of a first-level partition; every subset of all parts but one is a signature.
PARTS = 3


@lru_cache(maxsize=None)
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Least sizes of the bands up to ``largest``, and for each band ``k`` of the scheme of
    this band and the next: most differences of linking sets, |A| <= |B| from them."""
    least = [1]
    while least[-1] <= largest:
        least.append(least[-1] * den // num + 1)
    least += [least[-1] * den // num + 1]
    least += [least[-1] * den // num + 1]
    most = [b - 1 for b in least[1:]]
    k = [(den - num) * (most[i] + most[i + 1]) // (den + num) for i in range(len(most) - 1)]
    return np.array(least), np.array(k)


def signatures(shingle_set: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a set: those of its band's scheme and of the one before."""
    size = len(shingle_set)
    if not size:
        return np.zeros(0, np.int64)
    least, most_k = bands(num, den, 1 << int(size).bit_length())
    band = int(np.searchsorted(least, size, "right")) - 1
    out = []
    value = mix64(shingle_set + np.uint64(0x9E3779B97F4A7C15))
    for scheme in (band - 1, band):
        k = int(most_k[scheme]) if scheme >= 0 else 0
        if k < 1:  # linking sets are equal: one node already
            continue
        first, parts = k // 2 + 1, PARTS
        cell = (shingle_set >> np.uint64(32)) % np.uint64(first) * np.uint64(parts) + (shingle_set & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        sums = np.zeros(first * parts, np.uint64)
        np.add.at(sums, cell.astype(np.int64), value)
        sums = sums.reshape(first, parts)
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums  # all parts but one
        number = np.arange(first * parts, dtype=np.uint64).reshape(first, parts) + (np.uint64(scheme) << np.uint64(32))
        out.append(mix64(rest + mix64(number + np.uint64(1))).ravel())
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _no_heads(sets: list[np.ndarray]) -> list[bytes]:
    return [b""] * len(sets)


def link_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row for each row of ``docs``."""
    # signatures are made from the texts where they are sent: stored, they would take more room than the texts
    keys = keys_from_texts(n, partial(signatures, num=num, den=den))
    return linked_components(docs, n, _no_heads, keys, Rule(num, den), id_col, text_col)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the rows of its smallest id stay
    (one row, the least text first, where that id repeats); rows without an id stay."""
    found = stage(link_components(docs, n, num, den, id_col, text_col), "join-components")
    # told by the ids that go, far fewer than those that stay: texts needn't move to meet them while they are few
    gone = found.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__id"))
    gone = stage(gone.agg(F.max(F.col("component_id") == F.col(f"`{id_col}`")).alias("stays")).where("not stays").select("__id"), "join-gone")
    same = quoted(id_col).cast("long") == F.col("__id")
    known = docs.where(quoted(id_col).cast("long").isNotNull()).join(gone, same, "left_anti")
    without_id = docs.where(quoted(id_col).isNull())
    again = stage(known.groupBy(quoted(id_col).cast("long").alias("__id")).count().where("count > 1").select("__id"), "join-again")
    if not again.take(1):
        return known.unionByName(without_id)
    # ids that repeat: only their rows are ordered
    first = W.partitionBy(quoted(id_col)).orderBy(quoted(text_col).asc_nulls_first())
    one = known.join(again, same, "left_semi").withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
    return known.join(again, same, "left_anti").unionByName(one).unionByName(without_id)


def q_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_components(docs, n=3, num=90, den=100)


__all__ = ["PARTS", "bands", "check_groups", "differing_bits", "link_components", "linked", "may_link", "one_of_each",
           "q_partenum_join", "set_hash", "shingles", "signatures", "sketch"]
