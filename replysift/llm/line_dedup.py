"""Line dedup (9): exact reference counts behind sharded cuckoo filters.

A line's key is the line without blanks at both ends, A-Z lower-cased. The
reference table holds, for every distinct key of the corpus, the number of
documents it occurs in. Keys at or above the threshold also sit in cuckoo
filters, one for each shard of the key space. Cleaning a document probes the
filters only; the few keys that a filter reports wrongly are listed once in an
exceptions table, so filter plus exceptions answer exactly.

Insertions and deletions of documents change the counts by ``+1`` and ``-1``;
keys that cross the threshold are inserted into or deleted from their shard's
filter (``maintain``; a shard that overflows has the filters built anew). Cleaning is a function of the counts alone, so deleting documents
undoes exactly what inserting them did.

Defined cases: a null or empty text is one empty line and comes back as an
empty text; an empty key never counts and always stays; a line repeated in one
document counts once; repeated rows are separate documents; an empty table
gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, map_texts, mix64, quoted, read_table, ship_package, stage, text_slices

SLOTS = 4
#: Filters and exceptions above this size are not broadcast but dealt out by shard (see ``clean_lines``).
BROADCAST_BYTES = 64 << 20
#: Lines that one task probes against one shard, about; more of them deal the shard's filter out several times.
LINES_PER_PROBE = 5_000_000
#: Most keys a shard is planned for; the number of shards follows the key count.
SHARD_KEYS = 250_000
REFS = "k1 long, k2 long, n_docs long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insert, delete and lookup."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        assert n_buckets & (n_buckets - 1) == 0
        self.n_buckets = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table.reshape(n_buckets, SLOTS)

    @staticmethod
    def places(keys: np.ndarray, n_buckets: int):
        """Fingerprint and both buckets of each 64-bit key."""
        keys = mix64(np.asarray(keys).view(np.uint64))
        mask = np.uint64(n_buckets - 1)
        fp = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (keys >> np.uint64(16)) & mask
        return fp, first.astype(np.int64), CuckooFilter.other(first.astype(np.int64), fp, n_buckets)

    @staticmethod
    def other(bucket: np.ndarray, fp: np.ndarray, n_buckets: int) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64) + np.uint64(0x9E3779B9)) & np.uint64(n_buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the caller then builds a larger filter."""
        fps, firsts, seconds = self.places(keys, self.n_buckets)
        table = self.table
        for fp, i, j in zip(fps.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
            for kick in range(500):
                row = table[i]
                free = np.flatnonzero(row == 0)
                if not len(free) and kick == 0:
                    i, row = j, table[j]
                    free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = fp
                    break
                slot = (fp + kick) % SLOTS  # no random state: the same keys give the same filter
                fp, row[slot] = int(row[slot]), fp
                i = int(self.other(np.array([i]), np.array([fp], np.uint16), self.n_buckets)[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for fp, i, j in zip(*(x.tolist() for x in self.places(keys, self.n_buckets)), strict=True):
            for bucket in (i, j):
                found = np.flatnonzero(self.table[bucket] == fp)
                if len(found):
                    self.table[bucket][found[0]] = 0
                    break
            else:
                raise KeyError("the key was never inserted")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, first, second = self.places(keys, self.n_buckets)
        return ((self.table[first] == fp[:, None]) | (self.table[second] == fp[:, None])).any(axis=1)


def line_keys(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """16-byte key digests of the lines of a text; None where the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only
        short = len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def pairs(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def count_lines(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """The reference table (k1, k2, n_docs): documents for each distinct key.
    Counts are summed inside each batch and again before the shuffle, so a line
    of a third of all documents costs one row for each task."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                seen = Counter()
                for text in texts:
                    seen.update({k for k in line_keys(text, min_chars) if k})
                keys = pairs(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(seen.values()), pa.int64())],
                    ["k1", "k2", "n_docs"])

    counted = docs.select(quoted(text_col).cast("string").alias("t")).mapInArrow(run, REFS)
    return counted.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"))


def insert_documents(refs: DataFrame, docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    return _added(refs, count_lines(docs, text_col, min_chars), 1)


def delete_documents(refs: DataFrame, docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """The counts without these documents; they must have been inserted before."""
    return _added(refs, count_lines(docs, text_col, min_chars), -1)


def _added(refs: DataFrame, delta: DataFrame, sign: int) -> DataFrame:
    both = refs.unionByName(delta.withColumn("n_docs", F.col("n_docs") * F.lit(sign)))
    summed = both.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"))
    return summed.where("n_docs != 0")


def _shard(bits: int):
    return F.shiftrightunsigned(F.col("k1"), 64 - bits).cast("int") if bits else F.lit(0)


class LineFilter:
    """Sharded filters plus exceptions, small enough to send to every task."""

    def __init__(self, bits: int, n_buckets: int, shards: dict[int, bytes], exceptions: list[tuple[int, int]]):
        self.bits, self.n_buckets = bits, n_buckets
        self.table = np.zeros((1 << bits, n_buckets, SLOTS), np.uint16)
        for shard, table in shards.items():
            self.table[shard] = np.frombuffer(table, np.uint16).reshape(n_buckets, SLOTS)
        self.exceptions = frozenset(exceptions)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Exact membership of (k1, k2) rows; keys outside the corpus may still be reported wrongly."""
        if not len(keys):
            return np.zeros(0, bool)
        shard = (keys[:, 0].view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        fp, first, second = CuckooFilter.places(np.ascontiguousarray(keys[:, 1]), self.n_buckets)
        hit = ((self.table[shard, first] == fp[:, None]) | (self.table[shard, second] == fp[:, None])).any(axis=1)
        if self.exceptions:
            for at in np.flatnonzero(hit):
                hit[at] = (int(keys[at, 0]), int(keys[at, 1])) not in self.exceptions
        return hit


def build_filters(refs: DataFrame, min_docs: int) -> tuple[int, int, DataFrame]:
    """(shard bits, buckets of a shard, DataFrame(shard int, filter binary)) of the keys
    in at least ``min_docs`` documents. Keys are spread evenly by their digest; a
    shard holds about ``SHARD_KEYS`` at most, so the number of shards grows with
    the keys and no group does."""
    hot = refs.where(F.col("n_docs") >= min_docs)
    n_hot = hot.count()
    bits = max(4, int(np.ceil(np.log2(max(1, n_hot / SHARD_KEYS)))))
    largest = hot.groupBy(_shard(bits).alias("shard")).count().agg(F.max("count")).first()[0] or 0
    n_buckets = 1 << int(np.ceil(np.log2(max(2, largest / SLOTS / 0.8))))

    def build(pdf):
        import pandas as pd

        one = CuckooFilter(n_buckets)
        if not one.insert(np.sort(pdf["k2"].to_numpy(np.int64))):
            raise RuntimeError("a cuckoo filter is full at a load of 0.8 or less")
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [one.table.tobytes()]})

    ship_package(refs.sparkSession)
    filters = hot.select(_shard(bits).alias("shard"), "k2").groupBy("shard").applyInPandas(build, "shard int, filter binary")
    return bits, n_buckets, filters


def _changed_filters(bits: int, n_buckets: int, filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int) -> DataFrame:
    """(shard, filter) after a change of the counts; the filter is null where the shard overflows."""
    joined = before.withColumnRenamed("n_docs", "n0").join(after.withColumnRenamed("n_docs", "n1"), ["k1", "k2"], "full")
    was, now = (F.coalesce(F.col(c), F.lit(0)) >= min_docs for c in ("n0", "n1"))
    moved = joined.where(was != now).select(_shard(bits).alias("shard"), "k2", now.alias("now"))

    def change(left, right):
        import pandas as pd

        old = np.frombuffer(left["filter"].iloc[0], np.uint16).copy() if len(left) else None
        one = CuckooFilter(n_buckets, old)
        shard = int((left if len(left) else right)["shard"].iloc[0])
        one.delete(np.sort(right.loc[~right["now"].astype(bool), "k2"].to_numpy(np.int64)))
        fits = one.insert(np.sort(right.loc[right["now"].astype(bool), "k2"].to_numpy(np.int64)))
        return pd.DataFrame({"shard": [shard], "filter": [one.table.tobytes() if fits else None]})

    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, filter binary")


def update_filters(bits: int, n_buckets: int, filters: DataFrame, before: DataFrame, after: DataFrame,
                   min_docs: int) -> DataFrame:
    """Filters after a change of the counts: keys that rose to the threshold are
    inserted, keys that fell below it are deleted; other shards stay as they are.
    Fails if a shard overflows (``maintain`` goes on with new filters)."""
    changed = _changed_filters(bits, n_buckets, filters, before, after, min_docs)
    full = F.raise_error(F.lit("a shard is full: build the filters anew")).cast("binary")
    return changed.withColumn("filter", F.coalesce("filter", full))


def maintain(bits: int, n_buckets: int, filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int) -> tuple[int, int, DataFrame]:
    """(shard bits, buckets, filters) after a change of the counts: changed in place while
    every shard has room, else built anew from ``after``, as ``build_filters`` gives them."""
    changed = stage(_changed_filters(bits, n_buckets, filters, before, after, min_docs), "line-filters")
    if changed.where("filter is null").take(1):
        return build_filters(after, min_docs)
    return bits, n_buckets, changed


def wrongly_reported(refs: DataFrame, min_docs: int, line_filter) -> DataFrame:
    """Keys below the threshold that the filters report: a narrow pass over the reference table."""
    def run(batches):
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            hit = line_filter.value.contains(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit, 0]), pa.array(keys[hit, 1])], ["k1", "k2"])

    return refs.where(F.col("n_docs") < min_docs).select("k1", "k2").mapInArrow(run, "k1 long, k2 long")


def probed(rows: DataFrame, bits: int, n_buckets: int, filters: DataFrame, n_rows: int) -> DataFrame:
    """The ``rows`` (k1, k2 and other long columns) whose key its shard's filter reports.

    Rows go to the task of their shard, which reads the filter first and then streams them
    past it: a task holds one filter and one batch. A shard of many rows (a hot line lies in
    one) is dealt out over several tasks, each with a copy of its filter. ``n_rows`` is about how
    many rows there are; it decides the number of copies only."""
    ship_package(rows.sparkSession)
    copies = max(1, -(-n_rows // (LINES_PER_PROBE << bits)))
    names = rows.columns
    at = [F.col("shard"), F.col("copy")]
    of_rows = rows.withColumns({"shard": _shard(bits), "copy": F.pmod(F.xxhash64(*names), F.lit(copies)).cast("int"),
                                "kind": F.lit(1), "filter": F.lit(None).cast("binary")})
    of_filters = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "filter")
    both = of_filters.unionByName(of_rows, allowMissingColumns=True).repartition(*at).sortWithinPartitions(*at, "kind")

    def run(batches):
        place, one = None, None
        for batch in batches:
            shard, copy, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, end in zip([0, *change], [*change, len(shard)], strict=True):
                if start == end:
                    continue
                if kind[start] == 0:
                    place = shard[start], copy[start]
                    one = CuckooFilter(n_buckets, np.frombuffer(batch.column(3)[int(start)].as_py(), np.uint16))
                elif place == (shard[start], copy[start]):  # a shard without a filter holds no key
                    columns = [c.slice(start, end - start) for c in batch.columns[4:]]
                    hit = pa.array(one.contains(np.ascontiguousarray(columns[names.index("k2")].to_numpy())))
                    yield pa.RecordBatch.from_arrays([c.filter(hit) for c in columns], names)

    schema = ", ".join(f"{n} long" for n in names)
    return both.select("shard", "copy", "kind", "filter", *names).mapInArrow(run, schema)


OUT = "{text} string, n_lines long, n_dropped long"


def _cleaned(texts, dropped_keys, min_chars=1):
    """Kept text, lines and dropped lines of each text; ``dropped_keys(keys)`` marks key rows."""
    lines_of, keys_of, at, flat = [], [], [], []
    for text in texts:
        lines, keys = text.split(b"\n"), line_keys(text, min_chars)
        lines_of.append(lines)
        here = [i for i, k in enumerate(keys) if k]
        at.append(here)
        keys_of.append(len(here))
        flat += [keys[i] for i in here]
    hit = dropped_keys(pairs(flat)) if flat else np.zeros(0, bool)
    kept, n_lines, n_dropped, start = [], [], [], 0
    for lines, here, n, text in zip(lines_of, at, keys_of, texts, strict=True):
        own = hit[start:start + n]
        start += n
        gone = {here[i] for i in np.flatnonzero(own)}
        kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
    return kept, n_lines, n_dropped


def clean_lines(docs: DataFrame, refs: DataFrame, min_docs: int, text_col: str = "text",
                broadcast_bytes: int = BROADCAST_BYTES, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines removed, plus ``n_lines`` and ``n_dropped``.

    ``refs`` is the (stored) reference table that counts these documents. While
    filters and exceptions fit ``broadcast_bytes``, every task gets them and no
    text is shuffled. Beyond that, the distinct lines of each distinct text go to the filter of
    their shard (``probed``), those that it reports, less the keys it reports wrongly, come back to
    the documents by the text's digest. Both ways probe the same filters and give the same rows.
    """
    spark = docs.sparkSession
    bits, n_buckets, filters = build_filters(refs, min_docs)
    filters = stage(filters, "line-filters")
    size = (1 << bits) * n_buckets * SLOTS * 2
    if size <= broadcast_bytes:
        shards = {r[0]: bytes(r[1]) for r in filters.collect()}  # `size` bytes at most
        plain = spark.sparkContext.broadcast(LineFilter(bits, n_buckets, shards, []))
        wrong = wrongly_reported(refs, min_docs, plain)
        room = (broadcast_bytes - size) // 64
        found = wrong.limit(room + 1).collect()  # bounded: more than fit sends all rows the other way
        if len(found) <= room:
            exact = spark.sparkContext.broadcast(LineFilter(bits, n_buckets, shards, [tuple(r) for r in found]))
            return map_texts(docs, OUT.format(text=f"`{text_col}`"), _Probe(exact, min_chars), text_col)
    return _clean_by_shards(docs, refs, min_docs, bits, n_buckets, filters, text_col, min_chars)


class _Probe:
    def __init__(self, line_filter, min_chars):
        self.line_filter, self.min_chars = line_filter, min_chars

    def __call__(self, texts):
        kept, n_lines, n_dropped = _cleaned(texts, self.line_filter.value.contains, self.min_chars)
        return pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())


def _clean_by_shards(docs: DataFrame, refs: DataFrame, min_docs: int, bits: int, n_buckets: int, filters: DataFrame,
                     text_col: str, min_chars: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def explode(batches):
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                rows = [(xxhash.xxh3_128_digest(t), k) for t in texts for k in {k for k in line_keys(t, min_chars) if k}]
                d, k = pairs(r[0] for r in rows), pairs(r[1] for r in rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[:, 0], d[:, 1], k[:, 0], k[:, 1])], ["d1", "d2", "k1", "k2"])

    def digest(batches):
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(batch.num_columns - 1)):
                d = pairs(xxhash.xxh3_128_digest(t) for t in texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(d[:, 0]), pa.array(d[:, 1])], schema=to_arrow_schema(keyed_schema))

    text = quoted(text_col).cast("string")
    lines = docs.select(text.alias("t")).mapInArrow(explode, "d1 long, d2 long, k1 long, k2 long").distinct()
    total, keys = refs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count("*")).first()
    wrong = probed(refs.where(F.col("n_docs") < min_docs).select("k1", "k2"), bits, n_buckets, filters, keys)
    reported = probed(lines, bits, n_buckets, filters, total)
    drops = reported.join(wrong, ["k1", "k2"], "left_anti").groupBy("d1", "d2").agg(F.collect_list(F.struct("k1", "k2")).alias("__drop__"))
    stay = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    keyed_schema = StructType([*docs.select(*[quoted(c) for c in stay]).schema.fields,
                               *StructType.fromDDL("__d1__ long, __d2__ long").fields])
    keyed = docs.select(*[quoted(c) for c in stay], text.alias("__t__")).mapInArrow(digest, keyed_schema)
    drops = drops.withColumnsRenamed({"d1": "__d1__", "d2": "__d2__"})
    joined = keyed.join(drops, ["__d1__", "__d2__"], "left").drop("__d1__", "__d2__")
    t = F.coalesce(quoted(text_col), F.lit(""))
    # The same removal as in the filter path, done by the same helper with the document's own keys.
    out = StructType([*joined.drop("__drop__").schema.fields, *StructType.fromDDL("n_lines long, n_dropped long").fields])
    where = stay.index(next(c for c in stay if c.lower() == text_col.lower()))

    def clean(batches):
        for batch in batches:
            drop_column, done = batch.column(batch.num_columns - 1), 0
            for texts in text_slices(batch.column(where)):
                part = batch.slice(done, len(texts))
                drops_here = drop_column.slice(done, len(texts)).to_pylist()
                done += len(texts)
                kept, n_lines, n_dropped = [], [], []
                for one, drop in zip(texts, drops_here, strict=True):
                    gone = {(x["k1"], x["k2"]) for x in drop or ()}
                    a, b, c = _cleaned([one], lambda keys, gone=gone: np.array([(int(x), int(y)) in gone for x, y in keys], bool), min_chars)
                    kept, n_lines, n_dropped = kept + a, n_lines + b, n_dropped + c
                columns = list(part.columns[:-1])
                columns[where] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=to_arrow_schema(out))

    return joined.withColumn(text_col, t).select(*[quoted(c) for c in stay], "__drop__").mapInArrow(clean, out)


def dedup_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text", min_chars: int = 1,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Counts the lines of ``docs``, stores the reference table, and removes from every
    document the lines whose key occurs in ``min_docs`` documents or more."""
    if min_chars < 1:
        raise ValueError("min_chars is at least 1")
    refs = stage(count_lines(docs, text_col, min_chars), "line-refs")
    return clean_lines(docs, refs, min_docs, text_col, broadcast_bytes, min_chars)


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def without_and_again(docs: DataFrame, gone, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, state, n_lines, n_dropped), the reversible run: state ``without``, the other documents
    cleaned after the documents ``gone`` (a condition, false where null) were deleted from counts
    and filters; state ``again``, all documents cleaned after those were inserted again."""
    gone = F.coalesce(gone, F.lit(False))
    left, away = docs.where(~gone), docs.where(gone)
    refs = stage(count_lines(docs, text_col), "line-refs")
    bits, n_buckets, filters = build_filters(refs, min_docs)
    fewer = stage(delete_documents(refs, away, text_col), "line-refs")
    held = maintain(bits, n_buckets, stage(filters, "line-filters"), refs, fewer, min_docs)
    without = _clean_by_shards(left, fewer, min_docs, *held, text_col, 1)
    back = stage(insert_documents(fewer, away, text_col), "line-refs")
    held = maintain(*held, fewer, back, min_docs)
    again = _clean_by_shards(docs, back, min_docs, *held, text_col, 1)
    out = [d.select(quoted(id_col).alias(id_col), F.lit(state).alias("state"), "n_lines", "n_dropped") for state, d in (("without", without), ("again", again))]
    return out[0].unionByName(out[1])


def q_line_dedup_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_and_again(docs, F.col("doc_id") % 3 == 0)
