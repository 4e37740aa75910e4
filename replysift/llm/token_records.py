"""Token-id output (4): length-delimited binary records with masked checksums.

File format (all integers little-endian). A shard file is a sequence of frames:

    uint64  length of the payload
    uint32  masked checksum of those eight bytes
    bytes   payload: int64 doc_id, uint8 flags (1: doc_id is null, 2: the document goes on in
            the next frame), uint8 bytes of an id, uint32 number of the frame in its document,
            uint32 crc32 of the document's ids before (as uint32 each), ids
    uint32  masked checksum of the payload
    0x0A    end of the frame

The masked checksum of ``b`` is crc32(b) rotated right by 15 bits plus
0xA282EAD8, mod 2**32, so that a checksum stored inside checked data does not
look like its own checksum. Ids take two bytes where the vocabulary allows it.
A frame holds ``FRAME_IDS`` ids at most and a file ``RECORDS_PER_FILE`` frames, so a file has a bound in
bytes however long the texts are; a longer document goes on in the next frame, in the next file
if need be, and each frame continues the checksum of the ids before it.
Frames are written by Spark's text sink (the frame's last byte is the sink's
line separator), so any Hadoop file system, its committer and lost executors
are covered; shard and frame order is ascending doc_id (nulls first, ties by
text). The offset index is a table (part, piece, record, doc_id, start, n_tokens, n_frames,
offset, length) beside the shards: with it a reader fetches any document alone, in any
shuffled order; ``length`` covers its frames in that file. The table ``records`` has an entry
for each frame.

Defined cases: a null or empty text holds the end id only; repeated rows are
separate records; an empty table gives an index without rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_words import ByteLevelEncoder
from .common import arrow_schema, new_stage_path, quoted, ship_package, slices, small_batches

HEAD, FOOT, PREFIX = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBBII")
#: Ids in one frame and frames in one shard file at most: about 160 MB with ids of two bytes, so that a reader's task
#: holds a bounded file.
FRAME_IDS = 16_384
RECORDS_PER_FILE = 5_000
INDEX = ("part int, piece int, record int, doc_id long, n_tokens long, offset long, length long, ids_crc32 long, "
         "frame long, goes_on boolean, crc_before long")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its closing 0x0A (the sink adds it)."""
    size = len(payload).to_bytes(8, "little")
    return size + FOOT.pack(masked(size)) + payload + FOOT.pack(masked(payload))


def frames(data: bytes):
    """(offset, length, payload) of every record; raises on a damaged one."""
    at = 0
    while at < len(data):
        size, check = HEAD.unpack_from(data, at)
        if masked(data[at:at + 8]) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12:at + 12 + size]
        end = at + 12 + size + 5
        if len(data) < end or FOOT.unpack_from(data, end - 5)[0] != masked(payload) or data[end - 1] != 0x0A:
            raise ValueError(f"damaged record at byte {at}")
        yield at, end - at, payload
        at = end


def record_at(data: bytes, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """The frames of one document by its index entry: (doc_id, ids)."""
    found = [unpack(payload) for _, _, payload in frames(data[offset:offset + length])]
    return found[0][0], found[0][1] if len(found) == 1 else np.concatenate([ids for _, ids in found])


def pack(doc_id: int | None, ids: bytes, width: int, number: int = 0, goes_on: bool = False, crc_before: int = 0) -> bytes:
    return PREFIX.pack(doc_id or 0, (doc_id is None) + 2 * goes_on, width, number, crc_before) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width, _, _ = PREFIX.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{width}", offset=PREFIX.size)


def frame_place(payload: bytes) -> tuple[int, bool, int]:
    """Number of the frame in its document, whether another follows, and the checksum of the ids before."""
    _, flags, _, number, before = PREFIX.unpack_from(payload)
    return number, bool(flags & 2), before


def ids_crc(ids: np.ndarray, before: int = 0) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers, after those with crc ``before``."""
    return zlib.crc32(ids.astype("<u4").tobytes(), before)


def document_frames(doc_id: int | None, ids: bytes, width: int, most: int | None = None):
    """The frames of one document."""
    step = (most or FRAME_IDS) * width
    if len(ids) <= step:
        yield frame(pack(doc_id, ids, width))
        return
    crc = 0
    for number, at in enumerate(range(0, len(ids), step)):
        part = ids[at:at + step]
        yield frame(pack(doc_id, part, width, number, at + step < len(ids), crc))
        crc = ids_crc(np.frombuffer(part, f"<u{width}"), crc)


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each worker and tokenizer file."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [getattr(t, "content", t) for t in tokenizer.get_added_tokens_decoder().values()]
        width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        _encoders[path] = ByteLevelEncoder(tokenizer, width, special)
    return _encoders[path]


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes the shard files under ``path``.
    ``tokenizer`` names a byte-level BPE file that every executor can read."""
    spark = docs.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    )

    most = FRAME_IDS

    def run(batches):
        encode = encoder(tokenizer)
        width = encode.width
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for start, size in slices(batch.column(1)):
                ids, texts = batch.column(0).slice(start, size).to_pylist(), batch.column(1).slice(start, size)
                records = [f for i, x in zip(ids, encode(texts), strict=True) for f in document_frames(i, x + end, width, most)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    records = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Walks the shard files (checking every frame) and returns an entry for each record."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"/part-(\d+)[^/]*-c(\d+)[^/]*$", 1), F.regexp_extract("path", r"/part-(\d+)[^/]*-c(\d+)[^/]*$", 2)
    files = files.select(name[0].cast("int").alias("part"), name[1].cast("int").alias("piece"), "content")

    target = arrow_schema(INDEX)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = memoryview(batch.column(2)[i].as_buffer()), []
                for record, (offset, length, payload) in enumerate(frames(data)):
                    (doc_id, ids), (number, goes_on, before) = unpack(payload), frame_place(payload)
                    rows.append((record, doc_id, len(ids), offset, length, ids_crc(ids, before), number, goes_on, before))
                columns = list(zip(*rows, strict=True)) or [()] * 9
                columns = [[batch.column(c)[i].as_py()] * len(rows) for c in (0, 1)] + columns
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)

    return files.mapInArrow(run, INDEX)


def documents_of(records: DataFrame, per_file: int | None = None) -> DataFrame:
    """An entry for each document from those of its frames: the place of the first one, all its ids,
    and the checksum of them; fails where a frame is missing. Documents of one frame, nearly all,
    aren't moved."""
    per_file = per_file or RECORDS_PER_FILE
    alone = records.where("frame = 0 and not goes_on").withColumn("n_frames", F.lit(1).cast("long"))
    # files of a part are full but the last, so this is the number of the document's first frame in its part
    first = (F.col("piece").cast("long") * per_file + F.col("record") - F.col("frame")).alias("first")
    several = records.where("frame > 0 or goes_on").withColumn("first", first)
    at_start = F.col("frame") == 0
    several = several.withColumn("here", F.floor(F.col("first") / per_file) == F.col("piece")).groupBy("part", "first").agg(
        F.min("piece").alias("piece"), F.min_by("record", "frame").alias("record"), F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.min_by("offset", "frame").alias("offset"), F.sum(F.when(F.col("here"), F.col("length"))).alias("length"), F.max_by("ids_crc32", "frame").alias("ids_crc32"),
        F.count("*").alias("n_frames"), F.max("frame").alias("last"), F.max_by("goes_on", "frame").alias("open"),
        F.sum(F.when(F.col("goes_on"), F.col("ids_crc32"))).alias("given"), F.sum(F.when(~at_start, F.col("crc_before"))).alias("taken"))
    whole = (F.col("n_frames") == F.col("last") + 1) & ~F.col("open") & F.col("given").eqNullSafe(F.col("taken"))
    several = several.withColumn("n_frames", F.when(whole, F.col("n_frames")).otherwise(F.raise_error(F.lit("a document lacks a frame")).cast("long")))
    columns = ["part", "piece", "record", "doc_id", "n_tokens", "offset", "length", "ids_crc32", "n_frames"]
    return alone.select(*columns).unionByName(several.select(*columns))


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all records before. A running sum inside each file, and one
    over the files' totals (two levels, so that no window holds more than the files of a part
    or the parts of the write, whose number is a setting)."""
    in_file = W.partitionBy("part", "piece").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    in_part = W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    files = index.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    over = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # rows: partitions of the write
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before_part"))
    files = files.select("part", "piece", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("before_file"))
    return (
        index.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(files, ["part", "piece"]).join(parts, "part")
        .withColumn("start", F.col("in_file") + F.col("before_file") + F.col("before_part"))
        .drop("in_file", "before_file", "before_part")
    )


def write_token_records(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id",
                        text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes shards and offset index under ``path`` (default: a new folder in the shared
    stage folder). Returns the path and the index as read back."""
    spark = docs.sparkSession
    path = path or new_stage_path(spark, "token-records")
    write_records(docs, f"{path}/shards", tokenizer, end_id, id_col, text_col)
    # stored before the starts are summed: the shard files are read once, one at a time in each task
    with small_batches(spark, 1):
        build_index(spark, f"{path}/shards").write.parquet(f"{path}/records")
    with_starts(documents_of(spark.read.parquet(f"{path}/records"))).write.parquet(f"{path}/index")
    return path, spark.read.parquet(f"{path}/index")


def q_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, index = write_token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "piece", "record", "n_frames", "offset", "length")
