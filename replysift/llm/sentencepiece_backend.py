"""SentencePiece encoding and decoding (6) on the tokenizers library.

The model protobuf is read here (its few fields, no protobuf package), and the same
tokenizer is built from the library's parts: normaliser (precompiled character map,
extra spaces), the metaspace marker with its prefix, unigram scores or BPE merges in
score order, and byte fallback. ``parity`` compares ids and decoded texts with the
sentencepiece library.

Texts are encoded in batches by the library's threads. Where the model allows it (no
character map, spaces kept, no piece with a marker after another character) texts are
cut at single spaces and each distinct piece is encoded once, which gives the same ids
(see ``bpe_words``).

Defined cases: a null or empty text has no ids and decodes to an empty text; a marker
character in a text is a space, as in the original; ids that don't form UTF-8 decode
to U+FFFD; control symbols decode to nothing; an empty table gives an empty result;
columns named like an output are replaced.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_words import PieceEncoder
from .common import map_texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def proto_fields(data: bytes):
    """(field number, value) of a message: int for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown_surface: str
    charsmap: bytes
    dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool


def read_model(data: bytes) -> Model:
    """The fields that encoding and decoding need, with the format's defaults."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in proto_fields(data):
        if number == 1:
            own = dict(proto_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(proto_fields(value))
        elif number == 3:
            normaliser = dict(proto_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    return Model(pieces, kind, bool(trainer.get(35, 0)), trainer.get(44, " ⁇ ".encode()).decode(), normaliser.get(2, b""),
                 bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two, the best scored pieces first."""
    usable = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
    out = []
    for piece in sorted(usable, key=lambda p: -usable[p]):
        out += [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
    return out


def build(model: Model):
    """The library's tokenizer for a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model.pieces), unk_token=None if unknown is None else model.pieces[unknown][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps += [normalizers.Prepend(" ")]
    if model.escape_spaces:
        steps += [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                          + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


class _Pieces(PieceEncoder):
    """The prefix that the tokenizer puts is the space of every piece, the first one too."""

    def spell(self, piece) -> str:
        return piece[0] if type(piece) is tuple else piece


class Backend:
    """Encodes and decodes texts with the ids of a SentencePiece model file."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = read_model(self.data)
        self.tokenizer = build(self.model)
        size = len(self.model.pieces)
        self.width = 2 if size <= 1 << 16 else 4
        simple = not self.model.charsmap and not self.model.remove_extra_spaces and self.model.dummy_prefix and self.model.escape_spaces
        self.cut = simple and all(MARK not in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER, UNUSED)) \
            and not any(k == USER for _, _, k in self.model.pieces)
        self.encoder = _Pieces(self.tokenizer, self.width, [MARK])
        text = [{CONTROL: b"", UNKNOWN: self.model.unknown_surface.encode()}.get(k, p.replace(MARK, " ").encode()) for p, _, k in self.model.pieces]
        for i, (p, _, k) in enumerate(self.model.pieces):
            if k == BYTE:
                text[i] = bytes([int(p[1:-1], 16)])
        self.lengths = np.fromiter(map(len, text), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(text), np.uint8)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids (``width`` bytes each) of strings without nulls."""
        if self.cut:
            return self.encoder(texts)
        return self.encoder.encode_each(texts.to_pylist())

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Texts as UTF-8."""
        out = []
        for packed in ids:
            one = np.frombuffer(packed, f"<u{self.width}").astype(np.int64)
            count = self.lengths[one]
            ends = np.cumsum(count)
            text = self.bytes[np.repeat(self.starts[one] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            if self.model.dummy_prefix and text[:1] == b" ":
                text = text[1:]
            out.append(text)
        return out

    @cached_property
    def library(self):
        """The sentencepiece library's processor of the model."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def parity(self, texts: list[str]) -> list[bool]:
        """For each text: the same ids as the sentencepiece library, and the same text back."""
        ids = self.encode(pa.array(texts, pa.large_string()))
        return self.agrees(texts, ids, self.decode(ids))

    def agrees(self, texts: Iterable[str], ids: list[bytes], decoded: list[bytes]) -> list[bool]:
        """For each text whether ``ids`` and the text ``decoded`` from them are those of the library."""
        other, out = self.library, []
        for text, mine, back in zip(texts, ids, decoded, strict=True):
            theirs = other.encode_as_numpy(text)
            out.append(mine == theirs.astype(f"<u{self.width}").tobytes() and back.decode("utf-8", "replace") == other.decode(theirs))
        return out


_backends: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    """One for each worker and model file."""
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path]


#: Rows of the query whose id is divisible by this are held against the sentencepiece library: all.
PARITY_EVERY = 1


class _Parity:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, texts):
        return [pa.array(backend(self.path).parity([t.decode() for t in texts]), pa.bool_())]


class _Encode:
    def __init__(self, path: str, verify: bool, parity: bool = False):
        self.path, self.verify, self.parity = path, verify, parity

    def __call__(self, texts):
        one = backend(self.path)
        ids = one.encode(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        width = one.width
        count = [len(x) // width for x in ids]
        if not self.verify:
            return [pa.array(ids, pa.binary()), pa.array(count, pa.int64())]
        wide = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in ids]
        mark, space = MARK.encode(), b" "
        decoded = one.decode(ids)
        same = [d == (t.replace(mark, space) if mark in t else t) for d, t in zip(decoded, texts, strict=True)]
        out = [pa.array(count, pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array(same, pa.bool_())]
        return [*out, pa.array(one.agrees((t.decode() for t in texts), ids, decoded), pa.bool_())] if self.parity else out


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian, two bytes each; four if the model has more than
    65,536 pieces) and ``n_tokens``. ``model_path`` names a file every executor can read."""
    return map_texts(docs, "ids binary, n_tokens long", _Encode(model_path, False), text_col)


def decode_ids(docs: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of packed ids (null: empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    from .common import quoted, ship_package, without

    ship_package(docs.sparkSession)
    stay = without(docs, [out])
    source = docs.select(*[quoted(c) for c in stay], quoted(ids_col).alias("__ids"))
    schema = StructType([*source.drop("__ids").schema.fields, StructField(out, StringType())])

    def run(batches):
        one = backend(model_path)
        for batch in batches:
            texts = one.decode([x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()])
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=to_arrow_schema(schema))

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", parity: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers) and ``same``: the ids decode to the text. For models without a character map.

    ``parity`` adds a column of that name: the same ids and decoded text as the sentencepiece
    library, which encodes and decodes every text as well."""
    fields = "n_tokens long, ids_crc32 long, same boolean" + ", parity boolean" * parity
    return map_texts(docs, fields, _Encode(model_path, True, parity), text_col)


def with_parity(docs: DataFrame, model_path: str, checked, text_col: str = "text") -> DataFrame:
    """``docs`` with ``parity``: ids and decoded text are those of the sentencepiece library; null for
    rows outside ``checked`` (a condition on columns of ``docs``), which aren't encoded a second time."""
    checked = F.coalesce(checked, F.lit(False))
    rest = docs.where(~checked).withColumn("parity", F.lit(None).cast("boolean"))
    return map_texts(docs.where(checked), "parity boolean", _Parity(model_path), text_col).unionByName(rest)


def q_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # every row is held against the library too, on the ids and text made here
    return round_trip(docs, model, parity=True).select("doc_id", "n_tokens", "ids_crc32", "same", "parity")
