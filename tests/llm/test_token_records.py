import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, no_documents, odd_documents
from replysift.llm import token_records as tr

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(library, texts):
    return [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None, database=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'!é日x1²  \u0085\x1c"), st.characters(blacklist_categories=("Cs",))), max_size=30), max_size=6))
def test_cut_texts_encode_like_whole_ones(library, texts):
    assert tr.encoder(PATH)(pa.array(texts, pa.string())) == whole(library, texts)


def test_words_encode_like_whole_texts(library):
    rng = random.Random(3)
    words = ["the", "The", "don't", "x²", "Été,", "ok...\nYes", "a--b", "1,000", "<|endoftext|>", "", "naïve", "!!", "日本", "I'll", "end.\n\nNew"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    encode = tr.encoder(PATH)
    assert encode(pa.array(texts)) == whole(library, texts)
    assert encode(pa.array(texts)) == whole(library, texts)  # from the store


def test_frames():
    payloads = [tr.pack(3, b"\x01\x00\n\n", 2), tr.pack(None, b"", 2), tr.pack(-1, b"\x05\x00\x00\x00", 4)]
    data = b"".join(tr.frame(p) + b"\n" for p in payloads)
    got = list(tr.frames(data))
    assert [p for _, _, p in got] == payloads
    assert [tr.unpack(p)[0] for p in payloads] == [3, None, -1]
    offset, length, _ = got[1]
    assert tr.record_at(data, offset, length)[1].size == 0
    for at in (0, 9, 14, len(data) - 2):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(tr.frames(bytes(broken)))


def test_files_hold_every_document_in_order(spark, library, tmp_dir):
    path, index = tr.write_token_records(odd_documents(spark), PATH, 2, f"file://{tmp_dir}/records")
    rows = index.orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r.doc_id for r in rows] == [r[0] for r in order]
    start = 0
    for r, ids in zip(rows, whole(library, [o[1] or "" for o in order]), strict=True):
        ids = np.append(np.frombuffer(ids, "<u2"), 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # a shuffled read by the index alone
    files = {(int(f.path.split("/part-")[1][:5]), int(f.path.rsplit("-c", 1)[1][:3])): bytes(f.content)
             for f in spark.read.format("binaryFile").load(f"{path}/shards").collect()}
    for r in random.Random(1).sample(rows, 5):
        doc_id, ids = tr.record_at(files[r.part, r.piece], r.offset, r.length)
        assert doc_id == r.doc_id and len(ids) == r.n_tokens


def test_many_files_of_a_part_and_no_documents(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(tr, "RECORDS_PER_FILE", 3)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    _, index = tr.write_token_records(docs, PATH, 2, f"file://{tmp_dir}/a")
    assert [r.doc_id for r in index.orderBy("start").collect()] == list(range(40)) and index.agg({"piece": "max"}).first()[0] > 0
    _, index = tr.write_token_records(no_documents(spark), PATH, 2, f"file://{tmp_dir}/b")
    assert index.count() == 0


def test_every_byte_value_survives_the_sink(spark, tmp_dir):
    """Frames go through Spark's text sink as strings: no operator may read them as UTF-8."""
    rows = [(bytes(range(256)) * 3 + b"\n" * 5,), (b"\xff\xfe\x00\n\r\x80",), (b"",)]
    frames = [tr.frame(tr.pack(i, b + b"\x00" * (len(b) % 2), 2)) for i, (b,) in enumerate(rows)]
    df = spark.createDataFrame([(bytearray(f),) for f in frames], "value binary").coalesce(1)
    df.selectExpr("cast(value as string) value").write.option("lineSep", "\n").text(f"file://{tmp_dir}/t")
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_dir}/t").collect())
    assert [p for _, _, p in tr.frames(data)] == [tr.pack(i, b + b"\x00" * (len(b) % 2), 2) for i, (b,) in enumerate(rows)]


def test_long_documents_go_on_in_further_frames(spark, library, monkeypatch, tmp_dir):
    """Twenty long records and short ones between them, with a small bound on frames and files."""
    monkeypatch.setattr(tr, "FRAME_IDS", 500)
    monkeypatch.setattr(tr, "RECORDS_PER_FILE", 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(rng.choice([3, 40, 2000, 6000]) if i % 2 else 5)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path, index = tr.write_token_records(docs, PATH, 2, f"file://{tmp_dir}/records")
    rows, start = index.orderBy("start").collect(), 0
    for r, ids in zip(rows, whole(library, texts), strict=True):
        ids = np.append(np.frombuffer(ids, "<u2"), 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.n_frames) == (start, len(ids), zlib.crc32(ids.tobytes()), -(-len(ids) // 500))
        start += len(ids)
    content = {(int(f.path.split("/part-")[1][:5]), int(f.path.rsplit("-c", 1)[1][:3])): bytes(f.content)
               for f in spark.read.format("binaryFile").load(f"{path}/shards").collect()}
    assert max(map(len, content.values())) <= 7 * (500 * 2 + 64)
    for r in rows:  # a document that ends in its file is read by the index alone
        doc_id, ids = tr.record_at(content[r.part, r.piece], r.offset, r.length)
        assert doc_id == r.doc_id and len(ids) <= r.n_tokens and (len(ids) == r.n_tokens or r.record + r.n_frames > 7)
    records = spark.read.parquet(f"{path}/records")
    lacking = records.where("not (frame = 1)")
    with pytest.raises(Exception, match="lacks a frame"):
        tr.documents_of(lacking).collect()
