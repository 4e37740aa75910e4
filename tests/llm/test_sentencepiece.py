import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, no_documents, odd_documents
from replysift.llm import sentencepiece_backend as sb

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return sb.Backend(PATH)


def test_documents_keep_parity(spark, bpe):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert all(bpe.parity(texts)) and bpe.cut


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.a<s>▁é日"), st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00")), max_size=25), max_size=5))
def test_parity_on_any_text(bpe, texts):
    assert all(bpe.parity(texts))


def number(n):
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def field(tag, kind, value):
    body = number(value) if kind == 0 else value if kind == 5 else number(len(value)) + value
    return number(tag << 3 | kind) + body


def unigram(tmp_dir, byte_fallback=1, prefix=1, remove=0):
    """A hand-written unigram model file."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    pieces += [("▁", -2.0, 1), ("▁the", -1.5, 1), ("▁a", -2.1, 1), ("the", -3.7, 1), ("at", -3.1, 1), ("cat", -2.9, 1), ("▁cat", -2.55, 1)]
    pieces += [(c, -5.0 - i / 7, 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyzé")]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, 1) + field(4, 0, len(pieces)) + field(35, 0, byte_fallback) + field(40, 0, 0) + field(41, 0, 1) + field(42, 0, 2) + field(43, 0, (1 << 64) - 1))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, prefix) + field(4, 0, remove) + field(5, 0, 1))
    path = f"{tmp_dir}/unigram.model"
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize(("prefix", "remove"), [(1, 0), (1, 1), (0, 0)])
def test_unigram_scores_and_byte_fallback(tmp_dir, prefix, remove):
    model = sb.Backend(unigram(tmp_dir, 1, prefix, remove))
    assert model.model.kind == sb.UNIGRAM and model.cut == (prefix == 1 and not remove)
    rng = random.Random(1)
    texts = ["the cat sat at the theatre", "", "cat", "日本 the", "a  cat" if not remove else "a   cat ", "catthecat", "éa"]
    texts += ["".join(rng.choice("the catn日é") for _ in range(rng.randint(1, 30))).strip() for _ in range(200)]
    if not prefix:
        texts = [t for t in texts if not t.startswith(" ")]
    good = model.parity(texts)
    assert all(good), [t for t, g in zip(texts, good, strict=True) if not g][:5]


def test_decoding(bpe):
    ids = bpe.encode(pa.array(["Hello  world\n", "", " x"], pa.large_string()))
    assert [t.decode() for t in bpe.decode(ids)] == ["Hello  world\n", "", " x"]
    lone = np.array([1, 3 + 0xE6, 2], "<u2").tobytes()  # control symbols and half a character
    assert bpe.decode([lone])[0].decode("utf-8", "replace") == "�"
    assert bpe.tokenizer.decode(np.frombuffer(ids[0], "<u2").tolist(), skip_special_tokens=False) == "Hello  world\n"


def test_odd_documents(spark, bpe):
    docs = odd_documents(spark, ("IDS", "same", "n_tokens"))
    encoded = sb.encode_texts(docs, PATH)
    rows = encoded.collect()
    want = dict(zip([r[1] or "" for r in ROWS], bpe.encode(pa.array([r[1] or "" for r in ROWS], pa.large_string())), strict=True))
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    assert all(bytes(r.ids) == want[r.text or ""] and r.n_tokens == len(r.ids) // 2 for r in rows)
    back = sb.decode_ids(encoded.withColumnRenamed("text", "before"), PATH).collect()
    assert all(r.text == (r.before or "") for r in back)
    trip = sb.round_trip(docs, PATH).collect()
    assert all(r.same for r in trip)
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(want[r.text or ""], "<u2").astype("<u4").tobytes()) for r in trip)
    assert sb.encode_texts(no_documents(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        sb.read_model(field(2, 2, field(3, 0, 3)))


def test_query_holds_rows_against_the_library(spark):
    rows = sb.q_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    checked = [r for r in rows if r.parity is not None]
    assert {r.doc_id for r in checked} == {r.doc_id for r in rows if r.doc_id % sb.PARITY_EVERY == 0} and len(checked) >= 20
    assert all(r.parity and r.same for r in checked)


def test_every_row_is_held_against_the_library(spark):
    rows = sb.q_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert any(r.doc_id % 10 for r in rows) and all(r.parity and r.same for r in rows)
    trip = sb.round_trip(odd_documents(spark, ("parity",)), PATH, parity=True).collect()
    assert Counter(r.doc_id for r in trip) == Counter(r[0] for r in ROWS) and all(r.parity is True for r in trip)
    # a difference is told, in ids or in text
    one = sb.Backend(PATH)
    ids = one.encode(pa.array(["a b", "c"], pa.large_string()))
    assert one.agrees(["a b", "c"], ids, [b"a b", b"d"]) == [True, False] and one.agrees(["a b", "c"], ids[::-1], [b"a b", b"c"]) == [False, False]
