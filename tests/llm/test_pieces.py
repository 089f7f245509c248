import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

import public_tokenizers
from tessera.llm import pieces

SP = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
M = pieces.Model(None)
SIGNS = st.lists(st.sampled_from([*" \n\t\r▁ab.,;)(}{*/1'éd日́\x00<s>", "the", "  ", "\U0001f600", "un", " of", "\u3000"]), max_size=40).map("".join)


def ids_of(text):
    return b"".join([struct.pack("<I", 1), *[M.segment(c) for c in pieces.chunks(text.encode())], struct.pack("<I", 2)])


@settings(max_examples=1500, deadline=None)
@given(SIGNS | st.text(max_size=40))
def test_chunks_segment_as_the_whole_text(text):
    want = SP.encode(text, add_bos=True, add_eos=True)
    assert list(struct.unpack(f"<{len(want)}I", ids_of(text))) == want
    assert M.text(ids_of(text)) == SP.decode(want)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=20))
def test_any_ids_decode_as_the_library_does(ids):
    assert M.text(struct.pack(f"<{len(ids)}I", *ids)) == SP.decode(ids)


def test_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice((5, 400))]) + rng.choice(("", "", ".\n", "  ", ",")) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [None, "", " ", "\n", "x" * 50_000, "word " * 60_000, texts[0], " lead", "tail ", "▁mark", "a\n\n\nb"]
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk int").repartition(3)
    for most, own in ((pieces.SHARED, pieces.OWN), (20, 30), (0, 1)):
        got = pieces.encode(docs, most=most, own=own)
        back = {(r.doc_id, bytes(r.ids)) for r in got.collect()}
        want = [(i, SP.encode(t or "", add_bos=True, add_eos=True)) for i, t, *_ in rows]
        assert back == {(i, struct.pack(f"<{len(x)}I", *x)) for i, x in want}
    decoded = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert decoded[0] == SP.decode(want[0][1]) and decoded[len(texts) - 2] == " mark"
    clash = spark.createDataFrame([(None, "y", "z"), (bytearray(b"\x01\0\0\0"), "y", None)], "ids binary, text string, other string")
    assert sorted(map(str, pieces.decode(clash).collect())) == ["Row(other='z', text=None)", "Row(other=None, text='')"]


def test_frequent_is_bounded(spark):
    distinct = spark.range(1000).selectExpr("cast(cast(id as string) as binary) chunk", "id + 1 n")
    for most in (0, 1, 10, 500, 5000):
        got = pieces.frequent(distinct, most)
        n = sorted(r.n for r in got.collect())
        assert len(n) <= most and n == list(range(1001 - len(n), 1001)) and (most < 100 or len(n) >= 0.8 * min(most, 1000))


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty).count() == 0 and pieces.decode(pieces.encode(empty)).count() == 0
    dir_ = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pieces.op13_piece_codec(spark, dir_).collect()}
    for d in spark.read.parquet(f"{dir_}/documents.parquet").collect():
        ids = SP.encode(d.text or "", add_bos=True, add_eos=True)
        r = got.pop(d.doc_id)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert not got


def test_a_model_whose_pieces_cross_is_refused(monkeypatch):
    class Crossing(SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces.Model(None)
