import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from gazeledger.llm import catalog, pieces
from gazeledger.llm.word_ids import ChunkTable

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = SentencePieceProcessor(model_file=PATH)
SF = "/root/testdata/sf0.01"


def lists(texts, own=None):
    out = []
    for _, _, ids, offsets in (own or pieces.loaded(PATH)).blocks(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbé ́   \t\n\r12,.漢𝒳\x00▁　ﬁ<s>the")), max_size=6))
def test_joined_ids_are_the_library_s(texts):
    assert lists(texts) == [MODEL.encode(t) for t in texts]


def test_small_table_gives_the_same_ids():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeÉ.,'9 ", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    own = pieces.SentencePieces(PATH)
    own.table = ChunkTable(own._segment, chunks=20, ids=300)
    for lo in range(0, len(texts), 9):
        assert lists(texts[lo : lo + 9], own) == [MODEL.encode(t) for t in texts[lo : lo + 9]]


def test_models_that_cross_markers_are_refused():
    own = pieces.SentencePieces(PATH)
    own.words_apart = False
    with pytest.raises(ValueError):
        lists(["a b"], own)
    column = pa.array(["a b", "", " c"])
    got = [ids[a:b].tolist() for _, _, ids, o in own.blocks(column, whole=True) for a, b in zip(o[:-1], o[1:], strict=True)]
    assert got == [MODEL.encode(t) for t in column.to_pylist()]


def test_round_trip(spark):
    texts = ["", None, " ", "  two  blanks ", "one\ntwo", "same text", "same text", "long words " * 30000, "x" * 100_000, "é漢\x00𝒳 ▁▁a"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    for packed in (False, True):
        got = pieces.decode(pieces.encode(docs, PATH, packed=packed), PATH).collect()
        assert len(got) == len(rows)
        for r in got:
            text = ("no id" if r["doc_id"] is None else texts[r["doc_id"]]) or ""
            want = MODEL.encode(text, add_bos=True, add_eos=True)
            assert (list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) if packed else r["ids"]) == want
            assert r["text"] == MODEL.decode(want)
    empty = docs.limit(0)
    assert pieces.decode(pieces.encode(empty, PATH), PATH).count() == 0


def test_query_matches_the_library(spark):
    got = {r["doc_id"]: r for r in catalog.op12_pieces(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = MODEL.encode(r["text"] or "", add_bos=True, add_eos=True)
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()
