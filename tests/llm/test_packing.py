import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazeledger.llm import packing
from gazeledger.llm.word_ids import ChunkTable

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def token_lists(texts, enc=None):
    out = []
    for _, _, ids, offsets in (enc or packing.encoder(PATH)).blocks(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAé'sßİΣ ́\t\n 12##,.漢×Ö½—l<|endoftext|>")), max_size=6))
def test_chunk_ids_are_text_ids(texts):
    assert token_lists(texts) == [ids_of(t)[:-1] for t in texts]


def test_small_table_gives_the_same_ids():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeÉ.,'9", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    enc = packing.WordEncoder(PATH)
    enc.table = ChunkTable(enc.segment, chunks=30)
    old = packing.BLOCK_BYTES
    packing.BLOCK_BYTES = 700
    try:
        assert token_lists(texts, enc) == [ids_of(t)[:-1] for t in texts]
        assert len(enc.table.places) < 400
        enc.table.max_ids = 50
        assert token_lists(texts[:20], enc) == [ids_of(t)[:-1] for t in texts[:20]]
    finally:
        packing.BLOCK_BYTES = old


def test_piece_lengths():
    for tokens in (1, 2, 3, 2047, 2048, 2049, 7000):
        doc, got = packing.piece_lengths(np.array([5, tokens]), 2048)
        assert got[doc == 0].tolist() == [4, 1]
        full, rest = divmod(tokens, 2048)
        assert got[doc == 1].tolist() == [2048] * full + [1 << b for b in range(10, -1, -1) if rest >> b & 1]
    assert packing.piece_lengths(np.array([3]), 1)[1].tolist() == [1, 1, 1]


def test_round_trip(spark):
    texts = ["", None, "one two, three!", "The same text's end", "The same text's end", "word " * 5000, "Éa ß ### 12%"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id bigint, text string, start int")
    rows = packing.pack(docs.repartition(3), PATH).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    for i, t in [*enumerate(texts), (None, "no id")]:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids_of(t)
        at = 0
        for r in own:
            assert (r["start"], r["offset"], r["doc_tokens"]) == (at, 0, len(ids_of(t)))
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
            at += r["length"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 2, "doc_id bigint, text string")
    assert packing.pack(docs, PATH, with_ids=False).agg(F.sum("length")).first()[0] == 2 * len(ids_of("a b c"))
