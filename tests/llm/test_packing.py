import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import public_tokenizer


@pytest.mark.parametrize("range_bytes", [16 << 20, 50_000])
def test_pieces_tile_documents_and_sequences(spark, sf_dir, range_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slow = Tokenizer.from_file(public_tokenizer()[0])
    rows = packing.pieces(packing.pack(docs, *public_tokenizer(), range_bytes=range_bytes)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc in docs.select("doc_id", "text").collect():
        ids, at = slow.encode(doc.text, add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[doc.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, "a b <|endoftext|> c 你好 " * 3), (None, "x"), (3, "long word " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = packing.pack(df, *public_tokenizer(), range_bytes=100_000).collect()
    slow = Tokenizer.from_file(public_tokenizer()[0])
    assert sum(r.length for r in got) == sum(len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert packing.pack(df.limit(0), *public_tokenizer()).count() == 0


def test_both_encoders_agree(spark):
    path, ranks, pattern = public_tokenizer()
    fast, slow = packing.tokenizer(path, ranks, pattern), packing.tokenizer(path, None, pattern)
    for text in ("", "Hello  world\n\n  x'll", "éàß ñandú <|endoftext|>\t1234", "a" * 500, "!!! --- 12.5%"):
        assert fast(text).tolist() == slow(text).tolist()


def test_hilbert_curve_visits_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_stand_near(spark):
    import pyarrow as pa

    base = " ".join(f"w{i}" for i in range(400))
    keys = packing.curve_keys(pa.array([base, base + " tail", None, ""]))
    assert packing.curve_keys(pa.array([base]))[0] == keys[0] and keys[2] == keys[3]


def test_stretches_of_a_long_text_give_its_ids(monkeypatch):
    slow = packing.tokenizer(public_tokenizer()[0], None, "")
    text = "plain words here, l'été 你好  two blanks\n\nand 'll (x) 12 end " * 40
    monkeypatch.setattr(packing, "STRETCH", 50)
    assert "".join(packing.stretches(text, 50)) == text and len(list(packing.stretches(text, 50))) > 20
    whole = Tokenizer.from_file(public_tokenizer()[0]).encode(text, add_special_tokens=False).ids
    assert np.concatenate([slow(x) for x in packing.stretches(text, 50)]).tolist() == whole


def test_copies_spread_over_streams(spark):
    df = spark.createDataFrame([(i if i % 2 else None, "the same words " * 50) for i in range(2000)], "doc_id long, text string")
    got = packing.pack(df, *public_tokenizer(), range_bytes=50_000).collect()
    streams = defaultdict(int)
    for r in got:
        streams[r.sequence_id >> 32] += r.length
    assert len(streams) > 10 and max(streams.values()) < 0.3 * sum(streams.values())
