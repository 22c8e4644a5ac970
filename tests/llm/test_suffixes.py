import hashlib
import random

import numpy as np
import pytest

from docloom.llm import suffixes as sx


def brute(rows):
    first, out = {}, {}
    for d, x in rows:
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(d, first.get(x[i : i + 50], d))
    for d, x in rows:
        mark = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                mark[i : i + 50] = 1
        kept = bytes(np.frombuffer(x, np.uint8)[mark[:-1] == 0])
        spans = int((np.diff(np.concatenate([[0], mark])) == 1).sum())
        out.setdefault(d, []).append((len(x), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, expected):
    for r in frame.collect():
        if r.doc_id in expected:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in expected[r.doc_id], r


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 60_000, "bucket_bytes": 40_000}])
def test_whole_table_against_brute_force(spark, sf_dir, sizes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(sx.digest(sx.cleaned(docs, **sizes)), brute([(r.doc_id, r.text.encode()) for r in docs.collect()]))


def test_edge_rows(spark):
    rows = [(5, "ab" * 300), (6, "ab" * 100 + "x" + "ab" * 40), (7, "x" * 49), (8, "x" * 50), (9, "x" * 120), (1, "zz" + "x" * 51), (3, ""), (2, "q" * 200), (2, "q" * 100),
            (4, "hello world this is a long passage of more than fifty bytes é" * 2), (11, "A hello world this is a long passage of more than fifty bytes é B"),
            (12, "w " * 100_000), (13, "w " * 60)]
    df = spark.createDataFrame([(*r, "s") for r in [*rows, (None, "ab" * 300), (14, None)]], "doc_id long, text string, spans string")
    got = sx.digest(sx.cleaned(df))
    assert got.count() == len(rows) + 2
    check(got, brute([(d, x.encode()) for d, x in rows]))
    assert got.filter("doc_id is null").first().n_removed == 0
    assert sx.digest(sx.cleaned(df.limit(0))).collect() == []


def test_loser_tree_merges_with_common_prefixes():
    random.seed(1)
    for runs in (1, 2, 3, 5, 8, 13):
        parts = [sorted(bytes(random.choice(b"ab") for _ in range(6)) for _ in range(random.randint(1, 30))) for _ in range(runs)]
        matrix = lambda x: np.array([list(s) for s in x], np.uint8)
        order, prefixes = sx.merge([(p, bytes(sx.common_prefixes(matrix(p)).astype(np.uint8))) for p in parts])
        iterators = [iter(p) for p in parts]
        merged = [next(iterators[i]) for i in order]
        assert merged == sorted(s for p in parts for s in p)
        assert prefixes == sx.common_prefixes(matrix(merged)).tolist()


def test_front_coding_round_trip():
    rng = np.random.default_rng(2)
    rows = np.sort(rng.integers(97, 99, (50, 1)) * np.ones((1, sx.WIDTH), int), axis=0).astype(np.uint8)
    prefix, rest = sx.front_code(rows)
    assert sx.front_decode(prefix, rest) == [r.tobytes() for r in rows]


def test_join_spans():
    spans = np.array([[1, 0, 5], [1, 5, 9], [1, 20, 30], [1, 21, 22], [2, 3, 4], [0, 50, 60]])
    assert sx.join_spans(spans).tolist() == [[0, 50, 60], [1, 0, 9], [1, 20, 30], [2, 3, 4]]
