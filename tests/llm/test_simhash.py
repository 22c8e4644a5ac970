import numpy as np
import pytest
import xxhash

from docloom.llm import neardup, simhash
from docloom.llm.components import components, forest

EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one"), (4, "A b c d e"), (5, "a B c d e"), (6, "  \n"), (7, "word " * 50_000)]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps):
    """Smallest id reachable over pairs of ids within four bits."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    root = forest(len(ids), np.repeat(np.arange(len(ids)), [len(n) for n in near]), np.concatenate(near))
    return {ids[i]: ids[r] for i, r in enumerate(root)}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


def test_edge_rows(spark):
    rows = spark.createDataFrame([(*e, "x", 1.0) for e in EDGES], "doc_id long, text string, fp string, component_id double")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (6, 1), (3, 3), (3, 3), (None, 3), (4, 4), (5, 4), (7, 7)], key=str)
    assert simhash.near_duplicates(rows.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [20_000, 150])
def test_links_of_a_dense_ball(spark, bucket):
    rng = np.random.default_rng(1)
    ball = np.full(1000, rng.integers(0, 2**63, dtype=np.uint64))
    for _ in range(3):
        ball ^= np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)
    fps = np.unique(np.concatenate([ball, rng.integers(0, 2**63, 1000, dtype=np.uint64)]))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), bucket).collect()
    assert len(links) < 15 * 1000 * 7
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = forest(len(fps), np.array([at[r.u] for r in links]), np.array([at[r.v] for r in links]))
    near = [np.flatnonzero(np.bitwise_count(fps ^ v) <= 4) for v in fps]
    assert np.array_equal(got, forest(len(fps), np.repeat(np.arange(len(fps)), [len(n) for n in near]), np.concatenate(near)))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_hold_every_similar_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = r.text.encode().lower().split()
        sets[r.doc_id] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    got = {r.doc_id: r.component_id for r in neardup.groups(docs).collect()}
    ids, pairs = sorted(sets), 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                assert got[a] == got[b]
    assert pairs and len(set(got.values())) < len(got)


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "a"), (2, text.upper(), "b"), (3, text + " more", "c"), (4, "other words here", "d"), (None, text, "e"), (5, None, "f"), (6, "", "g"), (4, "other words here", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands string")
    got = neardup.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 4, 5, None]
    assert neardup.keep_first(df.limit(0)).count() == 0
