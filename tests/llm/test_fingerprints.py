import hashlib

import pytest

from docloom.llm import fingerprints as fp


@pytest.mark.parametrize("bucket", [8 << 20, 30_000, 3_000])
def test_whole_table_against_brute_force(spark, sf_dir, bucket):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fp.report(docs, bucket).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.fingerprint(text), fp.fingerprint(changed))
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.likeness(r.fingerprint, fp.fingerprint(after))


def test_likeness_estimates_shared_anchors(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) > 1500][:40]
    for a, b in zip(texts, texts[1:], strict=False):
        mixed = fp.edited(a, b)
        x, y = (set(fp.anchors(t)[0].tolist()) for t in (a, mixed))
        assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(mixed)) - len(x & y) / len(x | y)) < 0.25
        assert fp.offsets(fp.fingerprint(a), fp.fingerprint(mixed)).most_common(1)[0][0] == 0


def test_anchors_are_closed_syncmers():
    text = "The quick brown fox jumps over the lazy dog and runs away from the bear."
    hashes, at = fp.anchors(text)
    gram = {text[i : i + fp.S]: fp.gram_hash(fp.prefix_hash(fp.np.frombuffer(text.encode("utf-32-le"), "<u4")), fp.S)[i] for i in range(len(text) - fp.S + 1)}
    expected = []
    for i in range(len(text) - fp.K + 1):
        inner = [gram[text[j : j + fp.S]] for j in range(i, i + fp.K - fp.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            expected.append(i)
    assert at.tolist() == expected
    shifted, _ = fp.anchors("xx" + text)
    assert set(hashes.tolist()) <= set(shifted.tolist())  # what is chosen does not depend on context
    assert max(fp.np.diff(at)) <= fp.K - fp.S + 1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, "a b"), (None, "x"), (3, "long word " * 20_000), (4, "long word " * 20_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, bucket string")
    got = fp.report(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 0].near_next == 1.0 and by[2, 0].near_next == 0.0 and by[3, 200_000].near_next == 1.0
    assert by[3, 200_000].fingerprint == by[4, 200_000].fingerprint
    assert by[None, 1].edited_sha256 == hashlib.sha256(b"x").hexdigest()
    assert fp.report(df.limit(0)).collect() == []
    only = fp.report(df.filter("doc_id = 3")).first()
    assert only.near_next == 1.0
