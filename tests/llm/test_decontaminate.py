import random
import re
from collections import Counter

import numpy as np

from docloom.llm import decontaminate as dc

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    words = WORD.findall(text.lower())
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def best_window(doc, item):
    """Highest weighted similarity of an item-sized window, by trying all."""
    words, length = WORD.findall(doc.lower()), len(WORD.findall(item.lower()))
    best = 0.0
    for s in range(max(1, len(words) - length + 1)):
        a, b = shingles(" ".join(words[s : s + length])), shingles(item)
        least = sum((a & b).values())
        best = max(best, least / max(1, sum(a.values()) + sum(b.values()) - least))
    return best


def test_planted_passages_against_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(500)]
    draw = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(random.randint(15, 50)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = draw(random.randint(0, 150))
        if d % 2:
            leak = random.choice(items)[1].split()
            for _ in range(d % 5):
                leak[random.randrange(len(leak))] = "changed"
            at = random.randint(0, len(words))
            words[at:at] = leak if d % 3 else leak[: int(len(leak) * 0.9)]
        docs.append((d, ", ".join(words).upper() if d % 4 == 1 else " ".join(words)))
    expected = {}
    for d, text in docs:
        for i, item in items:
            if (alike := best_window(text, item)) >= 0.8:
                expected[d, i] = alike
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert expected
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}


def test_whole_table_finds_verbatim_items(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    flat = lambda t: " ".join(WORD.findall(t.lower()))
    texts = [(r.doc_id, flat(r.text)) for r in docs.collect()]
    verbatim = {(d, i.item_id) for i in items.collect() for d, t in texts if f" {flat(i.text)} " in f" {t} "}
    assert verbatim and verbatim <= got
    kept = dc.clean(docs, items)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _ in texts} - {d for d, _ in got}
    assert kept.columns == docs.columns


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 400, dtype=np.uint64)
    index = dc.Hamming(fps)
    for _ in range(40):
        query = int(fps[rng.integers(400)])
        for bit in rng.choice(64, rng.integers(0, 25), replace=False):
            query ^= 1 << int(bit)
        near = {i for i, f in enumerate(fps.tolist()) if (f ^ query).bit_count() <= dc.RADIUS}
        assert {i for i, _ in index.within(query)} == near


def test_edge_rows(spark):
    items = spark.createDataFrame([(1, "one two", 1), (2, None, 1), (3, "", 1), (4, "a b c d e f g h", 1), (4, "a b c d e f g h", 1), (None, "n o p q r s t", 1)], "item_id long, text string, doc_id long")
    docs = spark.createDataFrame([(1, None, "p"), (2, "x One, two z", "p"), (3, "one b two", "p"), (4, "A B C D E F G H!", "p"), (5, "a b c d e f g", "p"), (6, "a b", "p"),
                                  (4, "A B C D E F G H!", "p"), (None, "a b c d e f g h", "p"), (7, "word " * 100_000, "p"), (8, "m n o p q r s t", "p")], "doc_id long, text string, item_id string")
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect())
    assert got == {(2, 1): 1, (4, 4): 2, (None, 4): 1, (8, None): 1}
    assert dc.contaminated(docs, items, block_bytes=5).count() == 5
    assert sorted((r.doc_id for r in dc.clean(docs, items).collect())) == [1, 3, 5, 6, 7]
    assert dc.contaminated(docs.limit(0), items).collect() == [] and dc.contaminated(docs, items.limit(0)).collect() == []
