import random

from docloom.llm import neardup


def draw(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"e{rng.randrange(10**9)}"
    return words


def grouped(texts):
    """Smallest number of each text's group by the similarity of all pairs."""
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in range(len(sets))}


def found(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_among_texts_of_a_template(spark):
    rng = random.Random(5)
    template, texts = draw(rng, 142), []
    for _ in range(300):
        own = template + draw(rng, 24)
        texts += [own, edited(rng, own, 3)]
    rng.shuffle(texts)
    want = grouped(texts)
    assert len(set(want.values())) == 300
    assert found(spark, texts) == want


def test_chains_of_gradual_edits(spark):
    rng, texts = random.Random(6), []
    for _ in range(12):
        now = draw(rng, 110)
        for _ in range(40):
            texts.append(now)
            now = edited(rng, now, 2)
    rng.shuffle(texts)
    assert found(spark, texts) == grouped(texts)


def test_copy_with_a_line_repeated(spark):
    rng, texts = random.Random(7), []
    for _ in range(40):
        own, line = draw(rng, 204), draw(rng, 9)
        texts += [own, own + 100 * line]
    want = grouped(texts)
    assert len(set(want.values())) == 40
    assert found(spark, texts) == want


def test_crowded_postings_are_dealt_out(spark):
    rng, line, texts = random.Random(8), draw(random.Random(9), 60), []
    for _ in range(150):
        own = line + draw(rng, 90)
        texts += [own, edited(rng, own, 2)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = grouped(texts)
    assert len(set(want.values())) == 150
    for crowd in (20_000, 20):
        assert {r.doc_id: r.component_id for r in neardup.groups(df, sample=1, crowd=crowd).collect()} == want


def test_bitmaps_never_drop_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 5, 63, 64, 65, 400, 5000):
        both = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for extra in (0, 1, size // 5, size):
            x, y = both, np.unique(np.concatenate([both, rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
            assert neardup.differing(neardup.parity(x), neardup.parity(y)) <= len(y) - len(x)


def test_id_filter_holds_its_ids(spark):
    from docloom.llm.common import id_filter, perhaps_in

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    marked = perhaps_in(rows, id_filter(rows.filter("doc_id % 10 = 0")), "hit")
    got = [(r.doc_id, r.hit) for r in marked.collect()]
    assert len(got) == 20_000 and all(hit for i, hit in got if i % 10 == 0)
    assert sum(hit for i, hit in got if i % 10) < 100
    assert not [r for r in perhaps_in(rows, id_filter(rows.limit(0)), "hit").collect() if r.hit]
