import re

import numpy as np

import corpus_pipeline
from docloom.llm import decontaminate, queries, secrets


def test_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {0: docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[i], sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        kept[i + 1] = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept[i + 1].columns == columns, name
    texts = [{r.doc_id: r.text for r in kept[i].collect()} for i in range(5)]
    letters = {d for d, t in texts[0].items() if t and re.search(r"[^\W\d_]", t)}
    assert set(texts[1]) == letters

    sets = {}
    for d, t in texts[1].items():
        words = t.encode().lower().split()
        sets[d] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(texts[2]) == {find(d) for d in ids}

    leaks = {r.doc_id for r in decontaminate.contaminated(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaks and set(texts[3]) == set(texts[2]) - leaks
    assert set(texts[4]) == set(texts[3])
    weights = secrets.train(secrets.labelled_samples(spark))
    marked = {r.doc_id for r in secrets.scan(kept[3], weights).collect() if r.spans}
    assert marked and {d for d in texts[4] if texts[4][d] != texts[3][d]} == marked
    assert not [r for r in secrets.scan(kept[4], weights).collect() if r.spans]

    from tokenizers import Tokenizer

    slow, packed = Tokenizer.from_file(queries.public_tokenizer()[0]), {}
    for r in kept[5].orderBy("doc_id", "start").collect():
        packed.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert packed == {d: slow.encode(t, add_special_tokens=False).ids + [0] for d, t in texts[4].items()}


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:3] == ["doc_id", "start", "length"]


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(1, None, None, None, None, 0.1), (2, "", "en", "s", 0, None), (None, "some english text here", "en", "s", 1, 0.2), (3, "words " * 50_000, "en", "s", 5, 0.3),
            (4, "a clean little text about things", "en", None, None, 0.4), (4, "a clean little text about things", "en", None, None, 0.4)]
    for k, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(str(tmp_path / f"{k}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{i}"))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        assert {r.doc_id for r in docs.collect()} == ({None, 3, 4} if given else set())
