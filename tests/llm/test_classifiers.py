import zlib

import numpy as np

from docloom.llm import language, quality, queries


def test_language_on_held_out_documents(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_language(spark, sf_dir).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_ignores_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    blind = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    first, second = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, blind))
    assert first == second


def test_language_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "fr"), (4, "hello there the", "en"), (None, "der hund und die katze", "de"), (3, "123 $$", None), (4, "hello there the", "en")]
    df = spark.createDataFrame([(*r, 0.3) for r in rows], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in language.identify(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (4, "en"), (None, "de"), (3, "und"), (4, "en")], key=str)
    assert {r.score for r in language.identify(df).collect() if r.lang_pred == "und"} == {0.0}
    assert language.identify(df.limit(0)).collect() == []
    kept = language.known_languages(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r.text and r.doc_id not in (2, 3))
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.lang.substr(0, 0)).filter("false").unionByName(df.selectExpr(
        "doc_id", "text", "cast(null as string) lang", "score"))).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "svm", lambda x, y: (np.zeros(x.shape[1]), 0.0, 1.0, 0.0))  # only who competes
    rows = [(10 * i + k, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} " * 20, f"l{i:03d}") for i in range(230) for k in range(3)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    learned = {name for contest in model.within.values() for name in contest.names}
    assert learned == {lang for doc, _, lang in rows if zlib.crc32(str(doc).encode()) % 4 != 2}


def test_decisions_against_one_versus_one_by_hand():
    rng = np.random.default_rng(2)
    names = np.array(["de", "en", "fr", "it"])
    centres = rng.normal(0, 1, (4, 12))
    labels = names[rng.integers(0, 4, 300)]
    x = (centres[np.searchsorted(names, labels)] + rng.normal(0, 0.8, (300, 12))).astype(np.float32)
    contest = language.Contest.fit(x, labels.astype(object))
    best, share = contest.decide(x)
    for row, found, sure in zip(x, best, share, strict=True):
        votes, chances, machine = dict.fromkeys(names, 0), {n: [] for n in names}, 0
        for i, one in enumerate(names):
            for two in names[i + 1 :]:
                margin = float(np.dot(row, contest.weights[machine]) + contest.biases[machine])
                p = 1 / (1 + np.exp(-(margin * contest.slopes[machine] + contest.shifts[machine])))
                votes[one if p >= 0.5 else two] += 1
                chances[one].append(p)
                chances[two].append(1 - p)
                machine += 1
        most = max(votes.values())
        winner = max((n for n in names if votes[n] == most), key=lambda n: np.mean(chances[n]))
        assert contest.names[found] == winner and abs(np.mean(chances[winner]) - sure) < 1e-5
    assert (names[best] == labels).mean() > 0.85


def test_machine_separates_and_calibrates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1, 1, (200, 5)), rng.normal(-1, 1, (200, 5))]).astype(np.float32)
    y = np.repeat([1.0, -1.0], 200)
    w, bias, a, b = language.svm(x, y)
    assert (np.sign(x @ w + bias) == y).mean() > 0.95
    p = 1 / (1 + np.exp(-(a * (x @ w + bias) + b)))
    assert abs(p.mean() - 0.5) < 0.05


def test_quality_on_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    asked = F.col("doc_id") % 3 == 0
    model = quality.train(docs, labels.filter(~asked))  # a third of the labels is not seen
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    unseen = labels.filter(asked).collect()
    assert sum((got[r.doc_id].quality >= 0.5) == bool(r.quality) for r in unseen) >= 0.93 * len(unseen)
    flagged = [r for r in unseen if got[r.doc_id].toxic > 0.5]
    toxic = [r for r in unseen if r.toxic]
    print("toxic:", len(toxic), "flagged:", len(flagged), "right:", sum(bool(r.toxic) for r in flagged))
    assert sum(bool(r.toxic) for r in flagged) >= 0.9 * len(flagged)  # precision
    assert sum(got[r.doc_id].toxic > 0.5 for r in toxic) >= 0.4 * len(toxic)  # recall; "never toxic" has none
    assert all(r.keep == (r.quality >= 0.5 and r.toxic <= 0.5) and abs(r.score - r.quality * (1 - r.toxic)) < 1e-9 for r in got.values())


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "hello there", "xx", "s", -5, 1), (4, "w " * 100_000, "en", "s", 200_000, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long, quality int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None and quality.train(docs, labels.limit(0)) is None
    assert [r.keep for r in quality.score(docs, None).collect()] == [True] * 4
    assert quality.score(docs.limit(0), None).collect() == []
    many = spark.range(120).selectExpr("id doc_id", "if(id % 2 = 0, concat('good text ', id, ' about things'), concat('bad !!! ', id)) text", "'en' lang", "'s' source", "10L n_chars")
    model = quality.train(many, many.selectExpr("doc_id", "int(doc_id % 2 = 0) quality", "int(doc_id % 2) toxic"))
    assert all(r.keep == (r.doc_id % 2 == 0) for r in quality.score(many, model).collect())
    assert quality.score(docs, model).count() == 4


def test_statistics_count_repeats():
    import pyarrow as pa

    stats, words = quality.statistics(pa.array(["a a a b", None, "Idiot! idiots"]))
    k = len(quality.KINDS)
    assert np.isclose(stats[0, k + 2], 0.5) and np.isclose(stats[0, k + 3], 0.5) and np.isclose(stats[0, k + 4], 0.75)
    assert stats[1].sum() == 0 and len(words[1]) == 0
    assert len(words[2]) == 4  # idiot, idiots and their beginnings of four and five bytes
