import hashlib
import random
import re
import string

import pytest

from docloom.llm import queries, secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


@pytest.fixture(scope="module")
def weights(spark):
    return secrets.train(secrets.labelled_samples(spark))


def test_whole_table_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op6_secrets(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        found, r = base(doc.text), got[doc.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
        assert set(filter(None, joined(found).split(","))) <= set(r.spans.split(","))


def test_edge_texts(spark, weights):
    random.seed(4)
    pieces = ["token", "secret=", ": ", " ", "API_KEY", "apikey", '"', "'", "abcdefghijklmnop", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "passwd = x", "=", "-"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "token=secret=abcdefghijklmnop", "token: token: abcdefghijkl", "x token = abcdefghijklmnop 😀 " * 500]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in secrets.scan(df, weights).collect():
        assert r.base_sha256 == hashlib.sha256(joined(base(texts[r.doc_id] or "")).encode()).hexdigest(), texts[r.doc_id]
    assert secrets.scan(df.limit(0), weights).collect() == []


def test_model_tells_random_strings_from_identifiers(spark, weights):
    rng = random.Random(7)
    noise = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(200)]
    names = ["get_user_name_by_account_identifier", "maximumNumberOfConnectionsPerHost", "APPLICATION_DEFAULT_CREDENTIALS_PATH", "internationalisation-and-localisation",
             "srcmainjavaorgexampleservice", "thereonatinganshthethatandthering", "convertToAbsolutePathIfRelative"]
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(noise + names)], "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.scan(df, weights).collect() if r.spans}
    assert sum(i in flagged for i in range(200)) >= 190
    assert not [names[i - 200] for i in flagged if i >= 200]


def test_redaction(spark, weights):
    rows = [(1, "😀 token = abcdefghijklmnop, 0123456789abcdef0 end", "a", 1), (2, None, "b", 2), (3, "clean", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_spans string, __random int")
    got = secrets.redact(df, weights)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "😀 [secret], [secret] end", 2: None, 3: "clean"}
    assert [(r.base_spans, r["__random"]) for r in got.orderBy("doc_id").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_redaction_of_long_texts(spark, weights):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = ["é" * n + noise(20) + " plain words 😀 " * k + f" token={noise(30)}" for n, k in ((0, 1), (4095, 300), (4096, 255), (9000, 1000))]
    texts += [noise(10_000), "x" * 4096, "é " * 4000 + "password: " + "A1b2" * 2500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(df, weights).collect()}
    for r in secrets.redact(df, weights).collect():
        want, at = "", 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, spans[r.doc_id].split(","))):
            if a >= at:
                want += texts[r.doc_id][at:a] + "[secret]"
            at = max(at, b)
        assert r.text == want + texts[r.doc_id][at:]


def test_many_matches_in_one_text(spark, weights):
    import time

    rng, n = random.Random(5), 50_000
    text = "".join(f"{rng.getrandbits(64):016x} é " for _ in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.scan(df, weights).first()
    assert r.n_hex == n and r.base_sha256 == hashlib.sha256(joined(base(text)).encode()).hexdigest()
    assert secrets.redact(df, weights).first().text == "[secret] é " * n
    assert time.time() - began < 120


def test_random_spans_beside_base_spans(spark, weights):
    key = "Qx7+Zk2LmP0vT9wR" + "0123456789abcdef" + "Yb4/Hn8JcD1sF6gU"
    spans = secrets.scan(spark.createDataFrame([(1, f"see {key} end")], "doc_id long, text string"), weights).first().spans
    assert "hex:20:36" in spans and f"random:4:{4 + len(key)}" in spans


def test_plan_is_native(spark, sf_dir):
    plan = queries.op6_secrets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sums_and_maxima_in_blocks(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 5, 127, 128, 129, 700):
        values = F.expr(f"slice(transform(sequence(1, 700), x -> int(x * 7919 % 701)), 1, {n})")
        row = spark.range(1).select(*(secrets._before(values, f).alias(f.__name__) for f in (secrets._sum, secrets._most))).first()
        given = [x * 7919 % 701 for x in range(1, n + 1)]
        assert row._sum == [sum(given[:i]) for i in range(n)] and row._most == [max([0, *given[:i]]) for i in range(n)]
