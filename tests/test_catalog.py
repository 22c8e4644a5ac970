import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from docloom.plans import load_catalog  # noqa: E402
from docloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from oracle import assert_same  # noqa: E402

load_catalog()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_embedding_is_deterministic(spark, sf_dir):
    first, again = (QUERIES["embed_texts"](spark, sf_dir).orderBy("item_id").collect() for _ in range(2))
    assert first == again
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in first)


def test_stream_ingests_every_document_once(spark, sf_dir):
    rows = QUERIES["stream_ingest"](spark, sf_dir)
    assert rows.count() == rows.select("document_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
