"""Queries against their SQL on tables with larger keys and repeated rows than those of the smallest scale."""

import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docloom.plans import load_catalog  # noqa: E402
from docloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from docloom.sources import files  # noqa: E402
from oracle import assert_same  # noqa: E402

load_catalog()


def check(name, frame, table, sf_dir, tmp_path):
    """Hold the query against its SQL on the given tables, ``table`` replaced by ``frame``."""
    for entry in os.listdir(sf_dir):
        if entry != f"{table}.parquet":
            (tmp_path / entry).symlink_to(f"{sf_dir}/{entry}")
    frame.toPandas().to_parquet(tmp_path / f"{table}.parquet")
    assert_same(QUERIES[name](frame.sparkSession, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_sides_of_less_than_a_pixel(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").crossJoin(spark.range(0, 40, 13).withColumnRenamed("id", "step"))
    far = rows.selectExpr("p_partkey + step * 100000 AS p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    check("image_sizes", far, "part", sf_dir, tmp_path)


def test_pages_of_one_address_and_of_one_key(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.unionAll(pages.selectExpr("page_id + 1001", "url", "html")).unionAll(pages.filter("page_id < 9"))
    check("source_resolution", rows, "pages", sf_dir, tmp_path)


def test_a_document_has_one_source(spark):
    key = "0123456789abcdef"
    docs = spark.createDataFrame([(key, "a.pdf", 1), (key, "b.pdf", 2), ("-", "c.pdf", 3), ("-", "d.pdf", 4)], "document_id string, filename string, name int")
    listing = spark.createDataFrame([(f"/up/{n}",) for n in (f"{key}_y.pdf", f"{key}_x.pdf", "a.pdf", "c.pdf", "c.pdf")], "path string")
    first = {1: f"/up/{key}_x.pdf", 2: f"/up/{key}_x.pdf", 3: "/up/c.pdf", 4: None}
    assert {r.name: r.source_path for r in files.resolve_files(docs, listing).collect()} == first
    every = sorted((r.name, r.source_path or "") for r in files.matching_files(docs, listing).collect())
    assert every == [(k, f"/up/{key}_{x}.pdf") for k in (1, 2) for x in "xy"] + [(3, "/up/c.pdf")] * 2 + [(4, "")]
