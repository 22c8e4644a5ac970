from pyspark.sql import functions as F

from docloom.operators import ann, search


def test_every_row_is_indexed_and_recall_holds(spark, sf_dir, tmp_path):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("text"))
    centroids = ann.fit(points, 12)
    ann.write_index(points, centroids, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == points.count()
    queries = [r.text for r in points.filter("chunk_id % 100 = 0").collect()]
    assert ann.recall(index, centroids, queries, 10, probes=8) >= 0.9
    assert ann.recall(index, centroids, queries[:2], 10, probes=12) == 1.0
    some = ann.top_k(index, centroids, queries[0], 5, probes=2)
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().executedPlan().toString()
    assert some.first().chunk_id == search.top_k(points, queries[0], 1).first().chunk_id


def test_null_vectors_are_kept(spark, tmp_path):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "chunk_id long, text array<double>")
    centroids = ann.fit(points, 2)
    assert ann.assigned(points, centroids).count() == 3
