"""Collections of points as Parquet tables, with idempotent upserts and deletes by document.

A collection is a folder of Parquet files partitioned by ``bucket``, a hash of document_id, so that one
write touches the buckets of its documents and a document's rows are found by partition pruning however
many documents there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import ids
from docloom.functions import vector as vx
from docloom.schemas import TEXT_DIM, VISUAL_DIM


def bucket_of(document_id, buckets: int):
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def upserted(target: DataFrame, source: DataFrame, key: list[str], sequence: str | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with the same key; of several source rows
    with one key the last stays: that of the greatest ``sequence`` (a column of the source alone), or by place."""
    rest = F.struct(*[c for c in source.columns if c not in (*key, sequence)])
    placed = source.withColumn("__place", F.monotonically_increasing_id() if sequence is None else F.col(sequence))
    once = placed.groupBy(*key).agg(F.max_by(rest, "__place").alias("s")).select(*key, "s.*")
    return target.join(source.select(*key), key, "left_anti").unionByName(once.select(*target.columns))


def without(points: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """``points`` but those of the documents ``gone``."""
    return points.join(gone.select(key).distinct(), key, "left_anti").select(*points.columns)


def pending(documents: DataFrame, points: DataFrame, key: str = "document_id") -> DataFrame:
    """Those of ``documents`` that have no point."""
    return documents.join(points.select(key).distinct(), key, "left_anti")


def indexed(documents: DataFrame, points: DataFrame, key: str = "document_id", flag: str = "indexed") -> DataFrame:
    """``documents`` with ``flag``: whether they have a point."""
    held = points.select(key).distinct().withColumn(flag, F.lit(True))
    return documents.join(held, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def point_counts(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.count("*").alias("vectors"))


class Collection:
    """A Parquet table of points at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...] = ("document_id", "chunk_id"),
                 buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def exists(self) -> bool:
        fs, path, _ = self._fs()
        return fs.exists(path)

    def ensure(self) -> None:
        """Create the collection if it is absent."""
        if not self.exists():
            self._empty().write.partitionBy("bucket").parquet(self.path)

    def drop(self) -> None:
        fs, path, _ = self._fs()
        fs.delete(path, True)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())]))

    def _rows(self) -> DataFrame:
        if not self.exists():
            return self._empty()
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self, document_id: str | None = None) -> DataFrame:
        """Points, of one document if given: only its bucket is read."""
        rows = self._rows()
        if document_id is not None:
            own = self.spark.range(1).select(bucket_of(F.lit(document_id), self.buckets).alias("b")).first().b
            rows = rows.filter((F.col("bucket") == own) & (F.col("document_id") == document_id))
        return rows.drop("bucket")

    def _replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Write the touched buckets anew: first beside the table, then over its partitions in one commit."""
        fs, _, jvm = self._fs()
        beside = f"{self.path}.{uuid.uuid4().hex}.tmp"
        numbers = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most self.buckets
        try:
            kept = self._rows().filter(F.col("bucket").isin(numbers))
            rows(kept).repartition("bucket").write.partitionBy("bucket").parquet(beside)
            made = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(beside)
            left = {r.bucket for r in made.select("bucket").distinct().collect()}
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            for number in set(numbers) - left:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={number}"), True)
        finally:
            fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)

    def upsert(self, points: DataFrame) -> int:
        """Insert or replace points by key; the number of rows given. Nothing happens to other buckets."""
        self.ensure()
        new = points.select(*self.schema.fieldNames()).withColumn("bucket", bucket_of(F.col("document_id"), self.buckets))
        n = new.count()
        if n:
            self._replace(lambda kept: upserted(kept, new, self.key), new)
        return n

    def delete(self, document_ids: list[str] | DataFrame) -> None:
        """Remove all points of the documents."""
        if not self.exists():
            return
        ids_df = document_ids if isinstance(document_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        gone = ids_df.select("document_id", bucket_of(F.col("document_id"), self.buckets).alias("bucket"))
        self._replace(lambda kept: without(kept, gone), gone)

    def has(self, document_id: str) -> bool:
        return len(self.read(document_id).limit(1).take(1)) > 0

    def count(self, document_id: str | None = None) -> int:
        return point_counts(self.read(document_id)).first().vectors

    def pending(self, documents: DataFrame) -> DataFrame:
        """Those of ``documents`` that have no point yet."""
        return pending(documents, self.read())


def text_points(chunks: DataFrame) -> DataFrame:
    """Chunks with an ``embedding`` as points: id, vector ``text``, payload columns."""
    return chunks.withColumn("point_id", ids.point_id(F.col("chunk_id"))).withColumnRenamed("embedding", "text_vector")


def visual_points(chunks: DataFrame, visual_dim: int = VISUAL_DIM, text_dim: int = TEXT_DIM) -> DataFrame:
    """Multimodal chunks as points: zeros stand for a missing vector."""
    return chunks.withColumns({
        "point_id": ids.point_id(F.concat_ws("/", "document_id", "chunk_id")),
        "visual": vx.zero_filled(F.col("visual_embedding"), visual_dim),
        "text": vx.zero_filled(F.col("text_embedding"), text_dim),
    }).drop("visual_embedding", "text_embedding")


def payload_json(*columns: str):
    """Payload of a point as JSON; nulls are left out."""
    return F.to_json(F.struct(*columns))


def document_json():
    """Canonical nesting of a parsed document; extra metadata stands beside the fixed keys and wins over them."""
    fixed = F.from_json(F.to_json(F.struct(
        F.col("metadata.year").alias("year"), F.col("metadata.pages").alias("pages"), F.col("metadata.doi").alias("doi"))), "map<string,string>")
    extra = F.coalesce("metadata.extra", F.expr("map('', '')"))
    named = F.map_filter(extra, lambda k, v: k != "")
    metadata = F.map_concat(F.map_filter(fixed, lambda k, v: ~F.map_contains_key(named, k)), named)
    return F.to_json(F.struct("document_id", "filename", "title", metadata.alias("metadata"), "sections", "images", "tables",
                              "ocr_applied", "parse_errors"))


def export_documents(documents: DataFrame, path: str) -> None:
    """One folder of JSON for each bucket of documents, overwritten as a whole."""
    documents.withColumn("bucket", bucket_of(F.col("document_id"), 64)).write.mode("overwrite").partitionBy("bucket").json(path)
