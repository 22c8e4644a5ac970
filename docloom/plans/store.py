"""Queries on collections: identifiers, payloads, upserts, deletes, existence, statistics, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import models
from docloom.functions import ids
from docloom.operators import store
from docloom.plans.catalog import query
from docloom.session import table
from docloom.streaming.ingest import ingest, windowed_counts

_HEX = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({n}))"


@query("point_id", f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  CASE CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT doc_id, {_HEX.format(n="printf('chunk_%05d_x', doc_id)")} AS h FROM documents)""")
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.point_id(F.format_string("chunk_%05d_x", "doc_id")).alias("point_id"))


@query("payload_json", """SELECT vec_id, '{"chunk_id":"c' || vec_id || '","page":' || label || CASE WHEN vec_id % 2 = 0 THEN ',"bounding_box":{"x0":0.5}' ELSE '' END || '}' AS payload FROM embeddings""")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("label").alias("page"),
                                                     F.when(F.col("vec_id") % 2 == 0, F.struct(F.lit(0.5).alias("x0"))).alias("bounding_box"))
    return rows.select("vec_id", store.payload_json("chunk_id", "page", "bounding_box").alias("payload"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 0 ELSE 1 END)::BIGINT AS with_key FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").isNotNull().cast("long")).alias("with_key"))


_STATE = "SELECT doc_id, source, lang FROM documents"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


@query("upsert_points", f"""SELECT * FROM ({_STATE}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 BETWEEN 4 AND 7)
  UNION ALL SELECT doc_id, 'new', lang FROM documents WHERE doc_id % 10 BETWEEN 4 AND 7""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").filter("doc_id % 10 between 4 and 7").select("doc_id", F.lit("new").alias("source"), "lang")
    twice = new.withColumns({"source": F.lit("older"), "seq": F.lit(1)}).unionByName(new.withColumn("seq", F.lit(2)))
    return store.upserted(_old(spark, sf_dir), twice, ["doc_id"], "seq")


@query("delete_document", f"SELECT * FROM ({_STATE}) WHERE source NOT IN ('src1', 'src2')")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return store.without(_old(spark, sf_dir), gone, "source")


@query("pending_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("document_exists", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS indexed FROM documents")
def document_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.indexed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("vector_counts", "SELECT label, count(*) AS vectors FROM embeddings GROUP BY label")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.point_counts(table(spark, sf_dir, "embeddings"), "label")


@query("document_json", """SELECT doc_id, '{"document_id":"d' || doc_id || '","filename":"' || source || '","title":"","metadata":{"pages":"' || CASE WHEN doc_id % 2 = 0 THEN 99 ELSE 3 END || '"' ||
  CASE WHEN doc_id % 2 = 0 THEN ',"venue":"v"' ELSE '' END || '},"ocr_applied":false}' AS payload FROM documents""")
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("pages"), F.lit("99"), F.lit("venue"), F.lit("v")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.col("source").alias("filename"), F.lit("").alias("title"),
        F.struct(F.lit(None).cast("string").alias("year"), F.lit(3).alias("pages"), F.lit(None).cast("string").alias("doi"), extra.alias("extra")).alias("metadata"),
        F.lit(None).cast("array<string>").alias("sections"), F.lit(None).cast("array<string>").alias("images"), F.lit(None).cast("array<string>").alias("tables"),
        F.lit(False).alias("ocr_applied"), F.lit(None).cast("array<string>").alias("parse_errors"))
    return rows.select("doc_id", store.document_json().alias("payload"))


@query("embed_texts")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = models.embed_texts(models.HashEmbedder(64))
    return table(spark, sf_dir, "benchmark").select("item_id", embed(F.col("text")).alias("vector"))


@query("window_counts", """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windowed_counts(table(spark, sf_dir, "events"))
    return made.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_ingest")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run an available-now stream over the documents into a collection; the collection's rows."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/docloom"
    root = f"{conf}/stream-{uuid.uuid4().hex}"
    schema = T.StructType.fromDDL("document_id string, chunk_id string, n_chars long")
    kept = store.Collection(spark, f"{root}/points", schema, buckets=8)

    def build(batch: DataFrame) -> DataFrame:
        return batch.select("document_id", F.col("document_id").alias("chunk_id"), "n_chars")

    source = f"{root}/in"
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "n_chars").write.parquet(source)
    ingest(spark, source, T.StructType.fromDDL("document_id string, n_chars long"), kept, f"{root}/checkpoint", build).awaitTermination()
    return kept.read()
