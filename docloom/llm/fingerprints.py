"""Document fingerprints from closed syncmers.

A window of K code points is a closed syncmer if the smallest of its inner S-grams (by hash) is its
first or its last one. The choice depends on the window alone, so equal passages give equal anchors
wherever they stand, and windows of K - S + 1 steps always hold one. A fingerprint keeps the SKETCH
anchors of smallest hash, each with the position of its first occurrence, and the text's length.
Likeness is the share of the smallest anchors of the union that both have; anchors beyond the shared
range of hashes say nothing and are left out. Positions serve matching: ``offsets`` lists by how much
shared anchors are shifted.

Null texts count as empty. A text shorter than K is one anchor of its own, an empty one has none;
likeness of two empty texts is 1, of an empty and another 0. Repeated rows are fingerprinted alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import gram_hash, mix, partitions_for, prefix_hash, range_hash, small_batches

K, S = 24, 8
SKETCH = 64
#: Text bytes of one bucket of neighbouring doc_ids.
BUCKET_BYTES = 8 << 20
#: Buckets at most (their bounds are known to the driver); larger inputs have larger buckets.
MAX_BUCKETS = 50_000


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the text's closed syncmers, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = prefix_hash(points)
    if len(points) < k:
        return mix(prefix[-1:] + np.uint64(len(points))), np.zeros(1, np.int64)
    inner = gram_hash(prefix, s)
    width = k - s + 1
    low = inner
    reach = 1
    while reach < width:  # minima of windows of doubling width
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    n = len(points) - k + 1
    chosen = np.flatnonzero((inner[:n] == low) | (inner[width - 1 : width - 1 + n] == low))
    return range_hash(prefix, chosen, chosen + k), chosen


def fingerprint(text: str) -> str:
    """``n_chars:hash.position,…`` in hexadecimal, anchors by ascending hash."""
    hashes, at = anchors(text)
    if len(hashes) > 4 * SKETCH:
        near = np.partition(hashes, 4 * SKETCH)[4 * SKETCH]
        few = hashes <= near
        if len(np.unique(hashes[few])) >= SKETCH:
            hashes, at = hashes[few], at[few]
    unique, first = np.unique(hashes, return_index=True)
    pairs = zip(unique[:SKETCH].tolist(), at[first[:SKETCH]].tolist(), strict=True)
    return f"{len(text):x}:" + ",".join(f"{h:016x}.{p:x}" for h, p in pairs)


def _parse(fp: str) -> dict[str, int]:
    body = fp.partition(":")[2]
    return {x[:16]: int(x[17:], 16) for x in body.split(",")} if body else {}


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the anchor sets, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = _parse(a), _parse(b)
    union = sorted(x.keys() | y.keys())[:SKETCH]
    if not x or not y:
        return 0.0
    return sum(h in x and h in y for h in union) / len(union)


def offsets(a: str, b: str) -> Counter:
    """Shifts of shared anchors from ``a`` to ``b``, with their numbers."""
    x, y = _parse(a), _parse(b)
    return Counter(y[h] - x[h] for h in x.keys() & y.keys())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Rows (bucket, last, doc_id, text), dealt by ranges of doc_id, such that in every bucket, sorted by
    (last, doc_id, text), each row but the one with ``last`` is followed by the next row of the whole.

    A bucket closes with a copy of the first row of the next bucket (the last with that of the first).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    n = min(int((facts.bytes or 0) // bucket_bytes) + 1, MAX_BUCKETS)
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000).alias("p")
                      ).first().p if n > 1 else []
    bounds = sorted(set(bounds or []))
    bucket = F.lit(0)
    if bounds:  # the number of bounds at or below doc_id: first of every width-th, then within that stretch
        width = int(len(bounds) ** 0.5) + 1
        edges, doc = F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("doc_id")
        coarse = F.array(*[F.lit(b).cast("long") for b in bounds[width - 1 :: width]])
        passed = width * F.size(F.filter(coarse, lambda e: e <= doc))
        bucket = passed + F.size(F.filter(F.slice(edges, passed + 1, width), lambda e: e <= doc))
    return rows.select(F.coalesce(bucket, F.lit(0)).cast("int").alias("bucket"), "doc_id", "text"), n


def report(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses.

    "Next" is the next row by (doc_id, text), after the last the first; null ids come first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, n = with_next(docs, bucket_bytes)
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    heads = rows.groupBy("bucket").agg(F.min(order).alias("head")).collect()  # a row for each bucket
    used = sorted(r.bucket for r in heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    closing = spark.createDataFrame([(r.bucket, before[r.bucket], r.head) for r in heads], "bucket int, to int, head long")
    # the first document of each bucket also goes to the end of the bucket before
    firsts = rows.join(F.broadcast(closing), "bucket").filter(order == F.col("head"))
    closing = firsts.groupBy("to").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    closing = closing.select(F.col("to").alias("bucket"), F.lit(1).alias("last"), "doc_id", "text")
    dealt = rows.select("bucket", F.lit(0).alias("last"), "doc_id", "text").unionByName(closing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None
        for batch in batches:
            out = []
            for last, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                own = held[2] if held is not None and held[1] == text else fingerprint(text)
                if held is not None:
                    changed = edited(held[1], text)
                    other = held[2] if changed == held[1] else fingerprint(changed)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                held[2], other, likeness(held[2], other), likeness(held[2], own)))
                held = None if last else (doc, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out
                else [pa.array([], t) for t in types], names)

    return dealt.repartition(partitions_for(spark, n * bucket_bytes, bucket_bytes), "bucket").sortWithinPartitions(
        "bucket", "last", F.col("doc_id").asc_nulls_first(), "text").select("last", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
