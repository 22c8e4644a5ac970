"""SimHash near-duplicates: pivot distance tables over a lossless block index.

Fingerprints within ``RADIUS`` bits agree on at least two of six bit blocks, so fifteen tables keyed
by two blocks hold every linked pair in some bucket. Inside a bucket the Hamming distances of each
member to the reference fingerprints (pivots) are worked out once; by the triangle inequality a pair
whose distances to any pivot differ by more than the radius cannot link. Members are sorted by their
first pivot distance, so such pairs are mostly never formed; the others are dropped coordinate by
coordinate, and survivors are verified bit by bit. A bucket sends out a spanning forest of its links,
so a large group of near copies costs no square of rows.

Null texts count as empty; texts without words have fingerprint zero, which links like any other.
Rows with a null doc_id link too, but name a component only if no other id is in it (then null).
Repeated rows come back as often as they went in; an empty table gives an empty one; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches
from docloom.llm.components import components, forest

RADIUS = 4
#: Bit blocks of a fingerprint; pairs of them are the tables' keys.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 16
#: Members of a bucket tested together; larger buckets are dealt out as pairs of parts.
BUCKET = 20_000


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, by rule: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot%d" % i, 42) for i in range(n)], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the shingles of ``words`` lower-cased words, repeats included."""
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), 42)
    hashes = [digest(b" ".join(parts[i : i + words]), 42) for i in range(len(parts) - words + 1)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            made = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts),
                               np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bucket_links(key: np.ndarray, part: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int = RADIUS
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each bucket; ``key`` numbers the buckets.

    ``part`` is below 0 where a bucket is whole; else only pairs of different parts are tested
    (pairs of one part meet in the bucket of that part alone).
    """
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], key))
    key, part, fps, table = key[order], part[order], fps[order], table[order]
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    lag, held_a, held_b, held = 0, [], [], 0
    while True:
        lag += 1
        left = left[left + lag < len(fps)]
        right = left + lag
        near = (key[left] == key[right]) & (table[right, 0] - table[left, 0] <= radius)
        left, right = left[near], right[near]
        if not len(left):
            break
        a, b = left, right
        for p in range(1, len(refs)):
            ok = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[ok], b[ok]
        ok = (np.bitwise_count(fps[a] ^ fps[b]) <= radius) & ((part[a] != part[b]) | (part[a] < 0))
        if ok.any():
            held_a.append(a[ok])
            held_b.append(b[ok])
            held += int(ok.sum())
            if held > 1 << 20:
                root = forest(len(fps), np.concatenate(held_a), np.concatenate(held_b), root)
                held_a, held_b, held = [], [], 0
    if held:
        root = forest(len(fps), np.concatenate(held_a), np.concatenate(held_b), root)
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def links(fps: DataFrame, bucket: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect all fingerprints (column fp, distinct) within ``radius`` bits."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"the block index holds pairs of up to {len(BLOCKS) - 2} bits")
    keys = []
    for i, (x, y) in enumerate(combinations(BLOCKS, 2)):
        bits = [F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in (x, y)]
        keys.append(F.shiftleft(F.lit(i).cast("long"), 22).bitwiseOR(F.shiftleft(bits[0], y[1])).bitwiseOR(bits[1]))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    cells = F.ceil(F.col("n") / bucket).cast("int")
    dealt = keyed.join(crowded, "key", "left")
    own = F.pmod(F.xxhash64("fp"), cells).cast("int")
    # a part meets every other part, and itself, in one cell each
    spread = dealt.select("fp", "key", F.coalesce(own, F.lit(-1)).alias("part"),
                          F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(
                              F.sequence(F.lit(0), cells - 1))).alias("other"))
    spread = spread.select("fp", "key", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, carry = pivots(), None
        for batch in (*batches, None):
            new = None if batch is None else np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi", "part", "fp")])
            rows = new if carry is None else carry if new is None else np.concatenate([carry, new], axis=1)
            if rows is None or not rows.shape[1]:
                continue
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
            end = rows.shape[1] if batch is None else int(np.flatnonzero(fresh)[-1])
            if end < rows.shape[1] and end < 50_000 and rows.shape[1] < 200_000:
                carry = rows
                continue
            carry, done = rows[:, end:], rows[:, :end]
            if end:
                part = np.where(done[1] == done[2], -1, done[3])
                u, v = bucket_links(np.cumsum(fresh[:end]), part, done[4].copy().view(np.uint64), refs, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    # sorted down to the fingerprint, so that a bucket's forest is the same at every run
    return spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").select(
        "key", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"),
        F.col("part").cast("long").alias("part"), "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable."""
    small_batches(docs.sparkSession)
    base = cut(fingerprints(docs, words))
    distinct = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct.select("fp"), bucket, radius)).withColumnRenamed("node", "fp")
    grouped = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "label").select("fp", "component_id")
    return base.join(named, "fp").select("doc_id", "fp", "component_id")
