"""Near-duplicate documents by SimHash and an exact join of shingle sets, for filtering a corpus.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. All
such pairs are found: with the shingles of each set in one order, the rarest first, two sets that similar
share one of the first n - ceil(0.8 n) + 1 of their n (the prefix), so documents meet in the postings of
their prefixes' shingles. What most documents of a template or with a common line share stands last in that
order and makes no posting. The order of a shingle is its count in a sample of the documents; it decides the
work only, any order gives the same links.

1. Documents with the same words are one class from the start; one row of each goes on, with its SimHash, its
   prefix and a parity bitmap: bit b tells whether the shingles with hash b are odd in number. The bits in which two
   bitmaps differ cannot outnumber the shingles that one set alone has, so most pairs that are not similar
   are dropped by a bitmap of a 32nd of the set's size, and none that is.
2. SimHash's pivot tables give pairs within a few bits, and each row of a posting is paired with the one before and
   with the first. Of the pairs that pass the bitmaps, the nearest of each document are verified on the whole sets.
3. Then pairs whose documents are not yet in one group are verified: those left from step 2, those of rows that an order
   drawn at random brings near in a posting, and at last all pairs of a posting of three rows or more whose sizes and
   places allow the similarity. So a large group of near copies is one before its pairs are looked at, and no pair is left out.

Null texts count as empty; documents without words are one group. Very long texts are one row like any other,
with a longer prefix and bitmap. Rows with a null doc_id are in no group. Repeated rows are copies; an empty
table has no group. Other columns, whatever their names, are ignored, and kept by ``keep_first``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import (
    cut, freed, gram_hash, id_filter, mix, partitions_for, perhaps_in, prefix_hash, range_hash, release, small_batches, text_blocks,
    word_bounds,
)
from docloom.llm.components import components
from docloom.llm.simhash import links
from docloom.llm.suffixes import LOW, grouped_rows, range_codes

WORDS, SIMILARITY = 5, 0.8
#: One document in so many is counted for the order of shingles; of that many shingles at most the count is kept.
SAMPLE, KNOWN = 16, 200_000
#: Rows of a posting that are compared in one task; larger postings are dealt out as pairs of parts.
CROWD = 20_000
#: Before all pairs of a posting are looked at, each row meets those so far from it in an order drawn for the posting.
LAGS = tuple(range(1, 33))
#: Text bytes for which one range of postings is made.
RANGE_BYTES = 32 << 20
POSTING = "kind int, key long, whole long, size int, place int, other long"


def shingles(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, shingle hashes, index of each text's first, hash of each text's words) by blocks.

    Words are runs without ASCII white space with A-Z lower-cased; a text of fewer words than a
    shingle is one shingle, an empty one has none.
    """
    for first, end, body, offsets in text_blocks(texts):
        body = body + np.where((body >= 65) & (body <= 90), np.uint8(32), np.uint8(0))
        starts, ends, index = word_bounds(body, offsets)
        prefix = prefix_hash(range_hash(prefix_hash(body), starts, ends))
        whole = range_hash(prefix, index[:-1], index[1:]) ^ np.diff(index).astype(np.uint64)
        n = np.diff(index)
        count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(count)])
        where = np.arange(at[-1]) - np.repeat(at[:-1] - index[:-1], count)
        grams = gram_hash(prefix, words)
        made = grams[np.minimum(where, max(0, len(grams) - 1))] if len(grams) else np.zeros(at[-1], np.uint64)
        short = np.flatnonzero((n > 0) & (n < words))
        made[at[short]] = whole[short]
        yield first, end, made, at, whole


def counted(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, known: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many; the commonest ``known`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(grams[at[i] : at[i + 1]]) for first, end, grams, at, _ in shingles(batch.column(1), words)
                   for i in range(end - first)]
            if own:
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("doc_id", "text")
    found = picked.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    got = freed(found.orderBy(F.desc("n"), "key").limit(known)).toArrow()
    keys, counts = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def parity(own: np.ndarray) -> bytes:
    """The parity bitmap of a set of hashes: a power of two of bits, as many as the set has members or more."""
    bits = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def profiles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, whole, fp, size, bits, prefix) of every row: hash of all words, SimHash of its distinct shingles, their
    number, parity bitmap and prefix (8 bytes a shingle, the rarest first)."""
    keys, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, fps, sizes, maps, prefixes = [], [], [], [], []
            for first, end, grams, at, whole in shingles(batch.column(1), words):
                wholes.append(whole)
                for i in range(end - first):
                    own = np.unique(grams[at[i] : at[i + 1]])
                    sizes.append(len(own))
                    if not len(own):
                        fps.append(0)
                        maps.append(b"")
                        prefixes.append(b"")
                        continue
                    ones = np.zeros(64, np.int64)
                    for lo in range(0, len(own), 1 << 14):
                        ones += np.unpackbits(own[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                    fps.append(int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0]))
                    maps.append(parity(own))
                    where = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                    count = np.where(keys[where] == own, counts[where], 0) if len(keys) else np.zeros(len(own), np.int64)
                    n = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                    prefixes.append(own[np.argsort(count, kind="stable")[:n]].tobytes())
            if wholes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(wholes).view(np.int64)), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()),
                     pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "whole", "fp", "size", "bits", "prefix"])

    return docs.mapInArrow(run, "doc_id long, whole long, fp long, size int, bits binary, prefix binary")


def postings(reps: DataFrame, common: tuple[np.ndarray, np.ndarray], ranges: int, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """(range, low, who, place, docs): the prefixes of ``reps`` (whole, size, prefix) by range of hashes, a batch at a time.

    A posting that the sample shows to be crowded is dealt out: each part meets every other and itself in one
    cell, which has a hash of its own.
    """
    keys, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "low", "who", "place", "docs"]
        for batch in batches:
            body = batch.column(2)
            n = np.array([len(x.as_buffer()) // 8 for x in body], np.int64)
            if not n.sum():
                continue
            grams = np.frombuffer(b"".join(x.as_buffer() for x in body), np.uint64)
            who = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
            where = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
            count = np.where(keys[where] == grams, counts[where], 0) if len(keys) else np.zeros(len(grams), np.int64)
            cells = 1 + count * sample // crowd
            row = np.repeat(np.arange(len(grams)), cells)
            other = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
            whole = batch.column(0).to_numpy()
            part = (whole[who[row]] >> 7) % cells[row]
            with np.errstate(over="ignore"):
                cell = (np.minimum(part, other) * cells[row] + np.maximum(part, other)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                codes = range_codes(grams[row] + cell, ranges)
            order = np.argsort(codes, kind="stable")
            codes, who, place = codes[order], who[row][order], place[row][order]
            table = np.stack([whole, batch.column(1).to_numpy().astype(np.int64)], axis=1)
            found, start = np.unique(codes >> 40, return_index=True)
            out = []
            for r, a, b in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(codes)], strict=True):
                own, index = np.unique(who[a:b], return_inverse=True)
                planes = (codes[a:b] & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T
                out.append((r, planes.tobytes(), index.astype("<u2").tobytes(), place[a:b].astype("<u4").tobytes(), table[own].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] + [pa.binary()] * 4, strict=True)], names)

    return reps.select("whole", "size", "prefix").mapInArrow(run, "range long, low binary, who binary, place binary, docs binary")


def allowed(size: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a cell could be similar enough, if this shingle is the first that both have."""
    most = np.minimum(size[left] - place[left], size[right] - place[right])
    return most >= least / (1 + least) * (size[left] + size[right]) - 1e-6


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct pairs (2, n), the smaller first."""
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)


def meetings(posts: DataFrame, parts: int, least: float = SIMILARITY) -> DataFrame:
    """Kind 0: pairs (whole, other), each row of a cell with the one before and with the first, if similar enough by size
    and place. Kind 1: the rows (key, whole, size, place) of cells of three or more, which have further pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in grouped_rows(batches):
            codes, facts = [], []
            for low, who, place, table in rows:
                n = len(place) // 4
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(low, np.uint8).reshape(5, n).T
                codes.append(wide.view("<i8").ravel())
                own = np.frombuffer(table, np.int64).reshape(-1, 2)[np.frombuffer(who, "<u2")]
                facts.append(np.column_stack([own, np.frombuffer(place, "<u4").astype(np.int64)]))
            codes, facts = np.concatenate(codes), np.concatenate(facts)
            order = np.argsort(codes, kind="stable")
            same = codes[order][1:] == codes[order][:-1]
            shared = np.append(same, False) | np.append(False, same)
            order = order[shared]  # the rest stands alone
            codes, facts = codes[order], facts[order]
            order = np.lexsort((facts[:, 0], facts[:, 1], codes))
            codes, (whole, size, place) = codes[order], facts[order].T
            if not len(codes):
                continue
            fresh = np.append(True, codes[1:] != codes[:-1])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
            later = np.flatnonzero(~fresh)
            left, right = np.concatenate([later - 1, lead[later]]), np.concatenate([later, later])
            ok = allowed(size, place, left, right, least)
            pairs = distinct_pairs(whole[left[ok]], whole[right[ok]])
            n = pairs.shape[1]
            yield posting_rows(np.zeros(n, int), np.zeros(n, int), pairs[0], np.zeros(n, int), np.zeros(n, int), pairs[1])
            heads = np.flatnonzero(fresh)
            many = np.repeat(np.diff(np.append(heads, len(codes))) > 2, np.diff(np.append(heads, len(codes))))
            # further pairs need another row of an allowed size
            near = np.zeros(len(codes), bool)
            near[1:] = ~fresh[1:] & (size[:-1] >= least * size[1:] - 1e-9)
            near[:-1] |= near[1:]
            go = np.flatnonzero(many & near)
            for lo in range(0, len(go), 1 << 16):
                k = go[lo : lo + (1 << 16)]
                yield posting_rows(np.ones(len(k), int), codes[k] | (r << 40), whole[k], size[k], place[k], np.zeros(len(k), int))

    return posts.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, POSTING)


def posting_rows(*columns: np.ndarray) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)],
                                      ["kind", "key", "whole", "size", "place", "other"])


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[np.ndarray]:
    """Rows of batches sorted by their first column, as arrays (a line for each column) that end where a cell ends."""
    held, count = [], 0
    for batch in (*batches, None):
        if batch is not None:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            count += batch.num_rows
            if count < rows:
                continue
        if not count:
            return
        table = np.concatenate(held, axis=1)
        end = table.shape[1]
        if batch is not None:
            fresh = np.flatnonzero(table[0, 1:] != table[0, :-1])
            end = int(fresh[-1]) + 1 if len(fresh) else 0
        held, count = [table[:, end:]], table.shape[1] - end
        if end:
            yield table[:, :end]


def cell_pairs(live: DataFrame, least: float = SIMILARITY, lags: tuple[int, ...] = (),
               draw: int = 0) -> DataFrame:
    """(a, b): all pairs of a cell of ``live`` (key, size, whole, place, label) with different labels whose sizes and
    places allow the similarity. A pair that is similar enough passes at the first shingle that both have, so none is lost.

    With ``lags`` each row is paired only with those so far from it in an order drawn for the cell by the number ``draw``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list) -> pa.RecordBatch:
            pairs = distinct_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for table in whole_cells(batches):
            if lags:
                table = table[:, np.lexsort((mix((table[2] ^ table[0] ^ draw).view(np.uint64)), table[0]))]
            key, size, whole, place, label = table
            left, held, count = np.arange(len(key)), [], 0
            for lag in lags or itertools.count(1):
                left = left[left + lag < len(key)]
                left = left[key[left] == key[left + lag]]
                if not lags:  # rows of a cell are sorted by size
                    left = left[size[left] >= least * size[left + lag] - 1e-9]
                if not len(left):
                    break
                right = left + lag
                ok = (label[left] != label[right]) & allowed(size, place, left, right, least)
                if ok.any():
                    held.append((whole[left[ok]], whole[right[ok]]))
                    count += int(ok.sum())
                if count > 1 << 19:
                    yield batch_of(held)
                    held, count = [], 0
            if held:
                yield batch_of(held)

    dealt = live.select("key", "size", "whole", "place", "label").repartition("key").sortWithinPartitions("key", "size", "whole")
    return dealt.mapInArrow(run, "a long, b long")


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ; the longer is folded to the length of the shorter."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def near_pairs(pairs: DataFrame, reps: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, apart): those of ``pairs`` (a, b) whose parity bitmaps allow the similarity; repeated pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], np.int64)
            most = (batch.column(4).to_numpy() + batch.column(5).to_numpy()) * (1 - least) / (1 + least)
            kept = pa.array(np.flatnonzero(apart <= most + 1e-6))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(apart).take(kept)], ["a", "b", "apart"])

    one, two = (reps.filter("size > 0").select(F.col("whole").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("size").alias(f"size_{c}"))
                for c in ("a", "b"))
    joined = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    sized = joined.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9)
    return sized.select("a", "b", "bits_a", "bits_b", "size_a", "size_b").mapInArrow(run, "a long, b long, apart long")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(whole, set) of every row: its distinct shingle hashes, sorted, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, grams, at, whole in shingles(batch.column(1), words):
                small = (grams >> np.uint64(32)).astype("<u4")
                made = [np.unique(small[at[i] : at[i + 1]]).tobytes() for i in range(end - first)]
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(made, pa.binary())], ["whole", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "whole long, set binary")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(u, v): those of ``pairs`` (a, b) whose whole sets reach ``least``. Only documents of a pair have their sets made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike[i] = both / max(1, len(x) + len(y) - both)
            near = pa.array(np.flatnonzero(alike >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near)], ["u", "v"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
    chosen = cut(reps.join(nodes, "whole", "left_semi").select("doc_id"))
    few = perhaps_in(docs.select("doc_id", "text"), id_filter(chosen), "__asked").filter("__asked").select("doc_id", "text")
    few = few.join(chosen, "doc_id", "left_semi")
    sets = cut(shingle_sets(few, words).groupBy("whole").agg(F.first("set").alias("set")))
    one, two = (sets.select(F.col("whole").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "u long, v long")


def labelled(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of different groups."""
    one, two = (label.select(F.col("whole").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def grown(drawn: DataFrame | None, more: DataFrame) -> DataFrame:
    """(whole, label) of the groups ``drawn``, joined by the links ``more`` (u, v)."""
    known = more if drawn is None else drawn.select(F.col("whole").alias("u"), F.col("label").alias("v")).unionByName(more)
    found = cut(components(known).select(F.col("node").alias("whole"), "label"))
    release(found.sparkSession)
    return found


def groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; component_id is the smallest doc_id of its group."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.filter("doc_id is not null")
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    common = counted(docs, words, sample)
    base = cut(profiles(docs, common, words, least))
    reps = cut(base.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fp", "size", "bits", "prefix"))))
    posts = postings(reps, common, int(total // RANGE_BYTES) + 1, sample, crowd)
    met = cut(meetings(posts, partitions_for(spark, total, RANGE_BYTES), least))
    by_fp = reps.groupBy("fp").agg(F.min("whole").alias("whole"))
    close = links(by_fp.select("fp")).join(by_fp.select(F.col("fp").alias("u"), F.col("whole").alias("x")), "u").join(
        by_fp.select(F.col("fp").alias("v"), F.col("whole").alias("y")), "v")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = cut(near_pairs(met.filter("kind = 0").select(F.col("whole").alias("a"), F.col("other").alias("b")).unionByName(close), reps, least))
    # the nearest partner of each document first
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.struct("apart", "a", "b").alias("p")),
                                         F.struct(F.col("b").alias("x"), F.struct("apart", "a", "b").alias("p")))).alias("e"))
    nearest = cut(ends.groupBy("e.x").agg(F.min("e.p").alias("p")).select("p.a", "p.b").distinct())
    drawn = grown(None, verified(nearest, reps, docs, words, least))
    # the others of them join what is drawn, so that a large group is one before all pairs are looked at
    rest = cut(labelled(near.select("a", "b"), drawn).join(nearest, ["a", "b"], "left_anti"))
    drawn = grown(drawn, verified(rest, reps, docs, words, least))
    live = met.filter("kind = 1").select("key", "size", "whole", "place")

    def named_live() -> DataFrame:
        return live.join(drawn, "whole", "left").withColumn("label", F.coalesce("label", "whole"))

    done = nearest.unionByName(rest)
    for draw, lags in enumerate((LAGS, LAGS, ())):
        pairs = near_pairs(cell_pairs(named_live(), least, lags, draw), reps, least).select("a", "b")
        pairs = cut(pairs.join(done, ["a", "b"], "left_anti"))
        drawn = grown(drawn, verified(pairs, reps, docs, words, least))
        done = done.unionByName(pairs)
    names = reps.select("whole", "doc_id").join(drawn, "whole", "left").withColumn("label", F.coalesce("label", "whole"))
    first = names.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = names.join(first, "label").filter("doc_id != component_id").select("whole", "doc_id", "component_id")
    # a class of copies is named by its first document, unless its group has a smaller one
    named = reps.select("whole", F.col("doc_id").alias("least")).join(found.select("whole", "component_id"), "whole", "left")
    return base.select("doc_id", "whole").join(named, "whole").select("doc_id", F.coalesce("component_id", "least").alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Rows with a null doc_id stay. Of rows that share a kept doc_id one stays. Only rows that may have to go are exchanged.
    """
    kept, flag = docs.columns, "__dropped"
    found = groups(docs, words, least)
    ids = found.groupBy("doc_id").agg(F.max("component_id").alias("component_id"), F.count("*").alias("n"))
    special = cut(ids.filter("component_id < doc_id or n > 1"))
    marked = perhaps_in(docs, id_filter(special), flag)
    going = special.filter("component_id < doc_id").select("doc_id")
    asked = marked.filter(F.col(flag) & F.col("doc_id").isNotNull()).select(*kept).join(going, "doc_id", "left_anti")
    sure = marked.filter(~F.col(flag) | F.col("doc_id").isNull()).select(*kept)
    return sure.unionByName(asked.select(*kept).dropDuplicates(["doc_id"]))
