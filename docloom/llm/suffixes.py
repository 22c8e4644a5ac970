"""Exact substring dedup by a distributed merge sort of suffixes.

A byte is removed if some string of ``SIZE`` bytes that covers it also starts in a document with a
smaller doc_id. Of all suffixes only those at anchors are sorted: each window of SIZE bytes names the
leftmost of its K-grams with the smallest hash, so equal windows name anchors at the same place.

1. Anchors whose K-gram occurs in one document alone cannot matter. Each chunk of documents sends its
   distinct anchor hashes, in sorted runs, to hash ranges, which answer with the repeated ones. Hashes
   that repeat within a chunk are answered there, so a common passage sends one entry a chunk.
2. Each chunk sorts the suffixes at its repeated anchors (SIZE bytes to the right, then the SIZE - K
   bytes to the left, reversed) and sends front-coded runs: common prefix with the entry before, and
   the rest. Among equal suffixes of a chunk only that of the smallest doc_id travels; the others are
   settled on the spot.
3. Each bucket merges its runs with a loser tree that carries common prefixes, so no known prefix is
   compared again. Common prefixes of the merged order, to the right and to the left, number the classes
   of equal windows; a window whose class holds a smaller doc_id is removed.
4. The spans go back to their documents.

Everything is one plan, in which both joins share one exchange of the texts. Null texts count as empty.
Rows with a null doc_id neither lose bytes nor make others lose any. Rows that share a doc_id are cleaned
one by one and don't make each other lose bytes. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import gram_hash, partitions_for, prefix_hash, small_batches, text_blocks

SIZE, K = 50, 20
REACH = SIZE - K
WIDTH = SIZE + REACH
CHUNK = 1 << 20
#: Text bytes for which one hash range, and one bucket of runs, is made.
RANGE_BYTES, BUCKET_BYTES = 32 << 20, 8 << 20
LOW = (1 << 40) - 1


def anchors(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, text number) of the anchors of all windows of SIZE bytes within texts."""
    none = np.zeros(0, np.int64)
    if len(body) < SIZE:
        return none, none.view(np.uint64), none
    grams = gram_hash(prefix_hash(body), K)
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    reach, width = 1, REACH + 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + SIZE <= offsets[owner + 1]
    at, owner = at[valid], owner[valid]
    if not len(at):
        return none, none.view(np.uint64), none
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    return at[fresh], grams[at[fresh]], owner[fresh]


def range_codes(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash, above its 40 low bits."""
    return ((hashes >> np.uint64(40)) % np.uint64(ranges) << np.uint64(40) | hashes & np.uint64(LOW)).astype(np.int64)


def sections(*sorted_columns: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """(value, its slice of each column) for every value that occurs; each column is sorted."""
    found = [np.unique(c, return_index=True) for c in sorted_columns]
    for value in np.unique(np.concatenate([v for v, _ in found])).tolist():
        yield value, [slice(int(np.searchsorted(c, value)), int(np.searchsorted(c, value, "right"))) for c in sorted_columns]


def anchor_runs(docs: DataFrame, ranges: int) -> DataFrame:
    """Step 1's runs: (range, low, who, docs) and, for hashes repeated in a chunk, (hit_docs, hit_codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "low", "who", "docs", "hit_docs", "hit_codes"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, end, body, offsets in text_blocks(batch.column(1), CHUNK):
                _, hashes, owner = anchors(body, offsets)
                if not len(hashes):
                    continue
                doc, codes = ids[first:end][owner], range_codes(hashes, ranges)
                order = np.lexsort((doc, codes))
                doc, codes = doc[order], codes[order]
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
                doc, codes = doc[new], codes[new]
                head = np.ones(len(codes), bool)
                head[1:] = codes[1:] != codes[:-1]
                alone = head & np.append(head[1:], True)
                hit_docs, hit_codes = doc[~alone], codes[~alone]
                doc, codes = doc[head], codes[head]
                spread = hit_docs % ranges
                by = np.argsort(spread, kind="stable")
                hit_docs, hit_codes, spread = hit_docs[by], hit_codes[by], spread[by]
                out = []
                for r, (own, hits) in sections(codes >> 40, spread):
                    table, who = np.unique(doc[own], return_inverse=True)
                    planes = (codes[own] & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T
                    out.append((r, planes.tobytes(), who.astype("<u2" if len(table) < 65536 else "<u4").tobytes(), table.tobytes(),
                                hit_docs[hits].tobytes(), hit_codes[hits].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] + [pa.binary()] * 5, strict=True)], names)

    return docs.mapInArrow(run, "range long, low binary, who binary, docs binary, hit_docs binary, hit_codes binary")


def grouped_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of sorted batches whose first column is the key."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


def repeated_anchors(runs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, code): anchors of each document that other documents have too, a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in grouped_rows(batches):
            codes, docs, hit_docs, hit_codes = [], [], [], []
            for low, who, table, extra_docs, extra_codes in rows:
                n = len(low) // 5
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(low, np.uint8).reshape(5, n).T
                codes.append(wide.view("<i8").ravel())
                docs.append(np.frombuffer(table, np.int64)[np.frombuffer(who, "<u2" if len(who) == 2 * n else "<u4")])
                hit_docs.append(np.frombuffer(extra_docs, np.int64))
                hit_codes.append(np.frombuffer(extra_codes, np.int64))
            codes, docs = np.concatenate(codes), np.concatenate(docs)
            order = np.argsort(codes, kind="stable")
            codes, docs = codes[order], docs[order]
            same = codes[1:] == codes[:-1]
            twice = np.zeros(len(codes), bool)
            twice[1:] |= same
            twice[:-1] |= same
            docs = np.concatenate([docs[twice], *hit_docs])
            codes = np.concatenate([codes[twice] | (r << 40), *hit_codes])
            order = np.lexsort((codes, docs))
            for lo in range(0, len(order), 1 << 16):
                part = order[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[part], pa.int64()), pa.array(codes[part], pa.int64())], ["doc_id", "code"])

    return runs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, "doc_id long, code long")


def contexts(body: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strings, left, right): SIZE bytes from each anchor on and REACH bytes before it, reversed; zeros
    stand beyond the text, and left and right tell how many bytes are of the text."""
    left, right = np.minimum(REACH, at - begin), np.minimum(SIZE, end - at)
    padded = np.concatenate([np.zeros(REACH, np.uint8), body, np.zeros(SIZE, np.uint8)])
    steps = np.concatenate([np.arange(SIZE), -1 - np.arange(REACH)])
    strings = padded[at[:, None] + steps[None, :] + REACH]
    strings[:, :SIZE][np.arange(SIZE)[None, :] >= right[:, None]] = 0
    strings[:, SIZE:][np.arange(REACH)[None, :] >= left[:, None]] = 0
    return strings, left, right


def byte_order(strings: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order of rows of bytes, then by the given columns."""
    n, width = strings.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = strings
    columns = words.view(">u8").astype(np.uint64)
    return np.lexsort((*then[::-1], *columns.T[::-1]))


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the row before (0 for the first)."""
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        unlike = strings[1:] != strings[:-1]
        out[1:] = np.where(unlike.any(1), unlike.argmax(1), strings.shape[1])
    return out


def front_code(strings: np.ndarray) -> tuple[bytes, bytes]:
    """(prefix lengths, rests) of sorted rows."""
    prefix = common_prefixes(strings)
    return prefix.astype(np.uint8).tobytes(), strings[np.arange(strings.shape[1])[None, :] >= prefix[:, None]].tobytes()


def front_decode(prefix: bytes, rest: bytes, width: int = WIDTH) -> list[bytes]:
    out, last, at = [], b"", 0
    for p in prefix:
        last = last[:p] + rest[at : at + width - p]
        at += width - p
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs (strings, common prefixes with the one before) with a loser tree.

    Gives the run of each entry in merged order, and its common prefix with the entry before. A node
    keeps the loser of its match with the prefix it shares with the winner; at the next match the longer
    prefix wins unseen, and only strings with equal prefixes are compared, from there on.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    width = len(runs[0][0][0]) if runs else 0
    text: list[bytes | None] = [r[0][0] if i < len(runs) and r[0] else None for i, r in enumerate(runs)] + [None] * (k - len(runs))
    shared = [0 if t is not None else -1 for t in text]
    place = [0] * k
    ends = [len(r[0]) for r in runs]
    left = sum(ends)
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        one, two = text[a][x:], text[b][x:]
        if one == two:
            shared[max(a, b)] = width
            return (a, b) if a < b else (b, a)
        differ = int.from_bytes(one) ^ int.from_bytes(two)
        same = x + len(one) - (differ.bit_length() + 7) // 8
        if one < two:
            shared[b] = same
            return a, b
        shared[a] = same
        return b, a

    winners = list(range(k))
    size = k
    while size > 1:
        size >>= 1
        above = []
        for i in range(size):
            win, lose = play(winners[2 * i], winners[2 * i + 1])
            loser[size + i] = lose
            above.append(win)
        winners = above
    best = winners[0]
    order, prefixes = [], []
    for _ in range(left):
        order.append(best)
        prefixes.append(shared[best])
        place[best] += 1
        if place[best] < ends[best]:
            text[best] = runs[best][0][place[best]]
            shared[best] = runs[best][1][place[best]]
        else:
            text[best], shared[best] = None, -1
        node = (best + k) >> 1
        while node:
            other = loser[node]
            x, y = shared[best], shared[other]
            if x < y:
                loser[node], best = best, other
            elif x == y:
                best, loser[node] = play(best, other)
            node >>= 1
    return order, prefixes


def compressed(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, text) with the texts as zstd frames, for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([pack(t.as_buffer()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "mark", "text"])

    return rows.mapInArrow(run, "doc_id long, mark long, text binary")


def text_chunks(packed: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of compressed texts of about CHUNK bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    first, held, size = 0, [], 0
    for i, text in enumerate(packed):
        held.append(unpack(text.as_buffer()))
        size += len(held[-1])
        if size >= CHUNK or i == len(packed) - 1:
            yield first, i + 1, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])])
            first, held, size = i + 1, [], 0


def suffix_runs(rows: DataFrame, ranges: int, buckets: int) -> DataFrame:
    """Step 2's runs, by bucket; ``rows`` are (doc_id, mark, text, codes) with the repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "prefix", "rest", "sides", "who", "docs", "at", "spans"]
        types = [pa.int64()] + [pa.binary()] * 7
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            listed, ends = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for first, end, body, offsets in text_chunks(batch.column(2)):
                at, hashes, owner = anchors(body, offsets)
                codes = range_codes(hashes, ranges)
                wanted = [listed[ends[i] : ends[i + 1]] for i in range(first, end)]
                cuts = np.searchsorted(owner, np.arange(end - first + 1))
                chosen = np.concatenate([np.isin(codes[cuts[i] : cuts[i + 1]], w) for i, w in enumerate(wanted)]) if len(codes) else np.zeros(0, bool)
                at, codes, owner = at[chosen], codes[chosen], owner[chosen]
                if not len(at):
                    continue
                doc, mark = ids[first:end][owner], marks[first:end][owner]
                start = offsets[owner]
                pieces = []
                for lo in range(0, len(at), 1 << 16):  # bounded matrices
                    part = slice(lo, lo + (1 << 16))
                    strings, left, right = contexts(body, at[part], start[part], offsets[owner[part] + 1])
                    keep = left + right >= SIZE
                    pieces.append((strings[keep], left[keep], right[keep], np.flatnonzero(keep) + lo))
                strings, left, right = (np.concatenate([p[i] for p in pieces]) for i in range(3))
                row = np.concatenate([p[3] for p in pieces])
                if not len(row):
                    continue
                where = at[row] - start[row]
                order = byte_order(strings, left, right, doc[row], where)
                strings, left, right, row, where = strings[order], left[order], right[order], row[order], where[order]
                doc, mark, codes = doc[row], mark[row], codes[row]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (strings[1:] != strings[:-1]).any(1) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
                least = doc[np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))]
                done = doc > least
                spread = doc[done] % buckets
                settled = np.stack([spread, doc[done], mark[done], (where - left)[done], (where + right)[done]], axis=1)
                settled = join_spans(settled)
                go = ~done
                strings, left, right, where = strings[go], left[go], right[go], where[go]
                row, bucket = owner[row[go]], codes[go] % buckets
                by = np.argsort(bucket, kind="stable")
                out = []
                for b, (own, spans) in sections(bucket[by], settled[:, 0]):
                    mine = by[own]
                    prefix, rest = front_code(strings[mine])
                    sides = np.stack([left[mine], right[mine]], axis=1).astype(np.uint8).tobytes()
                    texts, who = np.unique(row[mine], return_inverse=True)
                    docs = np.stack([ids[first:end][texts], marks[first:end][texts]], axis=1).tobytes()
                    out.append((b, prefix, pack(rest), sides, who.astype("<u4").tobytes(), docs, where[mine].astype("<u4").tobytes(),
                                np.ascontiguousarray(settled[spans, 1:]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, "bucket long, prefix binary, rest binary, sides binary, who binary, docs binary, at binary, spans binary")


def join_spans(spans: np.ndarray) -> np.ndarray:
    """Rows (…, start, end) with overlapping or touching spans of the same leading columns made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort(spans.T[::-1])]
    fresh = np.ones(len(spans), bool)
    fresh[1:] = (spans[1:, :-2] != spans[:-1, :-2]).any(1)
    group = np.cumsum(fresh)
    lift = group * (int(spans[:, -1].max()) + 2)  # so a maximum never reaches into the next group
    top = np.maximum.accumulate(spans[:, -1] + lift)
    fresh[1:] |= spans[1:, -2] + lift[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    out = spans[first].copy()
    out[:, -1] = (top - lift)[np.append(first[1:], len(spans)) - 1]
    return out


def removed_spans(strings: np.ndarray, prefixes: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, bytes before the anchor, bytes from it on) of merged entries with windows to remove."""
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (prefixes[1:] < WIDTH) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    kind = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc, heads)
    l, r, n = left[heads], right[heads], len(heads)
    # entries between two heads equal the first of them, so a head's prefix is the one it shares with the head before
    to_right = np.minimum(np.where(heads > 0, prefixes[heads], 0), SIZE)
    by_left = byte_order(strings[heads][:, SIZE:])
    to_left = common_prefixes(strings[heads][by_left][:, SIZE:])
    near, far = np.full(len(doc), 1 << 20), np.full(len(doc), -1)
    left_class = np.empty(n, np.int64)
    for o in range(REACH + 1):
        ok = (l >= o) & (r >= SIZE - o)
        if not ok.any():
            continue
        right_class = np.cumsum(to_right < SIZE - o)
        left_class[by_left] = np.cumsum(to_left < o)
        code = (left_class * (n + 1) + right_class)[ok]
        _, inverse = np.unique(code, return_inverse=True)
        best = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, inverse, least[ok])
        smallest = np.full(n, np.iinfo(np.int64).max)
        smallest[ok] = best[inverse]
        out = smallest[kind] < doc
        near[out] = np.minimum(near[out], o)
        far[out] = np.maximum(far[out], o)
    entry = np.flatnonzero(far >= 0)
    return entry, far[entry], SIZE - near[entry]


def merged_spans(runs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, mark, span): removed spans, a row for each, packed as start << 32 | end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, rows in grouped_rows(batches):
            settled = [np.frombuffer(r[6], np.int64).reshape(-1, 4) for r in rows]
            rows = [r for r in rows if r[0]]
            if rows:
                decoded = [(front_decode(r[0], unpack(r[1])), r[0]) for r in rows]
                order, prefixes = merge(decoded)
                order = np.array(order, np.int64)
                # entries of a run keep their order, so the merge is a stable sort of run numbers undone
                back = np.argsort(np.argsort(order, kind="stable"), kind="stable")
                sides = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]).reshape(-1, 2).astype(np.int64)[back]
                owners = np.concatenate([np.frombuffer(r[4], np.int64).reshape(-1, 2)[np.frombuffer(r[3], "<u4")] for r in rows])[back]
                at = np.concatenate([np.frombuffer(r[5], "<u4") for r in rows]).astype(np.int64)[back]
                doc, mark = owners[:, 0], owners[:, 1]
                strings = np.frombuffer(b"".join(s for d in decoded for s in d[0]), np.uint8).reshape(-1, WIDTH)[back]
                entry, before, after = removed_spans(strings, np.array(prefixes), sides[:, 0], sides[:, 1], doc)
                settled.append(np.stack([doc[entry], mark[entry], at[entry] - before, at[entry] + after], axis=1))
            spans = join_spans(np.concatenate(settled))
            for lo in range(0, len(spans), 1 << 16):
                part = spans[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (part[:, 0], part[:, 1], part[:, 2] << 32 | part[:, 3])],
                                                 ["doc_id", "mark", "span"])

    return runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, mark long, span long")


def find_repeats(docs: DataFrame, range_bytes: int = RANGE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents with a doc_id (doc_id, mark, text as zstd frames), spans (doc_id, spans: list of mark and packed span))."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges, buckets = int(total // range_bytes) + 1, int(total // bucket_bytes) + 1
    runs = anchor_runs(rows, ranges)
    hits = repeated_anchors(runs, partitions_for(spark, total, range_bytes))
    hits = hits.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    # the filter stands above the exchange's Python step, where the optimizer would put it for the inner join alone
    rows = compressed(rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")).filter("doc_id is not null")
    found = suffix_runs(rows.join(hits, "doc_id").select("doc_id", "mark", "text", "codes"), ranges, buckets)
    spans = merged_spans(found, partitions_for(spark, total, bucket_bytes))
    return rows, spans.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "span")).alias("spans"))


def cleaned(docs: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, kept, n_removed, n_spans) of every row of ``docs`` (doc_id, text); kept is binary."""
    rows, spans = find_repeats(docs, **sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "kept", "n_removed", "n_spans"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            listed = batch.column(3).values
            marks, spans, ends = listed.field("mark").to_numpy(), listed.field("span").to_numpy(), batch.column(3).offsets.to_numpy()
            for i, (doc, mark, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                body = unpack(text.as_buffer())
                own = spans[ends[i] : ends[i + 1]][marks[ends[i] : ends[i + 1]] == mark]
                found = join_spans(np.stack([np.zeros_like(own), own >> 32, own & 0xFFFFFFFF], axis=1))
                kept, at = [], 0
                for _, start, end in found.tolist():
                    kept.append(body[at:start])
                    at = end
                kept.append(body[at:])
                kept = b"".join(kept)
                out.append((doc, len(body), kept, len(body) - len(kept), len(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    # the same rows as in the join before, so that both read one exchange of the texts
    joined = rows.join(spans, "doc_id", "left").select("doc_id", "mark", "text", "spans")
    made = joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    others = docs.filter("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("kept"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return made.unionByName(others)


def digest(kept: DataFrame) -> DataFrame:
    """``cleaned`` with the kept bytes' SHA-256 in their place."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for ``digest`` over ``documents``, by all windows as hexadecimal digits.
ORACLE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS i FROM d)),
 f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
 r AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE m < w.doc_id),
 g AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS n
   FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
 spans AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
 pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
 kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
   string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || any_value(substr(h, 2 * e + 1)) AS k
   FROM pieces JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
