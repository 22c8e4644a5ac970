"""Packing along a space-filling curve: neighbouring documents share sequences.

Each document's hashed word vector is projected onto three signed random directions. The coordinates,
scaled to unit variance and cut into 1024 levels each, give a Hilbert key. Spark's range exchange sorts the
texts by (key, hash of doc_id); each of its partitions is one stream of tokens, encoded where it is packed
and cut into sequences. What is left at the end of a stream is cut into sequences of power-of-two lengths,
which need no padding.

Null texts count as empty, so they hold the closing id alone. Rows that share a doc_id (or have a null one)
are packed one by one; copies, whose keys tie, are spread by the hash. Very long texts are encoded stretch by
stretch and go on in as many sequences as they need. An empty table gives no piece; other columns of the input,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import mix, partitions_for, prefix_hash, range_hash, small_batches, text_blocks, word_bounds, worker_cache

LENGTH = 1024
END = 0
DIMENSIONS, LEVELS = 3, 10
#: Text bytes of a stream; beyond so many streams they grow, and their tasks sort on disk.
RANGE_BYTES, STREAMS = 16 << 20, 100_000
#: Characters encoded at a time, and where a text may be cut: the pattern of the vocabulary always ends a word
#: before a single blank between letters.
STRETCH = 1 << 16
SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Ids that a stream holds before whole sequences of them go out.
HELD = 1 << 18


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in pieces of ``size`` characters or somewhat more, whose ids together are the text's."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + size)
        end = seam.start() if seam else len(text)
        yield text[at:end]
        at = end


def tokenizer(path: str, ranks: str | None, pattern: str):
    """ids(text) -> uint16 array. Where ``ranks`` names the same vocabulary as merge ranks, Latin text
    takes the faster encoder over it; any other text takes the tokenizer file itself."""
    kept = worker_cache()
    if (path, ranks) in kept:
        return kept[path, ranks]
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    fast = None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
    beyond = re.compile("[^\x00-ɏ]")

    def part(text: str) -> np.ndarray:
        if fast is not None and not beyond.search(text):
            return np.array(fast.encode(text, allowed_special="all"), np.uint16)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint16)

    def ids(text: str) -> np.ndarray:
        if len(text) <= STRETCH:
            return part(text)
        return np.concatenate([part(x) for x in stretches(text)])

    kept[path, ranks] = ids
    return ids


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, d), by Gray-code rotation of their bits."""
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    level = one << np.uint64(bits - 1)
    while level > one:
        low = level - one
        for i in range(d):
            up = (x[i] & level) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        level >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = one << np.uint64(bits - 1)
    while level > one:
        flip ^= np.where((x[d - 1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << one) | ((x[i] >> np.uint64(bit)) & one)
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text: words hashed to signed directions, summed, scaled by the root of their number."""
    keys = np.zeros(len(texts), np.int64)
    for first, end, body, offsets in text_blocks(texts):
        starts, ends, index = word_bounds(body, offsets)
        h = range_hash(prefix_hash(body), starts, ends)
        n = np.maximum(np.diff(index), 1)
        points = np.zeros((end - first, DIMENSIONS), np.int64)
        for d in range(DIMENSIONS):
            sign = 2 * ((h >> np.uint64(7 + 11 * d)) & np.uint64(1)).astype(np.int64) - 1
            total = np.concatenate([[0], np.cumsum(sign)])
            z = (total[index[1:]] - total[index[:-1]]) / np.sqrt(n)
            points[:, d] = np.clip((z + 3) / 6 * (1 << LEVELS), 0, (1 << LEVELS) - 1)
        keys[first:end] = hilbert(points, LEVELS).astype(np.int64)
    return keys


def positions(texts: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Sort value of each row: Hilbert key, then a hash of its number, so copies spread over streams."""
    tie = mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(31)
    return (curve_keys(texts) << 33) | tie.view(np.int64)


def cut_stream(lengths: np.ndarray, size: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of the pieces of documents laid end to end.

    All sequences but those of the last ``sum % size`` ids hold ``size``; these go into sequences
    of descending powers of two.
    """
    total = int(lengths.sum())
    edges = list(range(0, total - total % size + 1, size))
    rest = total % size
    for bit in range(size.bit_length(), -1, -1):
        if rest >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    sequence, at = 0, 0
    for row, n in enumerate(lengths.tolist()):
        start = 0
        while start < n:
            while edges[sequence + 1] <= at:
                sequence += 1
            piece = min(n - start, edges[sequence + 1] - at)
            yield row, start, piece, sequence, at - edges[sequence]
            start += piece
            at += piece


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str = "", size: int = LENGTH,
         range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), with their ids as little-endian unsigned 32-bit bytes.

    ``path`` names the tokenizer's file on every executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            # rows without a doc_id are told apart by their place in the input, which a repeated task finds again
            own = -1 - np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = np.where(known, batch.column(0).fill_null(0).to_numpy(), own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(positions(batch.column(1), ids))], ["doc_id", "text", "at"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        ids_of = tokenizer(path, ranks, pattern)
        close = np.array([END], np.uint16)
        stream = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []  # doc_id, ids, how many of them are out
        tokens, sequence = 0, 0

        def flush(final: bool) -> pa.RecordBatch:
            """Whole sequences of what is kept; at the end of the stream, all of it."""
            nonlocal kept, tokens, sequence
            take = tokens if final else tokens - tokens % size
            out, clipped, below, top = [[] for _ in names], [], take, 0
            for _, body, skip in kept:
                clipped.append(min(len(body) - skip, below))
                below -= clipped[-1]
            for row, start, n, k, offset in cut_stream(np.array(clipped, np.int64), size):
                doc, body, skip = kept[row]
                values = (doc, skip + start, n, body[skip + start : skip + start + n].astype("<u4").tobytes(), len(body),
                          stream + sequence + k, offset)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                top = k + 1
            sequence += top
            kept = [(d, b, s + c) for (d, b, s), c in zip(kept, clipped, strict=True) if s + c < len(b)]
            tokens -= take
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = np.concatenate([ids_of(text.as_py()), close])
                kept.append((doc, body, 0))
                tokens += len(body)
                if tokens >= HELD:
                    yield flush(False)
        if kept:
            yield flush(True)

    streams = min(STREAMS, partitions_for(spark, total, range_bytes))
    placed = rows.mapInArrow(place, "doc_id long, text string, at long")
    sorted_rows = placed.repartitionByRange(streams, "at").sortWithinPartitions("at", "doc_id")
    return sorted_rows.select("doc_id", "text").mapInArrow(
        emit, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(packed: DataFrame) -> DataFrame:
    """``pack``'s rows with the CRC-32 of the ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
