"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits, lower-cased. For each benchmark item of L words every window of
L words of a document (the whole document, if shorter) is a candidate. Windows that hold too few of
the shingles of items of that length to reach the similarity are dropped first, which loses none. The others get a
SimHash of their shingles; fingerprints within ``RADIUS`` bits of an item's agree with it on one of four
16-bit blocks up to a quarter of that, so probing each block's index with all values that near
finds all of them. Survivors are verified by weighted similarity: the sum of minima over the sum of
maxima of the shingles' counts. At similarity 0.8 a fingerprint differs in 9.7 bits on average (standard
deviation 2.9), so the radius holds 99.9 % of pairs just at the threshold and all but none above.

The benchmark is taken in blocks of bounded size, each searched against all documents. Null and empty
texts hold no passage and items without words match nothing; an item with a null item_id is searched for like
any other and reported with a null. Very long texts are read whole. Of equal windows of an item the first counts; repeated
rows are reported alike; empty tables give no row; other columns, whatever their names, are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import gram_hash, mix, powers, prefix_hash, range_hash, small_batches

WORDS, SIMILARITY, RADIUS = 5, 0.8, 19
#: Benchmark bytes searched at a time.
BLOCK_BYTES = 8 << 20
FOUND = "doc_id long, item_id long, similarity double, hamming int, start_word long, n_words long"

INSIDE = np.zeros(256, bool)
INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased words of all texts: prefix sums to hash by, byte starts, byte ends, and the
    index of each text's first word (and the end)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    body = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    edge = np.diff(np.concatenate([[0], INSIDE[body].view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return prefix_hash(body), starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the index of each text's first (and the end)."""
    prefix, starts, ends, index = words_of(texts)
    return range_hash(prefix, starts, ends), index


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, repeats included."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0])


def similarity(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima of counts."""
    least = sum((a & b).values())
    return least / max(1, sum(a.values()) + sum(b.values()) - least)


class Hamming:
    """Multi-index of 64-bit fingerprints: all within a radius, by four 16-bit blocks."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS) -> None:
        self.fps, self.radius = fps, radius
        near = [0]
        for n in range(1, radius // 4 + 1):
            near += [sum(1 << b for b in bits) for bits in combinations(range(16), n)]
        self.near = np.array(near, np.uint16)
        self.blocks = []
        for b in range(4):
            value = ((fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.blocks.append((order, np.searchsorted(value[order], np.arange(65537))))

    def within(self, fp: int) -> list[tuple[int, int]]:
        """(index, distance) of every fingerprint within the radius."""
        found = []
        for b, (order, at) in enumerate(self.blocks):
            probe = self.near ^ np.uint16(fp >> 16 * b & 0xFFFF)
            first, last = at[probe], at[probe.astype(np.int64) + 1]
            for i in np.flatnonzero(last > first):
                found.append(order[first[i] : last[i]])
        if not found:
            return []
        rows = np.unique(np.concatenate(found))
        far = np.bitwise_count(self.fps[rows] ^ np.uint64(fp))
        return [(int(r), int(d)) for r, d in zip(rows, far, strict=True) if d <= self.radius]


class Benchmark:
    """A block of items with the index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, radius: int = RADIUS) -> None:
        hashes, index = word_hashes([t for _, t in items])
        self.words = words
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.counts: list[Counter] = []
        fps, grams = [], []
        for i, (item, _) in enumerate(items):
            own = hashes[index[i] : index[i + 1]]
            if len(own):
                shingles = shingle_hashes(own, words)
                grams.append(shingles)
                self.ids.append(item)
                self.lengths.append(len(own))
                self.counts.append(Counter(shingles.tolist()))
                fps.append(simhash(shingles))
        self.index = Hamming(np.array(fps, np.uint64), radius)
        self.short = [i for i, n in enumerate(self.lengths) if n < words]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        of = np.repeat(np.array(self.lengths, np.int64), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        self.grams = np.unique(flat)
        #: Lengths of the items that have each shingle: those of number i lie from lengths_at[i] on.
        pairs = np.unique(np.stack([np.searchsorted(self.grams, flat), of]), axis=1)
        self.gram_lengths, self.lengths_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.grams) + 1))
        size = 1 << max(16, int(4 * len(self.grams)).bit_length())
        self.mask = np.uint64(size - 1)
        self.seen = np.zeros(size, bool)
        self.seen[self.grams & self.mask] = True

    def known(self, shingles: np.ndarray) -> np.ndarray:
        out = self.seen[shingles & self.mask]
        rows = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.grams, shingles[rows]), len(self.grams) - 1)
        out[rows] = self.grams[at] == shingles[rows]
        return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of fewer words, the whole."""
    prefix = prefix_hash(words)
    return gram_hash(prefix, n) if len(words) >= n else mix((prefix[-1:] - prefix[:1]) * powers(1)[0])


def search(hashes: np.ndarray, hits: np.ndarray, grams: np.ndarray, bench: Benchmark, least: float
           ) -> Iterator[tuple[int, float, int, int, int]]:
    """(item_id, similarity, distance, start, words) of the best window of each item in one document, the first
    of equally good ones.

    ``grams`` are the document's shingles and ``hits`` which of them the benchmark has.
    """
    best: dict[int, tuple] = {}
    for i in bench.short:  # an item shorter than a shingle matches as a whole
        length = bench.lengths[i]
        own = gram_hash(prefix_hash(hashes), length) if len(hashes) >= length else np.zeros(0, np.uint64)
        at = np.flatnonzero(own == np.uint64(next(iter(bench.counts[i]))))
        if len(at):
            best[bench.ids[i]] = (1.0, -int(at[0]), 0, length)
    at = np.flatnonzero(hits)
    gram = np.searchsorted(bench.grams, grams[at])
    first, n = bench.lengths_at[gram], np.diff(bench.lengths_at)[gram]
    place = np.repeat(at, n)
    of = bench.gram_lengths[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(place))] if len(at) else at
    for length in np.unique(of).tolist():
        m = length - bench.words + 1
        span = min(m, len(grams))
        need = int(np.ceil(least * m - 1e-9))
        mine = place[of == length]
        if length < bench.words or span < need or len(mine) < need:
            continue
        marks = np.zeros(len(grams) + 1, np.int64)
        marks[mine + 1] = 1
        total = np.cumsum(marks)
        for s in np.flatnonzero(total[span:] - total[:-span] >= need).tolist():
            part = grams[s : s + span]
            near = [x for x in bench.index.within(simhash(part)) if bench.lengths[x[0]] == length]
            if not near:
                continue
            own = Counter(part.tolist())
            for i, distance in near:
                alike = similarity(own, bench.counts[i])
                if alike >= least:
                    got = (alike, -s, -distance, min(length, len(hashes)))
                    best[bench.ids[i]] = max(best.get(bench.ids[i], got), got)
    for item, (alike, start, distance, n) in best.items():
        yield item, alike, -distance, -start, n


def _found(texts: pa.Array, bench: Benchmark, least: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item_id, similarity, distance, start, words) over all texts of a batch."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 21, "right")) + first)
        hashes, index = word_hashes(texts.slice(first, end - first).fill_null("").to_pylist())
        grams = gram_hash(prefix_hash(hashes), bench.words)  # those across two texts are cut off below
        hits = bench.known(grams) if len(bench.grams) else np.zeros(len(grams), bool)
        before = np.concatenate([[0], np.cumsum(hits)])
        for i in range(end - first):
            a, b = int(index[i]), int(index[i + 1])
            z = max(a, b - bench.words + 1)
            if bench.short or (z > a and before[z] > before[a]):
                for found in search(hashes[a:b], hits[a:z], grams[a:z], bench, least):
                    yield first + i, *found
        first = end


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int | None], list[tuple[int, str]]]]:
    """(item ids, a null one last; items as index of the id and text), by blocks of about ``block_bytes``."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    held = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = int(held // block_bytes) + 1
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = [(r.item_id, r.text) for r in part.collect()]
        ids = sorted({k for k, _ in found}, key=lambda k: (k is None, k or 0))
        index = {k: i for i, k in enumerate(ids)}
        yield ids, sorted((index[k], text) for k, text in found)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = SIMILARITY,
                 radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start_word, n_words): the best window of every item in every
    document of ``docs`` (doc_id, text) that holds one at weighted similarity ``least`` or more."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def search_all(known: list[int | None], items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value, words, radius)
            names = ["doc_id", "item_id", "similarity", "hamming", "start_word", "n_words"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[row], known[item], *found) for row, item, *found in _found(batch.column(1), bench, least)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

        return rows.mapInArrow(run, FOUND)

    return reduce(DataFrame.unionByName, [search_all(*block) for block in _blocks(benchmark, block_bytes)])


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = SIMILARITY,
          radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage, in the same pass that finds them."""
    small_batches(docs.sparkSession)
    for _, items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(shared.value, words, radius)
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for row, *_ in _found(batch.column(batch.schema.names.index("text")), bench, least):
                    bad[row] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: DuckDB SQL for the best windows of ``benchmark`` items of five words or more in ``documents``, by trying all.
ORACLE_SQL = r"""WITH words AS (SELECT DISTINCT item_id AS k, text, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
 items AS (SELECT k, len(w) AS l, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM words WHERE len(w) >= 5),
 ig AS (SELECT k, l, m, g, count(*) AS c FROM (SELECT k, l, m, unnest(g) AS g FROM items) GROUP BY ALL),
 docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
 dg AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM docs WHERE len(w) >= 5)),
 hits AS (SELECT doc_id, n, p, k, l, m, c, g FROM dg JOIN ig USING (g)),
 wins AS (SELECT *, unnest(range(greatest(0, p - m + 1), least(p, greatest(n - 4 - m, 0)) + 1)) AS s FROM hits),
 sums AS (SELECT doc_id, k, n, l, m, s, sum(x) AS x FROM (SELECT doc_id, k, n, l, m, s, g, least(count(*), c) AS x FROM wins
   GROUP BY doc_id, k, n, l, m, s, g, c) GROUP BY ALL),
 found AS (SELECT *, x / (least(m, n - 4) + m - x) AS similarity FROM sums)
SELECT doc_id, k AS item_id, similarity, s AS start_word, least(l, n) AS n_words FROM found WHERE similarity >= 0.8
 QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY similarity DESC, s) = 1"""
