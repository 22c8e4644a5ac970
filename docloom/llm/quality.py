"""Quality classification by co-training of a text-content view and a page-metadata view.

The content view reads binned statistics of the whole text (shares of letters, signs, digits, repeats …)
and the presence of words that the labelled sample ties to a label; the metadata view reads source,
language and length as given in the columns. Both start from labelled rows. In each round every view
labels the unlabelled rows it is surest of, as far as it was right on a held-out part at that
confidence, and these are added to the other view's training rows. At the end each view is calibrated
on the held-out part and a logistic fit of both log-odds scores all documents.

Quality and toxicity are two targets of the same procedure. Training takes about ``LABELLED`` labelled
and ``UNLABELLED`` other rows, chosen by a hash of doc_id. Null texts count as empty; null or unknown
sources and languages are values of their own; repeated documents score alike; of several labels
of one document the least is taken; with fewer than 50 labelled rows every probability is 0.5 and all rows are kept; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import range_hash, small_batches, text_blocks
from docloom.llm.decontaminate import words_of

LABELLED, UNLABELLED, HELD = 8000, 4000, 0.3
ROUNDS, PER_ROUND, SURE = 3, 600, 0.95
TOPWORDS, BINS = 256, 8
#: Bytes of the word beginnings that count as words of their own.
HEADS = (4, 5, 6)
KINDS = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [32, 9],
    "line": [10],
    "stop": [*b".,;:?"],
    "sign": [*b"!#$%&*+/<=>@[]^_{|}~\\"],
}
META = 96


def statistics(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Statistics (a row for each text) and the distinct hashes of each text's words and word beginnings."""
    tables = np.zeros((len(KINDS), 256), bool)
    for table, codes in zip(tables, KINDS.values(), strict=True):
        table[codes] = True
    out, words = np.zeros((len(texts), len(KINDS) + 5)), []
    for first, end, body, offsets in text_blocks(texts):
        n = np.maximum(np.diff(offsets), 1)
        for k, table in enumerate(tables):
            total = np.concatenate([[0], np.cumsum(table[body])])
            out[first:end, k] = (total[offsets[1:]] - total[offsets[:-1]]) / n
        prefix, starts, ends, index = words_of(texts.slice(first, end - first).fill_null("").to_pylist())
        hashes = range_hash(prefix, starts, ends)
        owner = np.repeat(np.arange(end - first), np.diff(index))
        many = np.maximum(np.diff(index), 1)
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        runs = np.diff(np.concatenate([np.flatnonzero(fresh), [len(h)]]))
        most = np.zeros(end - first)
        np.maximum.at(most, o[fresh], runs)
        k = len(KINDS)
        out[first:end, k] = np.log1p(np.diff(index))
        out[first:end, k + 1] = np.diff(offsets) / many
        out[first:end, k + 2] = np.bincount(o[fresh], minlength=end - first) / many
        out[first:end, k + 3] = np.bincount(owner[again], minlength=end - first) / many
        out[first:end, k + 4] = most / many
        marks, whose = [h[fresh]], [o[fresh]]
        for size in HEADS:
            rows = np.flatnonzero(ends - starts > size)
            marks.append(range_hash(prefix, starts[rows], starts[rows] + size) + np.uint64(size << 32))
            whose.append(owner[rows])
        marks, whose = (np.concatenate(marks) >> np.uint64(32)).astype(np.uint32), np.concatenate(whose)
        order = np.lexsort((marks, whose))
        marks, whose = marks[order], whose[order]
        fresh = np.ones(len(marks), bool)
        fresh[1:] = (marks[1:] != marks[:-1]) | (whose[1:] != whose[:-1])
        words += np.split(marks[fresh], np.searchsorted(whose[fresh], np.arange(1, end - first)))
    return out, words


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """One-hot columns of language, source and length."""
    out = np.zeros((len(lang), META), np.float32)
    for i, (one, two, n) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, xxhash.xxh32_intdigest(f"l{one}") % 16] = 1
        out[i, 16 + xxhash.xxh32_intdigest(f"s{two}") % 64] = 1
        out[i, 80 + min(15, int(np.log2(max(n or 0, 0) + 1)))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 5e-4, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic fit, by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 1e-9
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, (1 - 2 * y) * (x @ v)).mean() + (ridge * v * v).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(h, g), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w, gain, now = w - size * step, now - after, after
        if gain < 1e-8:
            break
    return w


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -15, 15)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Content:
    """The content view's columns: bins of statistics, and words tied to a label."""

    def __init__(self, stats: np.ndarray, words: list[np.ndarray], labels: list[np.ndarray]) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in stats.T]
        all_words = np.concatenate(words) if words else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        unique, code, df = np.unique(all_words, return_inverse=True, return_counts=True)
        chosen = []
        for y in labels:
            hit = np.bincount(code, weights=y[owner], minlength=len(unique))
            rate = y.mean()
            score = (hit - df * rate) ** 2 / np.maximum(df * rate * (1 - rate), 1e-9)
            score[df < 5] = 0
            best = np.argsort(-score, kind="stable")[:TOPWORDS]
            chosen.append(unique[best[score[best] > 25]])
        self.words = np.unique(np.concatenate(chosen)) if chosen else unique[:0]

    def columns(self, stats: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        made = []
        for column, edges in zip(stats.T, self.edges, strict=True):
            made.append(np.eye(len(edges) + 1, dtype=np.float32)[np.searchsorted(edges, column, "right")])
        known = np.zeros((len(words), len(self.words)), np.float32)
        if len(self.words) and len(words):
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            flat = np.concatenate(words)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = self.words[at] == flat
            known[owner[hit], at[hit]] = 1
        return np.concatenate([*made, known], axis=1)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, pool: tuple[np.ndarray, np.ndarray]
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content weights, metadata weights, stacking weights) for one target.

    ``views`` are the labelled rows' columns in both views, ``pool`` those of the unlabelled rows.
    """
    rows = [(v[~held], y[~held].astype(np.float32)) for v in views]
    free = [np.ones(len(pool[0]), bool) for _ in views]
    weights = [logistic(*r) for r in rows]
    for _ in range(ROUNDS):
        given = []
        for k in (0, 1):
            p = chance(odds(weights[k], pool[k]))
            test = chance(odds(weights[k], views[k][held]))
            other = 1 - k
            for label, sure, right in ((1, p, test), (0, 1 - p, 1 - test)):
                passed = right >= SURE
                if passed.sum() < 20 or (y[held][passed] == label).mean() < SURE:
                    continue  # this view is not to be trusted with this label
                pick = np.flatnonzero(free[other] & (sure >= SURE))
                pick = pick[np.argsort(-sure[pick], kind="stable")][:PER_ROUND]
                given.append((other, pick, label))
        for other, pick, label in given:
            free[other][pick] = False
            x, t = rows[other]
            rows[other] = (np.concatenate([x, pool[other][pick]]), np.concatenate([t, np.full(len(pick), label, np.float32)]))
        weights = [logistic(*r) for r in rows]
    both = np.stack([odds(w, v[held]) for w, v in zip(weights, views, strict=True)], axis=1).astype(np.float32)
    return weights[0], weights[1], logistic(both / 4, y[held].astype(np.float32), 1e-4, 1500)


class QualityModel:
    """Both targets' views, fitted on a bounded sample."""

    def __init__(self, stats: np.ndarray, words: list[np.ndarray], meta: np.ndarray, targets: dict[str, np.ndarray],
                 held: np.ndarray, pool: tuple[np.ndarray, list[np.ndarray], np.ndarray]) -> None:
        fit = np.flatnonzero(~held)
        self.content = Content(stats[fit], [words[i] for i in fit], [y[fit] for y in targets.values()])
        a, b = self.content.columns(stats, words), self.content.columns(pool[0], pool[1])
        self.parts = {name: co_train((a, meta), y, held, (b, pool[2])) for name, y in targets.items()}

    def score(self, stats: np.ndarray, words: list[np.ndarray], meta: np.ndarray) -> dict[str, np.ndarray]:
        a = self.content.columns(stats, words)
        out = {}
        for name, (one, two, both) in self.parts.items():
            out[name] = chance(odds(both, np.stack([odds(one, a), odds(two, meta)], axis=1) / 4))
        return out


FEATURES = "quality int, toxic int, held boolean, stats binary, words binary, meta binary"


def _sampled(rows: DataFrame) -> list:
    """Features of a bounded number of rows (quality, toxic, held, text, lang, source, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, words = statistics(batch.column(3))
            meta = metadata(*(batch.column(k).to_pylist() for k in (4, 5, 6)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (stats, words, meta.astype(np.int8)))],
                ["quality", "toxic", "held", "stats", "words", "meta"])

    return sorted(rows.mapInArrow(run, FEATURES).collect(), key=lambda r: (bytes(r.stats), bytes(r.words), bytes(r.meta), r.quality or 0, r.toxic or 0))


def _distinct(rows: list) -> list:
    """Of rows with the same words the first, so groups of copies don't weigh more than one document."""
    seen: dict[bytes, object] = {}
    for row in rows:
        seen.setdefault(bytes(row.words), row)
    return list(seen.values())


def _matrices(rows: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    stats = np.array([np.frombuffer(r.stats) for r in rows]).reshape(len(rows), len(KINDS) + 5)
    meta = np.array([np.frombuffer(r.meta, np.int8) for r in rows], np.float32).reshape(len(rows), META)
    return stats, [np.frombuffer(r.words, np.uint32) for r in rows], meta


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> QualityModel | None:
    """Fit on samples of ``docs`` (doc_id, text, lang, source, n_chars) with and without ``labels``
    (doc_id, quality, toxic); None without labels."""
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    small_batches(docs.sparkSession)
    given = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    n, total = given.count(), docs.count()
    if not n or not total:
        return None
    some = given.filter(place(1) < labelled / n).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.min("toxic").cast("int").alias("toxic"))
    columns = ["text", "lang", "source", "n_chars"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    held = (place(2) < HELD).alias("held")
    taught = _distinct(_sampled(rows.join(F.broadcast(some), "doc_id").select("quality", "toxic", held, *columns)))  # about ``labelled`` rows
    if len(taught) < 50:
        return None
    others = _sampled(rows.filter(place(3) < unlabelled / total).select(
        F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), F.lit(False).alias("held"), *columns))
    targets = {k: np.array([r[k] for r in taught], np.int64).clip(0, 1) for k in ("quality", "toxic")}
    return QualityModel(*_matrices(taught), targets, np.array([r.held for r in taught]), _matrices(others))


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, quality, toxic, score, keep) of every row; score is quality without toxicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, words = statistics(batch.column(1))
            meta = metadata(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            made = model.score(stats, words, meta) if model else {k: np.full(len(words), 0.5) for k in ("quality", "toxic")}
            good, bad = (np.asarray(made[k], np.float64) for k in ("quality", "toxic"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(good), pa.array(bad), pa.array(good * (1 - bad)), pa.array((good >= 0.5) & (bad <= 0.5))],
                ["doc_id", "quality", "toxic", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    return rows.mapInArrow(run, "doc_id long, quality double, toxic double, score double, keep boolean")
