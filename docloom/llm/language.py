"""Language identification by hierarchical discrimination.

A text is first given to a language family; one-versus-one linear support vector machines then separate
the languages of that family. All machines read hashed counts of letter trigrams over the whole text
(lower-cased, other signs as one gap), scaled to unit length. Margins are calibrated to probabilities by
logistic fits; the score is the winner's family probability times its probability within the family.

Training uses about ``PER_LANGUAGE`` labelled rows of each language, fewer if there are so many languages that these
would exceed ``ROWS``, but ``LEAST`` or all it has of each; every language is learned. Rows are chosen by a hash of
doc_id; ids, sources and labels are never features. A text that is null or holds no letter is ``und`` with score 0,
as is every text if nothing was learned. Predictions treat rows one by one: ties between languages go
to the first by name, repeated rows are predicted alike, very long texts are read whole, an empty table gives no row.
Other columns are ignored by ``identify`` and kept as they are, whatever their names, by ``known_languages``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import release, small_batches, worker_cache

FEATURES = 4096
PER_LANGUAGE = 800
#: Rows learned from, over all languages, unless ``LEAST`` rows of each are more.
ROWS, LEAST = 8000, 20
#: Languages by family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr"),
}
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def letters() -> np.ndarray:
    """Which code points are letters."""
    kept = worker_cache()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the text's letters; gaps between words count as one sign. Empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    solid = letters()[points]
    if not solid.any():
        return np.zeros(0, np.int64)
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    kept = np.concatenate([[0], np.where(solid, points, 0)[solid | before], [0]]).astype(np.uint32)
    code = kept[:-2] * np.uint32(2654435761) ^ kept[1:-1] * np.uint32(2246822519) ^ kept[2:] * np.uint32(3266489917)
    return ((code * np.uint32(668265263)) >> np.uint32(20)).astype(np.int64) % FEATURES


def vectors(texts: list[str | None]) -> np.ndarray:
    """Unit-length trigram counts, a row for each text; zero rows for texts without letters."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        grams = trigrams(text)
        if len(grams):
            counts = np.bincount(grams, minlength=FEATURES)
            out[i] = counts / np.sqrt((counts.astype(np.float64) ** 2).sum())
    return out


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 120) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b) of a linear machine on squared hinge loss, by accelerated gradient descent;
    a and b calibrate its margin m to the probability 1 / (1 + exp(-(a m + b)))."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, bias = np.zeros(x.shape[1]), 0.0
    look_w, look_b, t = w, bias, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look_w.astype(x.dtype) + look_b)) * weight * y
        new_w = look_w - (strength * look_w - 2 * (slack.astype(x.dtype) @ x)) / 2.5
        new_b = look_b + 2 * slack.sum() / 2.5
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w = new_w + (t - 1) / ahead * (new_w - w)
        look_b = new_b + (t - 1) / ahead * (new_b - bias)
        w, bias, t = new_w, new_b, ahead
    margin, a, b = x @ w.astype(x.dtype) + bias, 1.0, 0.0
    goal = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - goal)
        h = weight * p * (1 - p)
        hess = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum() + 1e-4 * a, g.sum() + 1e-4 * b]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return w, float(bias), float(a), float(b)


@dataclass
class Contest:
    """One-versus-one machines among some classes."""

    names: list[str]
    weights: np.ndarray
    biases: np.ndarray
    slopes: np.ndarray
    shifts: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Contest:
        names = sorted(set(labels.tolist()))
        made = []
        for one, two in combinations(names, 2):
            rows = (labels == one) | (labels == two)
            made.append(svm(x[rows], np.where(labels[rows] == one, 1.0, -1.0)))
        w = np.array([m[0] for m in made], np.float32).reshape(len(made), x.shape[1])
        rest = np.array([m[1:] for m in made], np.float64).reshape(len(made), 3)
        return Contest(names, w, rest[:, 0], rest[:, 1], rest[:, 2])

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its mean probability against the others) of each row."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights.T + self.biases
        p = 1 / (1 + np.exp(-np.clip(margins * self.slopes + self.shifts, -30, 30)))
        votes, share = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            votes[:, i] += p[:, k] >= 0.5
            votes[:, j] += p[:, k] < 0.5
            share[:, i] += p[:, k] / (n - 1)
            share[:, j] += (1 - p[:, k]) / (n - 1)
        best = np.argmax(votes + share / (2 * n), axis=1)
        return best, share[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    """A contest among families, and one within each."""

    families: Contest
    within: dict[str, Contest]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x = vectors(texts)
        known = x.any(axis=1)
        best, sure = self.families.decide(x)
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for k, name in enumerate(self.families.names):
            rows = np.flatnonzero(known & (best == k))
            if len(rows):
                inner = self.within[name]
                pick, p = inner.decide(x[rows])
                score[rows] = sure[rows] * p
                for row, i in zip(rows.tolist(), pick.tolist(), strict=True):
                    out[row] = inner.names[i]
        return out, np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learn from ``docs`` (doc_id, text, lang) that are not held out; None if there is nothing to learn from."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    small_batches(docs.sparkSession)
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    wanted = min(per_language, max(LEAST, ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, wanted / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.filter(place < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())],
                                             ["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").collect())
    x = np.stack([np.frombuffer(v, np.float16) for _, v in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES), np.float32)
    release(docs.sparkSession)
    some = x.any(axis=1)
    labels = np.array([lang for lang, _ in rows], object)[some]
    x = x[some]
    if not len(x):
        return None
    groups = np.array([family(lang) for lang in labels], object)
    within = {name: Contest.fit(x[groups == name], labels[groups == name]) for name in sorted(set(groups.tolist()))}
    return LanguageModel(Contest.fit(x, groups), within)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` (with text) and ``lang_pred`` and ``score`` beside all its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            names, scores = [], []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                name, score = model.predict(part) if model else ([UNKNOWN] * len(part), np.zeros(len(part)))
                names += name
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    fields = [*docs.drop("lang_pred", "score").schema.fields]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.drop("lang_pred", "score").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): held_out, lang_pred and score, by a model learned from ``docs``."""
    model = train(docs)
    rows = docs.select(F.col("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def known_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und``)."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(batch.schema.names.index("text")).to_pylist(), []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                known += [name != UNKNOWN for name in model.predict(part)[0]] if model else [False] * len(part)
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
