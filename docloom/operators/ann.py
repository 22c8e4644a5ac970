"""Approximate search: cells of nearest centroids as partitions, a few of which are read for a query.

An extension beside the exact search of ``operators.search``. Centroids are fitted on a bounded sample;
every row is assigned to a cell. Recall against exact search is measured by ``recall`` and rises with the
number of cells read; reading all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import search

#: Rows on which centroids are fitted.
SAMPLE = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit(points: DataFrame, cells: int, vector: str = "text", key: str = "chunk_id", sample: int = SAMPLE, rounds: int = 15) -> np.ndarray:
    """Unit centroids by spherical k-means on at most about ``sample`` rows, chosen by a hash of the key."""
    total = points.count()
    share = min(1.0, sample / max(1, total))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    rows = points.filter(F.col(vector).isNotNull() & (place < share)).select(key, vector).orderBy(key).limit(sample).collect()
    x = _unit(np.array([r[1] for r in rows], np.float64))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        total_of = np.zeros_like(centroids)
        np.add.at(total_of, near, x)
        held = np.bincount(near, minlength=len(centroids)) > 0
        centroids[held] = _unit(total_of[held])
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray, vector: str = "text") -> DataFrame:
    """All ``points`` with the ``cell`` of their nearest centroid; null vectors go to cell 0."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            known = v.notna().to_numpy()
            out = np.zeros(len(v), np.int32)
            if known.any():
                out[known] = (np.stack(v[known].to_numpy()).astype(np.float64) @ centroids.T).argmax(1)
            yield pd.Series(out)

    return points.withColumn("cell", cell(F.col(vector)))


def write_index(points: DataFrame, centroids: np.ndarray, path: str, vector: str = "text") -> None:
    """Write every row, partitioned by cell."""
    assigned(points, centroids, vector).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def top_k(index: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int = 5, probes: int = 8, where: Column | None = None,
          vector: str = "text", **more) -> DataFrame:
    """The best ``k`` points in the ``probes`` cells nearest to ``query``; other cells are not read."""
    q = np.asarray(query, np.float64)
    cells = np.argsort(-(centroids @ q), kind="stable")[:probes]
    inside = F.col("cell").isin([int(c) for c in cells])
    return search.top_k(index, query, k, inside if where is None else inside & where, vector, **more).drop("cell")


def recall(index: DataFrame, centroids: np.ndarray, queries: list[Sequence[float]], k: int, probes: int, key: str = "chunk_id", vector: str = "text") -> float:
    """Share of the exact ``k`` nearest points that probing finds, over the given queries."""
    found = wanted = 0
    for query in queries:
        exact = {r[key] for r in search.top_k(index, query, k, vector=vector, threshold=None, key=key).collect()}
        near = {r[key] for r in top_k(index, centroids, query, k, probes, vector=vector, threshold=None, key=key).collect()}
        found, wanted = found + len(exact & near), wanted + len(exact)
    return found / max(1, wanted)
