"""What the operators share: table access, lineage cuts, Arrow text access and rolling hashes."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial byte hash (mod 2^64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only where it is unset on a local master is a temporary one made, as in tests.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return context.getCheckpointDir()


def freed(df: DataFrame) -> DataFrame:
    """``df`` whose shuffle files are removed when an action on it has ended, not when the driver next collects garbage."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return df.select("*")
    finally:
        conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return freed(df).checkpoint()


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, Python's first, as its objects hold those of the JVM.

    Spark removes broadcasts and shuffles of finished jobs, here and on the executors, only when the driver's JVM finds them
    unreachable. Many short jobs leave many of them before a roomy heap is collected by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of the session's Arrow batches; a lower bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions_for(spark: SparkSession, total_bytes: float, target: int) -> int:
    """Shuffle partitions for ``total_bytes`` at ``target`` bytes each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // target) + 1)


#: Bits of an ``id_filter``: 4 MB at most, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """A bitmap of the hashes of the column ``name``, as at most 1024 rows of 4 KB. It is for ``perhaps_in``, which
    saves exchanges; rows that pass it are still to be joined, so a full bitmap costs work and no result."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    return ids.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))


def perhaps_in(rows: DataFrame, wanted: DataFrame, flag: str, name: str = "doc_id") -> DataFrame:
    """``rows`` with the column ``flag``: false where ``name`` is in none of the ids that the bitmap ``wanted`` holds."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    byte = F.substring("__bits", (F.shiftright(F.bitmap_bit_position(at), 3) + 1).cast("int"), F.lit(1))
    place = (F.bitmap_bit_position(at) % 8 + 1).cast("int")
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place))
    joined = rows.join(F.broadcast(wanted), F.bitmap_bucket_number(at) == F.col("__bucket"), "left")
    return joined.withColumn(flag, F.coalesce(bit > 0, F.lit(False))).drop("__bucket", "__bits")


def text_blocks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts with about ``limit`` bytes; nulls count as empty.

    A text longer than the limit makes a run of its own; no text is cut.
    """
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, body[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 … base^(n-1) mod 2^64, kept per worker."""
    key = str(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, n + (n >> 3))
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (values[j] + 1) * BASE^j for j < i, mod 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal content hashes alike wherever it stands."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix), BASE_INVERSE)[start])


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((prefix[k:] - prefix[:-k]) * powers(n, BASE_INVERSE))


SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words (runs without ASCII white space, never across texts), and
    for each text the index of its first word (one more entry closes the last)."""
    solid = ~SPACES[body]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    if len(solid):
        before[0] = after[-1] = False
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(solid))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    import pyspark

    return pyspark.__dict__.setdefault("_docloom_worker_cache", {})
