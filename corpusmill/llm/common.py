"""Helpers of the training-data operators: folds, Arrow text buffers, vectorised hashing, packed sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked through in slices of about so many bytes, which bounds the arrays built from them.
SLICE_BYTES = 1 << 18
#: Rows go to and from Python in batches of about so many bytes.
BATCH_LIMIT = 4 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_LIMIT bytes, unless it is lower already: texts of any length then
    take about as much memory in an executor and its Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_LIMIT:
        spark.conf.set(name, str(BATCH_LIMIT))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each; a longer text is alone in its range."""
    size = np.diff(text_buffer(texts)[1])
    first, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(size):
        yield first, len(size)


def byte_table(keep, lower: bool = True, other: int = 0) -> np.ndarray:
    """Maps bytes: those in `keep` (a predicate on the lower-cased byte) to themselves, others to `other`."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if lower and 65 <= b <= 90 else b
        out[b] = low if keep(low) else other
    return out


def spans(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in `word`, cut where a text begins."""
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("p", BASE), ("q", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, from one running polynomial sum over data."""
    p, q = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def sum_packed(df: DataFrame, fan: int = 64) -> DataFrame:
    """Adds float64 vectors: (key string, part long, vec binary) to one row (key, vec) a key.

    Two rounds: rows of a key first meet in `fan` groups by part, then those sums meet, so no
    task gets one row from every input task of a large job.
    """

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), np.float64)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "vec"])

    first = df.repartition(fan, "key", F.col("part") % fan).select("key", "vec").mapInArrow(add, "key string, vec binary")
    return first.repartition("key").mapInArrow(add, "key string, vec binary")
