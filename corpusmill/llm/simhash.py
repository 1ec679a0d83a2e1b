"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints at most 4 bits apart
have either no error in one segment and at most 2 in another, or no segment free of errors and at most
2 in each. A segment, padded to 23 bits, is decoded with the perfect binary Golay code: the codeword
indices met within one bit of it (six at most) are its fuzzy keys, and two segments at most 2 bits
apart have a bit string within one bit of both, so they share a key. Keys are therefore (exact
segment, fuzzy key of another) for each ordered pair, and (fuzzy key, fuzzy key) of the first two
segments. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import bound_batches, byte_table, slices
from corpusmill.operators.graph import connected_components
from corpusmill.session import cut_lineage, release

BITS = 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Keys with more fingerprints than this are compared in pairs of blocks, each pair a unit of its own.
BLOCK = 4096
#: The table of such keys is broadcast up to so many rows of 12 bytes, and joined by shuffle beyond.
MOST_BROADCAST = 200_000
LOWER = bytes(byte_table(lambda b: True).tolist())
_golay: list[np.ndarray] = []


def golay_table() -> np.ndarray:
    """For each 23-bit word the index of the one codeword within three bits of it."""
    if not _golay:
        generator = 0b101011100011
        data = np.arange(1 << 12, dtype=np.uint32)
        code = np.zeros(1 << 12, np.uint32)
        for i in range(12):
            code ^= np.where(data >> i & 1, np.uint32(generator << i), np.uint32(0))
        one = np.uint32(1) << np.arange(23, dtype=np.uint32)
        errors = {0, *one.tolist()}
        for _ in range(2):
            errors |= {e | int(b) for e in errors for b in one}
        table = np.zeros(1 << 23, np.uint16)
        for e in errors:
            table[code ^ np.uint32(e)] = data
        _golay.append(table)
    return _golay[0]


def fuzzy_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices within one bit of each segment: an (n, bits+1) matrix and which entries are new in their row."""
    table = golay_table()
    near = np.concatenate([segment[:, None], segment[:, None] ^ (np.uint32(1) << np.arange(bits, dtype=np.uint32))], axis=1)
    keys = np.sort(table[near], axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, fresh


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint (unsigned 64-bit)."""
    exact = [(fp >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.uint32) for s, b in SEGMENTS]
    fuzzy = [fuzzy_keys(x, b) for x, (_, b) in zip(exact, SEGMENTS, strict=True)]
    rows, keys = [], []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                k, fresh = fuzzy[j]
                r, c = np.nonzero(fresh)
                rows.append(r)
                keys.append((np.int64(tag) << 34) | (exact[i][r].astype(np.int64) << 12) | k[r, c])
                tag += 1
    # the first two segments, each by every fuzzy key (at most six are distinct)
    six = []
    for k, fresh in fuzzy[:2]:
        place = np.cumsum(fresh, axis=1) - 1
        out = np.full((len(fp), 6), -1, np.int64)
        r, c = np.nonzero(fresh)
        out[r, place[r, c]] = k[r, c]
        six.append(out)
    both = np.where((six[0][:, :, None] >= 0) & (six[1][:, None, :] >= 0), six[0][:, :, None] << 12 | six[1][:, None, :], -1).reshape(len(fp), 36)
    r, c = np.nonzero(both >= 0)
    rows.append(r)
    keys.append((np.int64(tag) << 34) | both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes) -> int:
    """The majority of the shingle hashes, bit by bit; no word: zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= 4:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    end = (start + size - 1)[3:]
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(end)
    for a in range(0, n, 16384):
        h = b"".join([digest(line[s:e], 42) for s, e in zip(start[a : a + 16384].tolist(), end[a : a + 16384].tolist(), strict=False)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """(id, uid, fp): the fingerprint of each row's whole text as a signed long; uid is the column named, or numbers the rows of docs."""

    def run(batches):
        for b in batches:
            text = b.column(2).cast(pa.large_binary())
            for first, stop in slices(b.column(2)):
                fp = np.array([fingerprint(x or b"") for x in text[first:stop].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0)[first:stop], b.column(1)[first:stop], pa.array(fp.view(np.int64))], ["id", "uid", "fp"])

    uid = F.monotonically_increasing_id() if uid_col is None else F.col(uid_col).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), uid.alias("uid"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("uid", T.LongType()), T.StructField("fp", T.LongType())]))


def _forest(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among the fingerprints: every link's ends end in one tree."""
    left = np.arange(len(fp))
    out = []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            p = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[p]) <= BITS
            if near.any():
                got = left[near]
                out.append((np.full(len(got), p), got))
                frontier.extend(got.tolist())
                left = left[~near]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows (unit, fp) that are sorted by unit; a run is at most two blocks."""

    def links(unit: np.ndarray, fp: np.ndarray):
        if not len(unit):
            return None
        edge = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
        size = np.diff(np.append(edge, len(unit)))
        a, b = [], []
        small = np.repeat(size <= 48, size)
        u, f = unit[small], fp[small]
        for lag in range(1, int(size[size <= 48].max(initial=1))):
            x = np.flatnonzero((u[lag:] == u[:-lag]))
            if not len(x):
                break
            x = x[np.bitwise_count(f[x] ^ f[x + lag]) <= BITS]
            a.append(f[x])
            b.append(f[x + lag])
        for s, n in zip(edge[size > 48].tolist(), size[size > 48].tolist(), strict=True):
            own = fp[s : s + n]
            for i, j in _forest(own):
                a.append(own[i])
                b.append(own[j])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["src", "dst"])

    units, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        units = np.append(units, batch.column(0).to_numpy())
        prints = np.append(prints, batch.column(1).to_numpy().view(np.uint64))
        if not len(units):
            continue
        stop = np.searchsorted(units, units[-1])
        if got := links(units[:stop], prints[:stop]):
            yield got
        units, prints = units[stop:], prints[stop:]
    if got := links(units, prints):
        yield got


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(src, dst) among the distinct fingerprints `fp` of prints: enough links of at most 4 differing bits to connect all that are linked.

    Keys of one fingerprint go no further. A key with more than BLOCK fingerprints is cut into blocks by
    a hash, and each pair of blocks is compared on its own; nothing is capped.
    """

    def keyed(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for first in range(0, len(fp), 4096):
                own = fp[first : first + 4096]
                rows, keys = golay_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows].view(np.int64))], ["key", "fp"])

    keys = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    hot = cut_lineage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    n = hot.count()
    units = keys.withColumnRenamed("key", "unit")
    if n:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
        marked = keys.join(F.broadcast(hot) if n <= MOST_BROADCAST else hot, "key", "left")
        split = marked.where("blocks is not null").select("key", "fp", F.explode(pairs).alias("pair"))
        units = marked.where("blocks is null").select(F.col("key").alias("unit"), "fp").unionByName(split.select(F.xxhash64("key", "pair").alias("unit"), "fp"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """(id, uid, fp, component_id, keeper) for each row of docs.

    Rows that are to be told apart afterwards bring a number of their own in uid_col, written down before: a
    number made on reading may change when files are read again. Without one the rows are numbered here, and
    the numbers hold within this result only. Columns of docs beyond these are not carried along.

    component_id is the smallest id reachable over links of at most 4 differing fingerprint bits; keeper
    is the uid of the row to keep (smallest id, then first row). Null and empty texts have fingerprint
    zero and are linked like any other; repeated rows share a component; null ids count as largest.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, uid_col))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid")))
    distinct = cut_lineage(prints.groupBy("fp").agg(first.alias("first")))
    component = connected_components(fingerprint_links(distinct))
    linked = distinct.join(component, distinct.fp == component.node).select("fp", "first", "component")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = linked.join(least, "component").where("first <> least").select(F.col("fp").alias("own"), "least")
    heads = cut_lineage(distinct.join(moved, distinct.fp == moved.own, "left").select("fp", F.coalesce("least", "first").alias("head")))
    release(distinct)
    return prints.join(heads, "fp").select("id", "uid", "fp", F.col("head.id").alias("component_id"), F.col("head.uid").alias("keeper"))


def op3(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
