"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables has PROJECTIONS Gaussian (2-stable) projections of the unit vectors, each cut into cells
one standard deviation wide; a vector's cells name its bucket. For a query, the chance that a neighbour at the design
similarity lies in a bucket is the product, over projections, of a normal's mass in each cell, the normal
being centred where the query's own projection is shrunk to. Perturbed buckets, empty ones included, are
gone through in the order of that chance until they hold a share of it that is measured: for a sample of vectors
the true neighbours among all rows are found first, and the share is the least that would have met them. Candidates
of all tables are merged and ranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

TABLES, PROJECTIONS = 2, 9
#: Cell edges in standard deviations of a projection; the outer cells are open, so a table has at most 3^9 buckets.
EDGES = np.array([-0.5, 0.5])
CELLS = len(EDGES) + 1
#: The share of a neighbour's chance up to which buckets are gone through is set so that of the true neighbours of SAMPLE
#: vectors this part would be met. The design similarity is what three of four of them have in their k-th neighbour.
RECALL, SAMPLE = 0.96, 256
#: A unit of work holds about so many vectors, and meets packs of so many queries.
UNIT, PACK = 16_384, 256
SEED = 20240711


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(TABLES, PROJECTIONS, dim))


def _cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26; error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x / 2)
    return np.where(x >= 0, (1 + y) / 2, (1 - y) / 2)


def buckets(unit: np.ndarray, a: np.ndarray) -> np.ndarray:
    """(n, TABLES) bucket numbers of unit vectors."""
    cell = np.searchsorted(EDGES, np.einsum("nd,tpd->ntp", unit, a))
    return (cell * CELLS ** np.arange(PROJECTIONS)).sum(axis=2)


def chances(unit: np.ndarray, a: np.ndarray, similarity: float) -> Iterator[list[np.ndarray]]:
    """For each query and table, the chance of every bucket of the table, by its number, and the sum of all chances that are as large or larger."""
    spread = math.sqrt(max(1 - similarity**2, 1e-6))
    centre = np.einsum("nd,tpd->ntp", unit, a) * similarity
    upper = _cdf((np.append(EDGES, np.inf) - centre[..., None]) / spread)
    mass = np.maximum(np.diff(np.concatenate([np.zeros((*centre.shape, 1)), upper], axis=-1), axis=-1), 1e-9)
    for i in range(len(unit)):
        own = []
        for t in range(TABLES):
            every = np.ones(1)
            for p in range(PROJECTIONS - 1, -1, -1):
                every = (every[:, None] * mass[i, t, p][None, :]).ravel()
            own.append(every / every.sum())
        yield own


def share_needed(unit: np.ndarray, a: np.ndarray, similarity: float, near: list[np.ndarray]) -> list[float]:
    """For each neighbour, given by its buckets (a row of TABLES numbers) under its query, the share at which the first table meets it."""
    out = []
    for own, rows in zip(chances(unit, a, similarity), near, strict=True):
        if len(rows):
            need = []
            for t, every in enumerate(own):
                order = np.sort(every)[::-1]
                total = np.cumsum(order)
                need.append(total[np.searchsorted(-order, -every[rows[:, t]], side="left")])
            out += np.min(need, axis=0).tolist()
    return out


def probes(unit: np.ndarray, a: np.ndarray, similarity: float, occupied: list[np.ndarray], success: float, held: list[np.ndarray] | None = None, k: int = 0) -> list[list[np.ndarray]]:
    """For each query and table, positions among the table's occupied buckets, in order of estimated success, as far as that share of it.

    held: how many ids each bucket has, each id counted in one bucket of a table. Where no table's buckets are sure
    to hold k ids beside the query's own, the first table's are gone through further, until they do or none is left.
    """
    out = []
    for tables in chances(unit, a, similarity):
        own = []
        for t, every in enumerate(tables):
            order = np.sort(every)[::-1]
            least = order[min(np.searchsorted(np.cumsum(order), success), len(order) - 1)]
            chance = every[occupied[t]]
            visit = np.flatnonzero(chance >= least)
            own.append(visit[np.argsort(-chance[visit], kind="stable")])
            if t == 0:
                further = chance
        if held is not None and all(n[visit].sum() <= k for n, visit in zip(held, own, strict=True)):
            order = np.argsort(-further, kind="stable")
            own[0] = order[: np.searchsorted(np.cumsum(held[0][order]), k + 1) + 1]
        out.append(own)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component lies between a half and one: no square overflows or vanishes, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by exact cosine, ties to smaller ids; each id once, the query's own id never. Query and vectors are scaled."""
    score = (vectors * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    first = np.sort(np.unique(ids, return_index=True)[1])
    first = first[ids[first] != own][:k]
    return ids[first], score[first]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` selects, the k nearest rows found.

    Rows without an id, and vectors that are null, empty, zero, or hold null or non-finite components, take no
    part; any finite component counts, however large or small. Vectors of different lengths have no cosine, so
    each length is searched on its own. Fewer than k candidates: all of them. Rows that repeat an id count once,
    with the nearer vector. Other columns are not read, whatever their names; an empty table gives no rows. Work is
    dealt in units of about UNIT vectors of some buckets of one table; a group of buckets with more (many equal
    vectors, say) is cut by a hash of the id, and the packs of queries that probe it go to each cut. What is broadcast
    is the list of occupied buckets, at most CELLS ** PROJECTIONS a table, and SAMPLE vectors.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).orderBy("d").collect():  # one row a length
        if r["asked"]:
            out = out.unionByName(_nearest(rows.where(F.size(v) == r["d"]), r["d"], r["n"], k))
    return out


def _nearest(rows: DataFrame, dim: int, total: int, k: int) -> DataFrame:
    """nearest() for vectors (id, v, q) of one length."""
    spark = rows.sparkSession
    a = directions(dim)

    def place(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            t = buckets(unit_rows(x), a) if len(x) else np.zeros((0, TABLES), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(t[:, i]) for i in range(TABLES))], [*b.schema.names, *(f"t{i}" for i in range(TABLES))])

    placed = cut_lineage(rows.mapInArrow(place, "id long, v array<double>, q boolean, " + ", ".join(f"t{i} long" for i in range(TABLES))))
    similarity, success = _measure(placed, a, dim, k)
    # groups of buckets: about UNIT vectors each, if the buckets allow it
    groups = max(1, math.ceil(total / UNIT))
    group = lambda b: F.pmod(F.xxhash64(b), F.lit(groups)).cast("int")
    each = placed.select("id", "v", "q", F.posexplode(F.array(*(f"t{i}" for i in range(TABLES)))).alias("t", "bucket"))
    counts = each.groupBy("t", "bucket").count().withColumn("g", group("bucket")).collect()
    occupied = [np.array(sorted(r["bucket"] for r in counts if r["t"] == t)) for t in range(TABLES)]
    homes = placed.groupBy("id").agg(*(F.min(f"t{i}").alias(f"t{i}") for i in range(TABLES)))
    homes = homes.select(F.posexplode(F.array(*(f"t{i}" for i in range(TABLES)))).alias("t", "bucket")).groupBy("t", "bucket").count().collect()
    home = {(r["t"], r["bucket"]): r["count"] for r in homes}
    held_in = [np.array([home.get((t, b), 0) for b in occupied[t].tolist()], np.int64) for t in range(TABLES)]
    group_of = [dict() for _ in range(TABLES)]
    load: dict[tuple[int, int], int] = {}
    for r in counts:
        group_of[r["t"]][r["bucket"]] = r["g"]
        load[r["t"], r["g"]] = load.get((r["t"], r["g"]), 0) + r["count"]
    cut = {key: max(1, math.ceil(n / (2 * UNIT))) for key, n in load.items()}
    sent = spark.sparkContext.broadcast((occupied, [np.array([group_of[t][b] for b in occupied[t].tolist()]) for t in range(TABLES)], cut, held_in))

    def pack(batches):
        """For each pack of queries and each unit that one of them probes: the queries and their buckets there."""
        occupied, groups_at, cut, held_in = sent.value
        for b in batches:
            for first in range(0, b.num_rows, PACK):
                ids = b.column(0).to_numpy()[first : first + PACK]
                x = matrix(b.column(1).slice(first, PACK), dim)
                visits = probes(unit_rows(x), a, similarity, occupied, success, held_in, k)
                out: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
                for i, own in enumerate(visits):
                    for t, order in enumerate(own):
                        g = groups_at[t][order]
                        for one in np.unique(g).tolist():
                            out.setdefault((t, one), []).append((i, occupied[t][order[g == one]]))
                cols: list[list] = [[], [], [], [], [], []]
                for (t, g), found in out.items():
                    who = [i for i, _ in found]
                    for s in range(cut[t, g]):
                        for c, y in zip(cols, (t, g, s, ids[who].astype(np.int64).tobytes(), x[who].tobytes(), [z.astype(np.int32).tobytes() for _, z in found]), strict=True):
                            c.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.binary()))], ["t", "g", "s", "ids", "x", "visits"])

    cuts = spark.createDataFrame([(t, g, n) for (t, g), n in cut.items()], "t int, g int, n int")
    stored = each.withColumn("g", group("bucket")).join(F.broadcast(cuts), ["t", "g"])
    stored = stored.select("t", "g", F.pmod(F.xxhash64("id"), "n").cast("int").alias("s"), F.lit(0).alias("kind"), "id", "v", "bucket", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("x"), F.lit(None).cast("array<binary>").alias("visits"))
    asked = placed.where("q").select("id", "v").mapInArrow(pack, "t int, g int, s int, ids binary, x binary, visits array<binary>")
    asked = asked.select("t", "g", "s", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("bucket"), "ids", "x", "visits")

    def search(batches):
        unit, held = None, []
        ids = vecs = edge = names = units = None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1) if b.num_rows else np.zeros((0, 4))
            for first, stop in _runs(key):
                own = tuple(key[first, :3].tolist())
                if own != unit:
                    unit, held, ids = own, [], None
                part = b.slice(first, stop - first)
                if key[first, 3] == 0:
                    held.append((part.column(4).to_numpy(), matrix(part.column(5), dim), part.column(6).to_numpy()))
                    continue
                if not held:
                    continue
                if ids is None:
                    bucket = np.concatenate([h[2] for h in held])
                    order = np.argsort(bucket, kind="stable")
                    ids = np.concatenate([h[0] for h in held])[order]
                    vecs = np.concatenate([h[1] for h in held])[order]
                    names, edge = np.unique(bucket[order], return_index=True)
                    edge = np.append(edge, len(bucket))
                    units = unit_rows(vecs)
                for row in range(part.num_rows):
                    yield _answer(part, row, dim, k, ids, vecs, units, names, edge)

    met = stored.unionByName(asked).repartition("t", "g", "s").sortWithinPartitions("t", "g", "s", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _measure(placed: DataFrame, a: np.ndarray, dim: int, k: int) -> tuple[float, float]:
    """The design similarity, and the share of chance at which RECALL of the true neighbours of some vectors are met.

    The vectors are SAMPLE at most, those of the smallest hashes of their ids; each task sends its k nearest rows to each.
    """
    chosen = placed.groupBy("id").agg(F.first("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    ids, unit = np.array([r["id"] for r in chosen], np.int64), unit_rows(np.array([r["v"] for r in chosen], np.float64).reshape(-1, dim))
    sent = placed.sparkSession.sparkContext.broadcast((ids, unit))
    buckets_of = [f"t{i}" for i in range(TABLES)]

    def near(batches):
        ids, unit = sent.value
        score, rows = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0, 1 + TABLES), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            got = unit @ unit_rows(matrix(b.column(1), dim)).T
            got[ids[:, None] == own[None, :]] = -np.inf
            keep = np.argsort(-got, axis=1, kind="stable")[:, :k]
            info = np.stack([own, *(b.column(2 + t).to_numpy() for t in range(TABLES))], axis=1)
            score = np.concatenate([score, np.take_along_axis(got, keep, axis=1)], axis=1)
            rows = np.concatenate([rows, info[keep]], axis=1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, rows = np.take_along_axis(score, keep, axis=1), np.take_along_axis(rows, keep[..., None], axis=1)
        i, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(score[i, j]), *(pa.array(rows[i, j, c]) for c in range(1 + TABLES))], ["at", "score", "near", *buckets_of])

    found = placed.select("id", "v", *buckets_of).mapInArrow(near, "at long, score double, near long, " + ", ".join(f"{c} long" for c in buckets_of))
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "near"))
    found = found.withColumn("place", place).where(F.col("place") <= k).toArrow()  # at most k rows a sampled vector
    at, score = found["at"].to_numpy(), found["score"].to_numpy()
    if not len(at):
        return 0.5, 1.0
    numbers = np.stack([found[c].to_numpy() for c in buckets_of], axis=1)
    last = [score[at == i].min() for i in np.unique(at)]
    similarity = float(np.clip(np.quantile(last, 0.25), 0.05, 0.95))
    need = share_needed(unit, a, similarity, [numbers[at == i] for i in range(len(ids))])
    return similarity, float(np.quantile(need, RECALL, method="higher"))


def _runs(key: np.ndarray):
    if len(key):
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        yield from zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True)


def _answer(part: pa.RecordBatch, row: int, dim: int, k: int, ids, vecs, units, names, edge) -> pa.RecordBatch:
    """The best k of the unit's candidates for each query of one pack."""
    asked = np.frombuffer(part.column(7)[row].as_py(), np.int64)
    x = np.frombuffer(part.column(8)[row].as_py(), np.float64).reshape(-1, dim)
    score = np.full((len(asked), len(ids)), -np.inf)
    direction, whole = unit_rows(x), scaled(x)
    by_bucket: dict[int, list[int]] = {}
    for i, visit in enumerate(part.column(9)[row].as_py()):
        for name in np.frombuffer(visit, np.int32).tolist():
            by_bucket.setdefault(name, []).append(i)
    for j, name in enumerate(names.tolist()):
        if who := by_bucket.get(name):
            score[who, edge[j] : edge[j + 1]] = direction[who] @ units[edge[j] : edge[j + 1]].T
    q, found, exact = [], [], []
    for i, own in enumerate(asked.tolist()):
        s = np.where(ids == own, -np.inf, score[i])
        have = np.flatnonzero(s > -np.inf)
        if len(have) > k:
            top = have[s[have] >= np.partition(s[have], len(have) - k)[len(have) - k] - 1e-9]
            if len(np.unique(ids[top])) >= k:  # rows that repeat an id count once
                have = top
        got, value = best(whole[i], own, ids[have], scaled(vecs[have]), k)
        q += [own] * len(got)
        found.append(got)
        exact.append(value)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64()), pa.array(np.concatenate(exact) if exact else [], pa.float64())], ["query_id", "vec_id", "score"])


def op8(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
