"""Exact top-k inner-product search over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import stored

SCALE = 1024
PIVOTS = 64
SAMPLE = 4_096  # vectors that pivots are drawn from and that seed the bounds; every vector is indexed
ANNULUS = 512  # rows of one pivot, neighbours in distance, that are scored or skipped together
QUERIES = 4_096  # queries shipped to the tasks at a time
INDEX = "dim int, pivot int, dist double, vec_id long, x array<long>"


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id long, x array<long>): floor(1024 v) of each component; rows with a null id, a null or empty vector, or a null or non-finite component are left out."""
    v = F.col(column)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in doubles while every partial sum is below 2**53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.array([[int(v) for v in row] for row in a.astype(object) @ b.T.astype(object)], np.int64).reshape(len(a), len(b))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots of a sample, so that cells are spread over the data."""
    picked = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(picked) < min(count, len(sample)):
        i = int(near.argmax())
        if near[i] == 0:
            break
        picked.append(i)
        near = np.minimum(near, distances(sample, sample[i:i + 1])[:, 0])
    return sample[picked]


def _keyed(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            part = b.filter(pa.array(sizes == dim))
            d = distances(matrix(part.column("x")), pivots[dim])
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), dim), pa.int32()), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near]), part.column("vec_id"), part.column("x").cast(schema[4].type)], schema=schema)


LOW = -(1 << 62)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids of each row, each once with its best score (ties: smaller id); ids -1 are empty places."""
    order = np.lexsort((np.where(ids < 0, np.iinfo(np.int64).max, ids), -scores), axis=1)[:, :k]
    top, who = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    near = np.sort(who, axis=1)
    again = np.flatnonzero(((near[:, 1:] == near[:, :-1]) & (near[:, 1:] >= 0)).any(axis=1))
    if len(again):  # without repeats among its k best a row is done
        order = np.lexsort((-scores[again], ids[again]), axis=1)
        s, i = np.take_along_axis(scores[again], order, 1), np.take_along_axis(ids[again], order, 1)
        lower = np.zeros(i.shape, bool)
        lower[:, 1:] = i[:, 1:] == i[:, :-1]
        top[again], who[again] = _top(np.where(lower, LOW, s), np.where(lower, -1, i), k)
    return top, who


def _search(batches: Iterator[pa.RecordBatch], dim: int, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, bound: np.ndarray, k: int, span: int) -> Iterator[pa.RecordBatch]:
    """Best k of each query inside a partition. Annuli are expanded from the one with the highest possible score on.

    Score = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and by the triangle inequality d(q, x) >= |d(q, p) - d(x, p)|: an annulus with the largest norm
    M and distances [lo, hi] holds no score above (|q|^2 + M^2 - gap^2) / 2, gap the distance of d(q, p) from [lo, hi].
    """
    to_pivot = distances(q, pivots)
    norm = (q.astype(np.float64) ** 2).sum(1)
    best, ids = np.full((len(q), k), LOW, np.int64), np.full((len(q), k), -1, np.int64)
    floor = bound.copy()
    for b in batches:
        b = b.filter(pa.array(b.column("dim").to_numpy(zero_copy_only=False) == dim))
        if not b.num_rows:
            continue
        x, vec, pivot, dist = matrix(b.column("x")), b.column("vec_id").to_numpy(), b.column("pivot").to_numpy(), b.column("dist").to_numpy()
        cuts = [0]
        for i in np.flatnonzero(np.diff(pivot)).tolist() + [len(pivot) - 1]:
            cuts += list(range(cuts[-1] + span, i + 1, span)) + [i + 1]
        rings = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            d = to_pivot[:, pivot[lo]]
            gap = np.maximum(np.maximum(dist[lo:hi].min() - d, d - dist[lo:hi].max()), 0)
            gap = np.maximum(gap - 1e-6 * (d + dist[lo:hi].max()) - 1e-3, 0)  # room for rounding
            reach = (norm + (x[lo:hi].astype(np.float64) ** 2).sum(1).max() - gap * gap) / 2
            rings.append((reach + 1e-9 * np.abs(reach) + 1, lo, hi))
        for reach, lo, hi in sorted(rings, key=lambda r: -r[0].max()):
            who = np.flatnonzero(reach >= floor)  # equal scores can still win by id
            if not len(who):
                continue
            s = products(q[who], x[lo:hi])
            s = np.where(vec[lo:hi][None, :] == q_ids[who][:, None], LOW, s)
            i = np.where(s == LOW, -1, vec[lo:hi][None, :])
            best[who], ids[who] = _top(np.concatenate([best[who], s], 1), np.concatenate([ids[who], i], 1), k)
            floor[who] = np.maximum(floor[who], best[who, k - 1])
    row, col = np.nonzero(ids >= 0) if (ids >= 0).any() else (np.zeros(0, int), np.zeros(0, int))
    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row], pa.int64()), pa.array(ids[row, col], pa.int64()), pa.array(best[row, col], pa.int64())], names=["query_id", "vec_id", "score"])


def pivot_index(vectors: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Vectors keyed by nearest pivot and distance, range-partitioned and sorted by that key (a crowded pivot spans partitions), with pivots and sample."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pivots, samples = {}, {}
    dims = [r[0] for r in vectors.select(F.size("x").alias("d")).distinct().orderBy("d").limit(10_000).collect()]
    for dim in dims:
        ids = vectors.where(F.size("x") == dim).select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)  # ids first: vectors of the few are read after
        rows = sorted(vectors.where(F.size("x") == dim).join(F.broadcast(ids), "vec_id").dropDuplicates(["vec_id"]).collect(), key=lambda r: r["vec_id"])
        x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dim)
        samples[dim] = (np.array([r["vec_id"] for r in rows], np.int64), x)
        pivots[dim] = choose_pivots(x, PIVOTS)
    schema = T._parse_datatype_string(INDEX)
    shared, arrow = vectors.sparkSession.sparkContext.broadcast(pivots), to_arrow_schema(schema)
    keyed = vectors.dropDuplicates(["vec_id", "x"]).mapInArrow(lambda it: _keyed(it, shared.value, arrow), schema)
    ordered = keyed.repartitionByRange("dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id")
    return stored(ordered, "pivot-index"), pivots, samples


def seed_bounds(q_ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Score that each query's k-th best cannot be below: its k-th best over the sample (distinct ids, itself excluded)."""
    ids, first = np.unique(sample_ids, return_index=True)
    if len(ids) <= k:
        return np.full(len(q), LOW, np.int64)
    out = []
    for i in range(0, len(q), 256):
        s = products(q[i:i + 256], sample[first])
        s = np.where(ids[None, :] == q_ids[i:i + 256, None], LOW, s)
        out.append(np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
    return np.concatenate(out)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all rows but its own id, ties to the smaller vec_id.

    vectors and queries: (vec_id, x) of `quantised`. Queries are a stated set: they are shipped in blocks, each against the whole index.
    Vectors meet only queries of their length. Rows that repeat an id count once with their best score; repeated queries of one id are one.
    Fewer than k candidates: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    index, pivots, samples = pivot_index(vectors)
    found = None
    blocks: dict[int, list] = {}

    def scan(dim):
        nonlocal found
        rows, blocks[dim] = blocks[dim], []
        q_ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        job = spark.sparkContext.broadcast((q_ids, q, pivots[dim], seed_bounds(q_ids, q, *samples[dim], k)))
        hits = index.where(F.col("dim") == dim).mapInArrow(lambda it: _search(it, dim, *job.value, k, ANNULUS), "query_id long, vec_id long, score long")
        found = hits if found is None else found.union(hits)

    for r in queries.dropDuplicates(["vec_id"]).toLocalIterator():
        dim = len(r["x"])
        blocks.setdefault(dim, []).append((r["vec_id"], r["x"]))
        if dim in pivots and len(blocks[dim]) >= QUERIES:
            scan(dim)
    for dim in [d for d, rows in blocks.items() if rows and d in pivots]:
        scan(dim)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("x"))
    return ranked.select("query_id", F.posexplode("x").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def op8_top_k(spark, folder: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
