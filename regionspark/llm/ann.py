"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by three rounds of random signs and a fast
Hadamard transform and takes the nearest signed axis. Every row is in one
bucket of each table. A query looks into the buckets of its nearest axes - at
least `probes` a table, and more until they hold MIN_ROWS rows - and the rows
there are ranked by their exact Euclidean distance in double precision.

Buckets are compared in blocks: a crowded bucket's rows, and the queries that
look into it, are split by hash into blocks of bounded size, and a task holds
one block of each. Of a block only each query's k nearest rows go on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, pick

TABLES = 8
PROBES = 12
#: A query's probes go on until they hold so many rows (or all there are).
MIN_ROWS = 500
ROW_BLOCK = 8192
QUERY_BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; rows have a power of two of components."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    d = 1 << max(1, math.ceil(math.log2(x.shape[1])))
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for k in range(3):
        x = hadamard(x * np.random.default_rng([seed, table, k, d]).choice([-1.0, 1.0], d)) / math.sqrt(d)
    return x


def axis_scores(x: np.ndarray) -> np.ndarray:
    """How near each of the 2d signed axes is: axis i at 2i, its opposite at 2i + 1."""
    out = np.empty((len(x), 2 * x.shape[1]))
    out[:, 0::2], out[:, 1::2] = x, -x
    return out


def _matrices(ids: pa.Array, vecs: pa.Array):
    """(ids, float64 rows) by length; vectors null, zero, or with null or non-finite components are left out."""
    ok = np.asarray(vecs.is_valid()) & np.asarray(ids.is_valid())
    values = vecs.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = vecs.offsets.to_numpy().astype(np.int64)
    length = np.diff(offsets)
    keys = ids.fill_null(0).to_numpy()
    for n in np.unique(length[ok]).tolist():
        if n == 0:
            continue
        at = np.flatnonzero(ok & (length == n))
        x = values[offsets[at][:, None] + np.arange(n)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield keys[at[good]], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", tables: int = TABLES, seed: int = 1) -> DataFrame:
    """vec_id, dim, vec (doubles), codes (the bucket in each table), of every row that takes part."""

    def run(batches):
        for b in batches:
            for ids, x in _matrices(b.column(0), b.column(1)):
                if len(ids):
                    unit = _unit(x)
                    codes = np.stack([axis_scores(rotated(unit, t, seed)).argmax(axis=1) for t in range(tables)], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array([x.shape[1]] * len(ids), pa.int32()), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))],
                        names=["vec_id", "dim", "vec", "codes"],
                    )

    rows = pick(vectors, id_col, vector).select(F.col(id_col).cast("long"), F.col(vector))
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary, codes array<int>")


def _probe(counts: dict[tuple[int, int, int], int], probes: int, min_rows: int, tables: int, seed: int):
    """Queries -> a row for each bucket that they look into."""

    def run(batches):
        for b in batches:
            ids, dims, vecs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                unit = _unit(np.stack([np.frombuffer(vecs[i], "<f8") for i in at]))
                order = [np.argsort(-axis_scores(rotated(unit, t, seed)), axis=1, kind="stable") for t in range(tables)]
                rows, table, bucket = [], [], []
                for q in range(len(at)):
                    held = 0
                    for k in range(order[0].shape[1]):
                        if k >= probes and held >= min_rows:
                            break
                        for t in range(tables):
                            c = int(order[t][q, k])
                            n = counts.get((d, t, c), 0)
                            if n:
                                rows.append(at[q])
                                table.append(t)
                                bucket.append(c)
                                held += n if t == 0 else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows] if rows else [], pa.int64()), pa.array([d] * len(rows), pa.int32()), pa.array([vecs[i] for i in rows], pa.binary()), pa.array(table, pa.int32()), pa.array(bucket, pa.int32())],
                    names=["query_id", "dim", "vec", "tbl", "bucket"],
                )

    return run


def _rank(k: int):
    """A block of rows and a block of queries -> each query's k nearest rows in it."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left, right):
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, qids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = np.stack([np.frombuffer(v, "<f8") for v in left.column("vec").to_pylist()])[order]
        q = np.stack([np.frombuffer(v, "<f8") for v in right.column("vec").to_pylist()])
        xx = (x * x).sum(axis=1)
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            rough = xx - 2 * (part @ x.T)  # squared distances but for the query's own norm
            rough[qids[at : at + 64][:, None] == ids] = np.inf
            for i, r in enumerate(rough):
                m = min(k, len(r))
                # all that rounding could bring among the nearest, then exactly
                limit = np.partition(r, m - 1)[m - 1]
                near = np.flatnonzero((r <= limit + 1e-9 * (1 + abs(limit) + xx.max())) & np.isfinite(r)) if np.isfinite(limit) else np.flatnonzero(np.isfinite(r))
                diff = x[near] - part[i]
                score = np.sqrt((diff * diff).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out_q.append(np.full(len(best), qids[at + i]))
                out_v.append(ids[near[best]])
                out_s.append(score[best])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=schema)

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    tables: int = TABLES,
    probes: int = PROBES,
    min_rows: int = MIN_ROWS,
    seed: int = 1,
) -> DataFrame:
    """Each query's k nearest rows found: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the rows whose id is divisible by `every`, or the ids in
    `queries` (a column id_col). A row is no candidate for the query with its
    own id; rows that share an id count as one, at the least of their
    distances. Ties go to the smaller vec_id. Rows without an id, and vectors
    that are null, zero or hold a null or non-finite component, take no part;
    vectors of different lengths never meet. Extra columns, whatever their
    names, don't matter; an empty table gives no rows.
    """
    index = materialize(build_index(vectors, id_col, vector, tables, seed), "ann-index")
    placed = index.select("vec_id", "dim", "vec", F.posexplode("codes").alias("tbl", "bucket"))
    # tables * 2 * dims rows a vector length, whatever the number of vectors
    counts = {(r["dim"], r["tbl"], r["bucket"]): r["n"] for r in placed.groupBy("dim", "tbl", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    asking = index.where(F.col("vec_id") % every == 0) if queries is None else index.join(pick(queries, id_col).select(F.col(id_col).alias("__q")).distinct(), F.col("vec_id") == F.col("__q"), "left_semi")
    asking = asking.dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("query_id"), "dim", "vec")
    probing = materialize(asking.mapInArrow(_probe(counts, probes, min_rows, tables, seed), "query_id long, dim int, vec binary, tbl int, bucket int"), "ann-probes")
    asked = {(r["dim"], r["tbl"], r["bucket"]): r["n"] for r in probing.groupBy("dim", "tbl", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(*key, math.ceil(n / ROW_BLOCK), math.ceil(asked[key] / QUERY_BLOCK)) for key, n in counts.items() if key in asked]
    spark = vectors.sparkSession
    sizes = F.broadcast(spark.createDataFrame(blocks, "dim int, tbl int, bucket int, nr int, nq int"))
    on = ["dim", "tbl", "bucket"]
    mine = F.pmod(F.xxhash64("vec_id"), F.col("nr")).cast("int")
    rows = placed.join(sizes, on).select(*on, mine.alias("rb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "vec_id", "vec")
    mine = F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")
    asks = probing.join(sizes, on).select(*on, F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"), mine.alias("qb"), "query_id", "vec")
    key = [*on, "rb", "qb"]
    found = rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(_rank(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
