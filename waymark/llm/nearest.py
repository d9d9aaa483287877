"""Approximate nearest neighbours by largest inner product, along shifted Hilbert curves.

Vectors are scaled into the unit ball and lifted onto the sphere, where the largest inner product is the least distance. Each of
CURVES random projections to DIMS dimensions, shifted by an offset of its own, gives every vector a Hilbert key. A curve's keys
are range-partitioned in blocks of near equal numbers; a query visits the blocks within REACH (a share of all rows) on both
sides of its own key, and the best of all blocks and curves are merged and ranked by exact products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

CURVES = 4
DIMS = 6
KEY_BITS = 8
#: Share of all rows that a query sees on each side of its key. Directions without structure, the hardest case, need this much.
REACH = 0.24
#: Blocks of a curve, unless they would hold fewer than LEAST_ROWS rows, so that every window has candidates enough, or more than BLOCK_ROWS.
BLOCKS = 16
LEAST_ROWS = 256
BLOCK_ROWS = 50_000
SEED = 11


def hilbert(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Hilbert index of rows of unsigned coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, longest: float, curves: int = CURVES, query: bool = False) -> np.ndarray:
    """A key per curve of each row. Rows are scaled by the longest norm and lifted; queries to unit length, without a lift."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / (norm if query else longest)
    lift = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
    full = np.concatenate([flat, lift], axis=1)
    out = []
    for c in range(curves):
        rng = np.random.default_rng([SEED, c])
        axes, _ = np.linalg.qr(rng.normal(size=(full.shape[1], min(DIMS, full.shape[1]))))
        shift = rng.uniform(-0.5, 0.5, axes.shape[1])
        at = (full @ axes) * math.sqrt(full.shape[1]) / 3 + shift / (1 << 2)
        out.append(hilbert(np.clip((at + 1.25) / 2.5 * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1)))
    return np.stack(out, axis=1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that take part: an id, and a vector of finite numbers other than zero, of the length most have: those of another length have no inner product with them."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(ok)
    size = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.filter(F.size("v") == F.lit(size.d if size else 0))


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, reach: float = REACH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest found, ties to the smaller id.

    is_query: a condition on vec_id. Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do rows
    without an id; rows that repeat id and vector count once. Of equal vectors only the k + 1 smallest ids can be a result,
    so large groups of copies are cut to that first. No usable rows give no result; further columns are left out.
    """
    spark = rows.sparkSession
    all_ = usable(rows, id_col, vector_col).dropDuplicates(["vec_id", "v"])
    # the limit of the rank works before the shuffle too, so a vector that very many rows have never meets in one task
    few = all_.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("vec_id", "v", F.lit(False).alias("query"))
    every = written(few.unionByName(all_.filter(is_query(F.col("vec_id"))).select("vec_id", "v", F.lit(True).alias("query"))), "vectors")
    stats = every.filter("not query").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    n, longest, width = stats.n, math.sqrt(stats.m or 1.0) * (1 + 1e-12), stats.d or 1
    blocks = max(1, min(BLOCKS, n // LEAST_ROWS), math.ceil(n / BLOCK_ROWS))
    side = math.ceil(reach * blocks)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def keyed(batches):
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            for query in (False, True):
                use = np.flatnonzero(asks == query)
                if len(use):
                    part = batch.take(pa.array(use))
                    key = curve_keys(matrix(part.column(1)), longest, curves, query)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), curves).cast(pa.list_(pa.int64()))], names=["vec_id", "v", "query", "keys"])

    found = written(every.select("vec_id", "v", "query").mapInArrow(keyed, "vec_id long, v array<double>, query boolean, keys array<long>"), "curve_keys")
    probs = [i / blocks for i in range(1, blocks)] or [0.5]
    bounds = found.filter("not query").agg(*(F.percentile_approx(F.element_at("keys", c + 1), probs, 10_000) for c in range(curves))).first()
    cuts = [np.array(b if b is not None else [0])[: blocks - 1] for b in bounds]

    def dealt(batches):
        for batch in batches:
            keys = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, curves)
            query = batch.column(2).to_numpy(zero_copy_only=False)
            for c in range(curves):
                own = np.searchsorted(cuts[c], keys[:, c])
                for step in range(-side, side + 1):
                    use = np.flatnonzero((query | (step == 0)) & (own + step >= 0) & (own + step < blocks))
                    if len(use):
                        yield pa.RecordBatch.from_arrays([pa.array(c * blocks + own[use] + step, pa.int64()), *(batch.column(i).take(pa.array(use)) for i in (2, 0, 1))], names=["block", "query", "vec_id", "v"])

    def ranked(batches):
        """A block's rows come first and are held, BLOCK_ROWS or so; its queries stream past them."""
        block, ids, x, names, points = None, [], [], None, None

        def best(q_ids, q):
            near = q @ points.T
            near[q_ids[:, None] == names[None, :]] = -np.inf
            at = max(0, near.shape[1] - k)
            least = np.partition(near, at, axis=1)[:, at]
            out = []
            for i in range(len(q_ids)):
                use = np.flatnonzero(near[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) if np.isfinite(least[i]) else np.flatnonzero(np.isfinite(near[i]))
                exact = (points[use] * q[i]).sum(axis=1)
                top = np.lexsort((names[use], -exact))[:k]
                out.append((np.full(len(top), q_ids[i]), names[use][top], exact[top]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (asks[1:] != asks[:-1])) + 1, [len(at)]]).tolist() if len(at) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if at[a] != block:
                    block, ids, x, names = at[a], [], [], None
                part = batch.slice(a, b - a)
                own, vectors = part.column(2).to_numpy(), matrix(part.column(3))
                if not asks[a]:
                    ids.append(own)
                    x.append(vectors)
                elif ids:
                    if names is None:
                        names, points = np.concatenate(ids), np.concatenate(x)
                    for i in range(0, len(own), 256):
                        yield best(own[i : i + 256], vectors[i : i + 256])

    spread = found.mapInArrow(dealt, "block long, query boolean, vec_id long, v array<double>")
    tasks = max(12, min(curves * blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = spread.repartition(tasks, "block").sortWithinPartitions("block", "query").mapInArrow(ranked, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir):
    """The 20 nearest of every twentieth vector."""
    from .store import table

    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
