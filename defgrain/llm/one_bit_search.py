"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is padded to ``bits`` components, rotated by a random orthogonal matrix and reduced to the
signs. With the correction scalar c = <code, rotated> / |rotated| the inner product with a rotated
query is estimated as <code, query> * |vector| / c, with an error of at most
|vector| |query| sqrt((1 - c^2) / c^2) * EPSILON / sqrt(bits - 1) but for a tiny probability. Only vectors
whose upper bound reaches the k-th best score known are ranked again by the exact inner product.

Queries are a stated set and are searched against all rows in blocks. Every row is coded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

K = 20
EXPANSION = 4  # code bits per component
EPSILON = 3.0
SEED = 42
CHUNK = 65_536  # vectors in a block
QUERY_BLOCK = 4096
_AT_ONCE = 256  # queries whose estimates are held at once; 64 MB with a full block


def code_bits(dim: int) -> int:
    return max(64, -(-EXPANSION * dim // 64) * 64)


def rotation(dim: int) -> np.ndarray:
    """dim columns of a random orthogonal matrix of ``code_bits`` rows."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and the correction scalar c of each vector."""
    turned = vectors @ turn.T
    signs = turned > 0
    norms = np.linalg.norm(turned, axis=1)
    c = np.where(signs, turned, -turned).sum(axis=1) / np.sqrt(turn.shape[0]) / norms
    return np.packbits(signs, axis=1), c


def best(query_ids, queries, ids, vectors, codes, c, k: int = K):
    """(query_id, vec_id, score) of the k nearest rows of a block for each query."""
    turn = rotation(queries.shape[1])
    bits = turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    norms = np.linalg.norm(vectors, axis=1)
    scale = (norms / c / np.sqrt(bits)).astype(np.float32)
    slack = norms * np.sqrt(np.maximum(1 - c * c, 0)) / c * EPSILON / np.sqrt(bits - 1)
    out = []
    for at in range(0, len(queries), _AT_ONCE):
        some = queries[at : at + _AT_ONCE]
        estimates = (some @ turn.T).astype(np.float32) @ signs.T * scale
        for j, q in enumerate(some):
            own = query_ids[at + j]
            upper = estimates[j] + slack * np.linalg.norm(q)
            upper[ids == own] = -np.inf
            # The exact scores of the likeliest rows, of as many as hold k ids, give a threshold that
            # is met, not estimated.
            floor, m = -np.inf, 4 * k
            while True:
                first = np.argpartition(-upper, m)[:m] if m < len(upper) else np.arange(len(upper))
                first = first[upper[first] > -np.inf]
                scores = vectors[first] @ q
                order = np.lexsort((-scores, ids[first]))
                _, heads = np.unique(ids[first][order], return_index=True)
                if len(heads) >= k:
                    floor = np.sort(scores[order][heads])[-k]
                if len(heads) >= k or m >= len(upper):
                    break
                m *= 4
            near = np.flatnonzero((upper >= floor) & (upper > -np.inf))
            exact = vectors[near] @ q
            order = np.lexsort((ids[near], -exact))
            picked, taken = [], set()
            for i in order.tolist():
                vec = int(ids[near[i]])
                if vec not in taken:
                    taken.add(vec)
                    picked.append((int(own), vec, float(exact[i])))
                    if len(picked) == k:
                        break
            out += picked
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) for rows with an id and a finite, non-zero vector."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        .where(~bad & F.exists(v, lambda x: x != 0))
        .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(len(column), -1)


def encoded(rows: DataFrame) -> DataFrame:
    """Adds dim, code and c to (vec_id, vec)."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                codes, c = encode(_matrix(part.column(1)), rotation(int(dim)))
                packed = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.record_batch(
                    [*part.columns, pa.array(np.full(len(c), dim), pa.int32()), packed, pa.array(c)],
                    names=["vec_id", "vec", "dim", "code", "c"],
                )

    return rows.mapInArrow(run, "vec_id long, vec array<double>, dim int, code binary, c double")


def blocked(queries: DataFrame, rows: DataFrame, chunks: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Each query once a chunk of rows, and each row once a block of queries, dealt by ``place``."""
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    chunk = F.pmod("place", F.lit(chunks)).cast("int").alias("chunk")
    block = F.pmod("place", F.lit(blocks)).cast("int").alias("block")
    return queries.select("dim", every_chunk, block, "vec_id", "vec"), rows.select("dim", chunk, every_block, "vec_id", "vec", "code", "c")


def search(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K
) -> DataFrame:
    """The ``k`` nearest rows (query_id, rank, vec_id, score) of each row whose id is divisible by
    ``every``, against every row but the query's own; all, if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without id. Vectors of different length are not compared. A repeated vec_id is one candidate
    with its best score, and one query. Ties go to the smaller vec_id; other columns are ignored; an
    empty table gives an empty result."""
    # A written number spreads the rows, whatever their ids and vectors are; it stays if a task runs again.
    rows = encoded(usable(vectors, id_col, vec_col)).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    rows = stage(rows, "codes")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("dim", "vec_id", "vec").agg(F.min("place").alias("place"))
    queries = stage(queries, "queries")
    # As many blocks as there are cores, for small tables; blocks of bounded size for large ones.
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // CHUNK), min(cores, n // 1024))
    queries, targets = blocked(queries, rows, chunks, max(1, -(-queries.count() // QUERY_BLOCK)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
            found = best(
                np.asarray(left["vec_id"]),
                _matrix(left["vec"]),
                np.asarray(right["vec_id"]),
                _matrix(right["vec"]),
                codes,
                np.asarray(right["c"]),
                k,
            )
        q, v, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["dim", "chunk", "block"]
    near = queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    single = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
