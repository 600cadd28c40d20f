"""Exact top-k search by inner product with vector-approximation files.

Component x of a vector becomes the integer floor(scale * x). The approximation of a vector holds, for each
dimension, the number of one of 2 ** bits equal cells of the dimension's range over all vectors. From a cell's
middle and half width a product with a query is known up to an error, so each query has an upper and a lower
bound for every vector. A block is scanned by its approximations; vectors whose upper bound is below the kth
largest lower bound, or the kth exact score so far, are out; the others' exact components are read in order of
their upper bounds until no unread one can reach the kth score. Ties go to the smaller id, so equal bounds are
still read.

Candidates and queries are cut into blocks bounded by bytes, and each pair of blocks is a task's unit with its
own exact top k; within it tiles of candidates are scanned one after the other, and the kth score so far bounds the
next. The best k of all units follow by a window over at most k rows a unit. A table that fits one block of queries is
sent once, whatever its number of candidates. The work is that of queries times candidates, which no exact search
avoids in the worst case; no task holds more than two blocks.

Vectors with an integer that leaves +-2**24 (below it sums stay exact in doubles up to 2**5 dimensions of that size,
and in general while they are below 2**53) take part through blocks of their own, each compared whole with every
block of the other side in int64, or in Python's integers where a sum could leave that. A score among a query's best
that is no 64-bit integer fails the job, as it does in SQL.

Vectors that are null, empty, of another length than the most, or with null or non-finite components take no part:
vectors of different lengths have no inner product. Rows that repeat an id are candidates each, and no candidates
for that id's query; a repeated query id gives its rows once. A null id takes no part. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table, shuffle_partitions

BITS = 6
#: Bytes of a block's exact components at most.
CANDIDATE_BYTES = 16 << 20
QUERY_BYTES = 8 << 20
#: Rows of a block: candidates as many or more, where a table has enough for all cores; queries at most.
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1 << 15
#: Queries and candidates whose bounds are held at once.
QUERY_TILE = 512
CANDIDATE_TILE = 4096
LIMIT = 1 << 24


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, d, q, x``: the vectors that take part and their lengths, as integers ``q`` or, if one of these is too large, as doubles ``x``."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    small = F.forall("x", lambda x: F.abs(x) * scale < LIMIT)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))
    ints = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x)).cast("array<int>")
    return rows.select("id", F.size("x").alias("d"), F.when(small, ints).alias("q"), F.when(~small, F.col("x")).alias("x"))


def _blocks(dims: int, low: np.ndarray, width: np.ndarray):
    """Rows of a partition (block, id, q) in order of block -> a row for each block: ids, cell numbers, exact components."""

    def out(block, ids, vectors):
        v = np.array(vectors, dtype=np.int32).reshape(len(ids), dims)
        cells = np.minimum((v - low) // width, (1 << BITS) - 1).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["block", "ids", "cells", "exact"])

    def run(batches):
        now, ids, vectors = None, [], []
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for i, (block, id_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if block != now and ids:
                    yield out(now, ids, vectors)
                    ids, vectors = [], []
                now = block
                ids.append(id_)
                vectors.append(flat[i])
        if ids:
            yield out(now, ids, vectors)

    return run


def block_top_k(query_ids, queries, ids, cells, exact, low, width, k):
    """Exact best k of a block, its ids in order, for each query: arrays (query id, id, score)."""
    out = []
    for at in range(0, len(query_ids), QUERY_TILE):
        own, q = query_ids[at : at + QUERY_TILE], queries[at : at + QUERY_TILE].astype(np.float64)
        best = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(own)
        for start in range(0, len(ids), CANDIDATE_TILE):
            tile = slice(start, start + CANDIDATE_TILE)
            _scan_tile(own, q, ids[tile], cells[tile], exact[tile], low, width, k, best)
        out += [(np.full(len(i), own[r]), i, s.astype(np.int64)) for r, (s, i) in enumerate(best)]
    return [np.concatenate(x) if out else np.empty(0, dtype=np.int64) for x in (list(zip(*out)) or [()] * 3)]


def _scan_tile(query_ids, q, ids, cells, exact, low, width, k, best):
    """Betters each query's ``best`` (scores, ids) by a tile's candidates."""
    middle = (low + (cells.astype(np.float64) + 0.5) * width - 0.5).astype(np.float64)
    about, error = q @ middle.T, (np.abs(q) @ ((width - 1) / 2.0))[:, None]
    upper, lower = about + error, about - error
    for_self = np.searchsorted(ids, query_ids)
    for_self_end = np.searchsorted(ids, query_ids, side="right")
    n = len(ids)
    for r in range(len(query_ids)):
        up, down = upper[r], lower[r]
        if for_self[r] < for_self_end[r]:
            own = slice(for_self[r], for_self_end[r])
            up[own] = down[own] = -np.inf
        scores, found = best[r]
        kth = scores[-1] if len(scores) == k else -np.inf  # ties with the kth score are still read
        bound = max(kth, np.partition(down, n - k)[n - k] if n > k else -np.inf)
        left = np.flatnonzero((up >= bound) & (up > -np.inf))
        left = left[np.argsort(-up[left], kind="stable")]
        read = 0
        while read < len(left) and up[left[read]] >= kth:
            step = left[read : read + max(k, 32)]
            scores = np.concatenate((scores, exact[step].astype(np.float64) @ q[r]))
            found = np.concatenate((found, ids[step]))
            read += len(step)
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        first = np.lexsort((found, -scores))[:k]
        best[r] = scores[first], found[first]


def _search(dims: int, low: np.ndarray, width: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            for qi, qx, ci, cc, cx in zip(*(batch.column(i) for i in range(5))):
                query_ids, queries = np.frombuffer(qi.as_py(), dtype=np.int64), np.frombuffer(qx.as_py(), dtype=np.int32).reshape(-1, dims)
                ids = np.frombuffer(ci.as_py(), dtype=np.int64)
                cells, exact = np.frombuffer(cc.as_py(), dtype=np.uint8).reshape(-1, dims), np.frombuffer(cx.as_py(), dtype=np.int32).reshape(-1, dims)
                order = np.argsort(ids, kind="stable")
                found = block_top_k(query_ids, queries, ids[order], cells[order], exact[order], low, width, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def _wide_blocks(batches):
    """Rows (block, id, x), a block's in one task and in order -> a row for each block: ids, components."""

    def out(block, ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], names=["block", "ids", "wide"])

    now, ids, vectors = None, [], []
    for batch in batches:
        for block, id_, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if block != now and ids:
                yield out(now, ids, vectors)
                ids, vectors = [], []
            now = block
            ids.append(id_)
            vectors.append(np.array(x.as_py(), dtype=np.float64))
    if ids:
        yield out(now, ids, vectors)


def integers(exact: bytes | None, wide: bytes | None, dims: int, scale: int) -> np.ndarray:
    """The integers of a block, as int64 or else as Python's."""
    if wide is None:
        return np.frombuffer(exact, dtype=np.int32).reshape(-1, dims).astype(np.int64)
    x = np.frombuffer(wide, dtype=np.float64).reshape(-1, dims)
    if np.abs(x).max() < 2.0**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    # a double from 2 ** 53 on is an integer
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()], dtype=object)


def wide_top_k(query_ids, queries, ids, vectors, k):
    """Exact best k of a block for each query, every candidate scored; a score below all longs is None, one above them an error."""
    largest = [max(abs(int(a.min())), abs(int(a.max()))) for a in (queries, vectors)]
    if largest[0] * largest[1] * queries.shape[1] >= 1 << 63:
        queries, vectors = queries.astype(object), vectors.astype(object)
    out_q, out_i, out_s = [], [], []
    for query_id, q in zip(query_ids.tolist(), queries):
        at = np.flatnonzero(ids != query_id)
        scores = (vectors[at] @ q).tolist() if len(at) else []
        best = heapq.nsmallest(k, zip([-s for s in scores], ids[at].tolist()))
        for minus, i in best:
            if -minus >= 1 << 63:
                raise OverflowError(f"the score of query {query_id} and vector {i} is no 64-bit integer: {-minus}")
            out_q.append(query_id)
            out_i.append(i)
            out_s.append(-minus if minus <= 1 << 63 else None)
    return out_q, out_i, out_s


def _wide_search(dims: int, k: int, scale: int):
    def run(batches):
        for batch in batches:
            for qi, qx, qw, ci, cx, cw in zip(*(batch.column(i) for i in range(6))):
                query_ids, ids = np.frombuffer(qi.as_py(), dtype=np.int64), np.frombuffer(ci.as_py(), dtype=np.int64)
                found = wide_top_k(query_ids, integers(qx.as_py(), qw.as_py(), dims, scale), ids, integers(cx.as_py(), cw.as_py(), dims, scale), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query row; ``is_query`` is a condition on ``id``."""
    spark = df.sparkSession
    vectors = valid_vectors(df, id_col, vector_col, scale)
    sizes = vectors.groupBy("d").agg(F.count("*").alias("n"), F.count("x").alias("wide")).orderBy(F.desc("n"), F.desc("d")).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sizes is None:
        return nothing
    dims, n, n_wide = sizes
    vectors = vectors.where(F.col("d") == dims).drop("d")
    vectors = cut(vectors if n_wide else vectors.drop("x"), "op8-vectors")
    query_rows = vectors.where(is_query).dropDuplicates(["id"])
    if n_wide:
        query_rows = cut(query_rows, "op8-queries")  # one choice among repeated ids
    n_queries = query_rows.count()
    if not n_queries:
        return nothing
    n_wide_queries = query_rows.where("x is not null").count() if n_wide else 0
    spans = vectors.agg(*[f(F.col("q")[i]) for f in (F.min, F.max) for i in range(dims)]).first() if n > n_wide else (0,) * (2 * dims)
    low, high = np.array(spans[:dims], dtype=np.int64), np.array(spans[dims:], dtype=np.int64)
    width = np.maximum(-(-(high - low + 1) // (1 << BITS)), 1)

    def packed(rows: DataFrame, per_block: int, count: int, col: str = "q") -> tuple[DataFrame, int]:
        blocks = max(1, -(-count // per_block))
        dealt = rows.select(F.pmod(F.xxhash64("id", col), F.lit(blocks)).alias("block"), "id", col).repartition(min(blocks, 8 * shuffle_partitions(spark)), "block").sortWithinPartitions("block", "id")
        made = dealt.mapInArrow(_wide_blocks, "block long, ids binary, wide binary") if col == "x" else dealt.mapInArrow(_blocks(dims, low, width), "block long, ids binary, cells binary, exact binary")
        return cut(made, "op8-blocks"), blocks

    def crossed(queries: DataFrame, q_blocks: int, candidates: DataFrame, c_blocks: int) -> DataFrame:
        left = queries.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "block"])
        right = candidates.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), F.col("block").alias("cb"), *[F.col(c).alias(f"c_{c}") for c in candidates.columns if c != "block"])
        return left.join(right, ["qb", "cb"])

    narrow = lambda rows: rows.where("q is not null") if n_wide else rows
    most, most_queries = max(1, CANDIDATE_BYTES // (4 * dims)), max(1, min(QUERIES_PER_BLOCK, QUERY_BYTES // (4 * dims)))
    tasks = 2 * spark.sparkContext.defaultParallelism
    candidates = packed(narrow(vectors), min(most, max(CANDIDATES_PER_BLOCK, -(-n // tasks))), n - n_wide)
    queries = packed(narrow(query_rows), most_queries, n_queries - n_wide_queries)
    units = crossed(*queries, *candidates).select("q_ids", "q_exact", "c_ids", "c_cells", "c_exact")
    found = units.mapInArrow(_search(dims, low, width, k), "query_id long, vec_id long, score long")
    if n_wide:
        wide_candidates = packed(vectors.where("x is not null"), max(1, most // 2), n_wide, "x")
        wide_queries = packed(query_rows.where("x is not null"), max(1, most_queries // 2), n_wide_queries, "x")
        for q, c in ((wide_queries, wide_candidates), (wide_queries, candidates), (queries, wide_candidates)):
            units = crossed(*q, *c)
            units = units.select(*[F.col(x) if x in units.columns else F.lit(None).cast("binary").alias(x) for x in ("q_ids", "q_exact", "q_wide", "c_ids", "c_exact", "c_wide")])
            found = found.unionByName(units.mapInArrow(_wide_search(dims, k, scale), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return found.withColumn("score", F.coalesce("score", F.raise_error(F.lit("a score is no 64-bit integer")).cast("long"))) if n_wide else found


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
