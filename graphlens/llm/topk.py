"""Exact top-k search by tiled matrix products.

Queries are cut into blocks of about BLOCK_BYTES and vectors into shards of about SHARD_BYTES, both by
hash. Spark brings every block to every shard (a stated query set against all rows): the rows of a
pair are sorted so that the queries come first, and the vectors stream past them in tiles of TILE_Q
queries by TILE_C vectors. Each tile gives the best k by partial selection, each pair one list per
query, and the lists of FAN shards at a time are merged until one is left: a tree. Nothing is
collected or broadcast.

Components become floor(256 * x) and scores are exact integers: products run in doubles while every
sum stays below 2**50, else in unbounded integers, clipped to the range of a long.

Defined results: vectors that are null or hold a null or non-finite component, and rows without a
vec_id, take no part; vectors are compared with those of their own length only; an id is never its
own neighbour, and repeated rows of a query id are one query (the first vector in order), while
repeated candidates count each; ties go to the smaller vec_id; a query with fewer candidates gets
all of them; empty tables give an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bound_batches, read_table

K = 5
QUERY_EVERY = 50
SCALE = 256.0
#: All vectors are shuffled once for each block of queries, so blocks are as large as a worker can hold.
BLOCK_BYTES = 128 << 20
SHARD_BYTES = 256 << 20
#: Lists that are merged at once.
FAN = 16
#: Most partitions of the pairs of blocks and shards. Shards are streamed and need no memory of their own, so that
#: fewer and larger ones do as well; with more blocks than this a task takes several pairs one after the other.
MAX_PARTITIONS = 20_000
TILE_Q = 1024
TILE_C = 2048
SAFE = float(1 << 50)
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = vectors.select("vec_id", F.col("embedding").alias("v"))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of quantised components) for each length of vector in the column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = []
    for n in np.unique(lengths):
        rows = np.nonzero(lengths == n)[0]
        out.append((int(n), rows, np.floor(SCALE * flat[starts[rows][:, None] + np.arange(n)])))
    return out


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < SAFE:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.array([[min(max(x, NONE + 1), -NONE - 1) for x in row] for row in whole], np.int64)


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row, by score and then by smaller id; NONE marks an empty place."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~x falls as x rises, and has no overflow
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def tile_best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of one tile for each query; ids must ascend."""
    s = tile_scores(q, c)
    s[query_ids[:, None] == ids[None, :]] = NONE
    if s.shape[1] > k:
        if np.abs(s[s != NONE], dtype=float).max(initial=0) < SAFE:
            key = np.where(s == NONE, NONE, s * TILE_C + (TILE_C - 1 - np.arange(s.shape[1])))
            at = np.argpartition(key, -k, axis=1)[:, -k:]
        else:
            at = np.argsort(~s, axis=1, kind="stable")[:, :k]
        return ids[at], np.take_along_axis(s, at, 1)
    return np.broadcast_to(ids, s.shape), s


def pair_plan(blocks: int, shards: int) -> tuple[int, int]:
    """(shards, partitions) for so many blocks and wished shards: at most MAX_PARTITIONS, with a partition a pair where they suffice."""
    shards = max(1, min(shards, MAX_PARTITIONS // blocks))
    return shards, min(blocks * shards, MAX_PARTITIONS)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best k for each query; both frames have vec_id and embedding."""
    bound_batches(vectors.sparkSession)
    q = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    c = usable(vectors)
    many = lambda df, most: max(1, -(-(df.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0) * 8 // most))
    blocks, shards = many(q, block_bytes), max(many(c, shard_bytes), vectors.sparkSession.sparkContext.defaultParallelism)
    shards, partitions = pair_plan(blocks, shards)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = q.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    rows = rows.unionByName(c.select(each(blocks).alias("block"), F.pmod(F.xxhash64("v", "vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "vec_id", "v"))
    rows = rows.repartition(partitions, "block", "shard").sortWithinPartitions("block", "shard", "kind")
    best = rows.mapInArrow(_pairs(k), "query_id long, part int, best array<struct<lost:bigint,vec_id:bigint>>")
    while shards > 1:
        part = F.floor(F.col("part") / FAN).cast("int").alias("part")
        best = best.groupBy("query_id", part).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))  # FAN lists of k
        shards = -(-shards // FAN)
    top = best.select("query_id", F.posexplode("best").alias("at", "x"))
    return top.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.lost")).alias("score"))


class _Lists:
    """The best k so far of the queries of one block in one shard."""

    def __init__(self, k: int):
        self.k, self.rows, self.by_length = k, [], None

    def add(self, b: pa.RecordBatch) -> None:
        self.rows.append(b)

    def meet(self, b: pa.RecordBatch) -> None:
        if self.by_length is None:
            self.by_length = {}
            if self.rows:
                t = pa.Table.from_batches(self.rows).combine_chunks()
                query_ids = t.column("vec_id").combine_chunks().to_numpy()
                for n, rows, m in _matrix(t.column("v").combine_chunks()):
                    self.by_length[n] = (query_ids[rows], m, np.full((len(rows), self.k), -NONE - 1), np.full((len(rows), self.k), NONE))
        all_ids = b.column("vec_id").to_numpy(zero_copy_only=False)
        for n, rows, c in _matrix(b.column("v")):
            if n not in self.by_length:
                continue
            order = np.argsort(all_ids[rows], kind="stable")
            ids, c = all_ids[rows][order], c[order]
            query_ids, q, top_ids, top_scores = self.by_length[n]
            for i in range(0, len(q), TILE_Q):
                for j in range(0, len(c), TILE_C):
                    t_ids, t_scores = tile_best(query_ids[i : i + TILE_Q], q[i : i + TILE_Q], ids[j : j + TILE_C], c[j : j + TILE_C], self.k)
                    top_ids[i : i + TILE_Q], top_scores[i : i + TILE_Q] = merge(np.concatenate([top_ids[i : i + TILE_Q], t_ids], axis=1), np.concatenate([top_scores[i : i + TILE_Q], t_scores], axis=1), self.k)

    def lists(self, shard: int) -> Iterator[pa.RecordBatch]:
        for query_ids, _, ids, scores in (self.by_length or {}).values():
            some = scores != NONE
            pairs = pa.StructArray.from_arrays([pa.array(-scores[some]), pa.array(ids[some])], names=["lost", "vec_id"])
            ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(np.full(len(query_ids), shard, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["query_id", "part", "best"])


def _pairs(k: int):
    """Rows sorted by block, shard and kind: the lists of each pair of block and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, _Lists(k)
        for b in batches:
            keys = [b.column(x).to_numpy(zero_copy_only=False) for x in ("block", "shard", "kind")]
            edges = np.nonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys]))[0] + 1 if b.num_rows > 1 else []
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                block, shard, kind = (int(x[lo]) for x in keys)
                if (block, shard) != now:
                    if now is not None:
                        yield from lists.lists(now[1])
                    now, lists = (block, shard), _Lists(k)
                (lists.meet if kind else lists.add)(b.slice(lo, hi - lo))
        if now is not None:
            yield from lists.lists(now[1])

    return run


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
