"""Exact top-k search by inner product: the threshold algorithm over sorted lists, one list per dimension of a block of vectors.

Each scan partition cuts its vectors into blocks and sorts every dimension of a block once; the blocks are a written table.
A query walks the lists of the dimensions where its weight is not 0, from the end that its sign prefers, scores what it meets
by random access, and stops when no vector below the reached depth can have the kth score. Nothing is left out by that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslane.llm.common import scratch, small_batches, table, to_batch
from crosslane.session import broadcast_if

# Vectors of one block: places are 16-bit numbers, and a block is what a task holds at once.
BLOCK_ROWS = 4096
# Queries that meet a block together.
QUERY_ROWS = 256
# Entries of each list that the first step reads; every further step doubles the depth.
FIRST_DEPTH = 16
# Query blocks whose kth scores a task carries from one block to the next.
CARRIED = 64
SCALE = 1024.0

BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("dims", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("values", pa.binary()),
        ("lists", pa.binary()),
    ]
)
BLOCK_DDL = "block long, dims int, ids array<long>, values binary, lists binary"
QUERY = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("dims", pa.int32()), ("weights", pa.binary())])
QUERY_DDL = "query_key long, query_id long, dims int, weights binary"
HIT = pa.schema(
    [("query_key", pa.int64()), ("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)
HIT_DDL = "query_key long, query_id long, key long, vec_id long, score long"


def quantised(ids: pa.Array, vectors: pa.Array, scale: float = SCALE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix of floor(scale * x)) per length of the vectors that are whole: no null, no component null or not finite."""
    whole = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    offsets = np.concatenate(([0], np.cumsum(np.where(whole, vectors.value_lengths().fill_null(0).to_numpy(), 0))))
    numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
    whole &= broken[offsets[1:]] == broken[offsets[:-1]]
    lengths = offsets[1:] - offsets[:-1]
    for dims in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == dims))
        matrix = np.floor(scale * numbers[offsets[rows][:, None] + np.arange(dims)])
        largest = np.abs(matrix).max(initial=0.0)
        if largest * largest * max(dims, 1) >= 2.0**62:
            raise ValueError(f"components up to {largest:g} in {dims} dimensions: inner products can pass 64 bits")
        yield ids.take(pa.array(rows)), matrix.astype(np.int64)


def to_blocks(batches: Iterator[pa.RecordBatch], scale: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``block_rows`` vectors of one length, with their sorted lists; numbered by partition and place."""
    held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
    # 24 bits for the blocks of a partition and, in the keys of rows, 16 for the place in a block.
    number = TaskContext.get().partitionId() << 24

    def block(dims: int, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        ids = pa.concat_arrays([i for i, _ in held[dims]])
        matrix = np.concatenate([m for _, m in held[dims]])
        start = 0
        while len(ids) - start >= block_rows or (last and start < len(ids)):
            part = matrix[start : start + block_rows]
            lists = np.argsort(part, axis=0, kind="stable").astype(np.uint16)
            yield to_batch(
                [(number, dims, ids[start : start + len(part)].to_pylist(), packed(part), np.ascontiguousarray(lists.T).tobytes())],
                BLOCK,
            )
            number += 1
            start += len(part)
        held[dims] = [(ids[start:], matrix[start:])]

    for batch in batches:
        for ids, matrix in quantised(batch.column(0), batch.column(1), scale):
            dims = matrix.shape[1]
            held.setdefault(dims, []).append((ids, matrix))
            if sum(len(i) for i, _ in held[dims]) >= block_rows:
                yield from block(dims, last=False)
    for dims in list(held):
        yield from block(dims, last=True)


def packed(matrix: np.ndarray) -> bytes:
    """The numbers at the width that the largest needs, led by that width in bytes."""
    largest = np.abs(matrix).max(initial=0)
    width = next(w for w in (2, 4, 8) if largest < 1 << (8 * w - 1))
    return bytes([width]) + np.ascontiguousarray(matrix).astype(f"<i{width}").tobytes()


def unpacked(raw: bytes, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).reshape(rows, dims).astype(np.int64)


def build_index(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, str]:
    """The table of blocks, written to the shared folder, and its path. Every vector that is whole is in one block.

    No shuffle: a partition's vectors make its blocks. A block of another length of vectors is a block of its own.
    """
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("block_rows must be in 1..65536")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    return scratch(rows.mapInArrow(lambda batches: to_blocks(batches, scale, block_rows), BLOCK_DDL), "topk-blocks")


def queries_of(index: DataFrame, every: int) -> DataFrame:
    """The vectors of the index whose id is divisible by ``every``, as queries with the key of their own row."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dims, ids, values, _ in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                matrix = unpacked(values, dims, len(ids))
                rows = [
                    ((block << 16) | n, i, dims, packed(matrix[n])) for n, i in enumerate(ids) if i is not None and i % every == 0
                ]
                if rows:
                    yield to_batch(rows, QUERY)

    return index.mapInArrow(pick, QUERY_DDL)


class Block:
    """The vectors of one block, their sorted lists and the values along them."""

    def __init__(self, number: int, dims: int, ids: list[int | None], values: bytes, lists: bytes):
        n = len(ids)
        self.number, self.dims, self.n = number, dims, n
        self.values = unpacked(values, dims, n)
        self.largest = int(np.abs(self.values).max(initial=0))
        self.exact = self.values.astype(np.float64)
        self.lists = np.frombuffer(lists, dtype=np.uint16).reshape(dims, n)
        self.along = np.take_along_axis(self.values.T, self.lists.astype(np.int64), axis=1)
        self.unnamed = np.array([i is None for i in ids], dtype=bool)
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)

    def scores(self, rows: np.ndarray, weights: np.ndarray, as_double: bool) -> np.ndarray:
        if as_double:
            return (self.exact[rows] @ weights.astype(np.float64)).astype(np.int64)
        return self.values[rows] @ weights

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best in ``rows``: score down, named before unnamed, id up."""
        if len(rows) > k:
            kept = np.flatnonzero(scores >= np.partition(scores, len(rows) - k)[len(rows) - k])
        else:
            kept = np.arange(len(rows))
        order = np.lexsort((rows[kept], self.ids[rows[kept]], self.unnamed[rows[kept]], -scores[kept]))
        return kept[order[:k]]

    def search(self, weights: np.ndarray, own: int | None, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, depth): the k best rows but ``own``, where they reach ``floor``, and how deep the lists were read."""
        used = np.flatnonzero(weights)
        w = weights[used]
        as_double = float(self.largest) * float(np.abs(weights).max(initial=0)) * max(self.dims, 1) < 2.0**53
        up = w > 0
        seen = np.zeros(self.n, dtype=bool)
        if own is not None:
            seen[own] = True
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        depth = 0
        while depth < self.n:
            start, depth = depth, min(self.n, max(FIRST_DEPTH, 2 * depth))
            if len(used) and depth < self.n:
                met = np.zeros(self.n, dtype=bool)
                met[self.lists[used[up], self.n - depth : self.n - start]] = True
                met[self.lists[used[~up], start:depth]] = True
                fresh = np.flatnonzero(met & ~seen)
            else:
                depth = self.n
                fresh = np.flatnonzero(~seen)
            seen[fresh] = True
            places = np.concatenate((places, fresh))
            scores = np.concatenate((scores, self.scores(fresh, weights, as_double)))
            kept = self.best(places, scores, k)
            places, scores = places[kept], scores[kept]
            if depth == self.n:
                break
            # No vector deeper in every list can pass this; one that only ties could have the smaller id.
            reach = int(w[up] @ self.along[used[up], self.n - depth]) + int(w[~up] @ self.along[used[~up], depth - 1])
            kth = int(scores[-1]) if len(scores) >= k else None
            bar = max((b for b in (kth, floor) if b is not None), default=None)
            if bar is not None and bar > reach:
                break
        if floor is not None:
            good = scores >= floor
            places, scores = places[good], scores[good]
        return places, scores, depth


def search_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query of the query blocks it meets; kth scores carry over to a task's next block."""
    block: Block | None = None
    carried: dict[tuple[int, int], np.ndarray] = {}
    known: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        for number, dims, ids, values, lists, q_block, queries in zip(
            *(batch.column(c) for c in range(7)), strict=True
        ):
            if block is None or block.number != number.as_py():
                block = Block(number.as_py(), dims.as_py(), ids.as_py(), values.as_py(), lists.as_py())
            asked = sorted(queries.as_py(), key=lambda q: q["query_key"])
            q_block = (block.dims, q_block.as_py())
            if q_block not in carried and len(carried) >= CARRIED:
                carried.clear()
                known.clear()
            floors = carried.setdefault(q_block, np.zeros(len(asked), dtype=np.int64))
            sure = known.setdefault(q_block, [False] * len(asked))
            rows = []
            for n, q in enumerate(asked):
                weights = unpacked(q["weights"], block.dims, 1)[0]
                own = q["query_key"] & 0xFFFF if q["query_key"] >> 16 == block.number else None
                floor = int(floors[n]) if sure[n] else None
                places, scores, _ = block.search(weights, own, k, floor)
                if len(scores) >= k:
                    floors[n], sure[n] = scores[-1], True
                for place, score in zip(places.tolist(), scores.tolist(), strict=True):
                    named = None if block.unnamed[place] else int(block.ids[place])
                    rows.append((q["query_key"], q["query_id"], (block.number << 16) | place, named, score))
            if rows:
                yield to_batch(rows, HIT)


def top_k(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each vector whose id is divisible by ``every`` the k other rows of largest inner product.

    Components become floor(scale * x); scores are exact integers, and vectors whose products could pass 64 bits raise. Ties
    go to the smaller id, then to named before unnamed rows, then to the row's place in the index. A vector that is null or
    holds a null or non-finite component takes no part; an empty one has score 0 with other empty ones. Vectors of different
    lengths do not meet. A null id is a candidate but no query. Rows that repeat an id are rows of their own: each is a query
    and a candidate of the others. Fewer than k other rows: all of them. Empty tables give no rows. Only ``key`` and
    ``vector`` are read, so further columns cannot clash.

    The queries are dealt into blocks and each meets each block of the index: by broadcast where they are few, else by a
    shuffle of the blocks. A task holds one block and one query block; a query's answers are cut to k in every task.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    index, index_path = build_index(vectors, key, vector, scale, block_rows)
    asked, asked_path = scratch(queries_of(index, every), "topk-queries")
    count = asked.count()
    blocks = max(1, -(-count // query_rows))
    dealt = asked.groupBy("dims", F.pmod(F.xxhash64("query_key"), F.lit(blocks)).cast("int").alias("q_block")).agg(
        F.collect_list(F.struct("query_key", "query_id", "weights")).alias("queries")
    )
    spread = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = spread.join(broadcast_if(dealt, count), ["dims", "q_block"]).select(
        "block", "dims", "ids", "values", "lists", "q_block", "queries"
    )
    hits = met.mapInArrow(lambda batches: search_blocks(batches, k), HIT_DDL)
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("key"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every 100th vector of ``embeddings`` among all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r AS cr, list_inner_product(q.c, c.c)::BIGINT AS score
  FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.c) = len(c.c)),
t AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM t WHERE rank <= 10
"""
