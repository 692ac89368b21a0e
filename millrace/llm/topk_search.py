"""Exact top-k by inner product: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import cut, sliced

#: Bytes of a block of queries or a shard of candidates, rows of one tile of candidates, scores of one product, and lists merged at once.
BLOCK_BYTES, TILE, CELLS, FAN = 16 << 20, 4096, 1 << 21, 16
_LIST = pa.schema([(c, pa.int64()) for c in ("number", "query_id", "vec_id", "score")])
_EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty of meaning: no null, NaN or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as integers, floor(scale * x) of x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _product(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can pass 2**53, else in Python integers."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(tile)), np.int64)
    reach = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(tile.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if reach < _EXACT:
        return (queries.astype(np.float64) @ tile.astype(np.float64).T).astype(np.int64)
    return (queries.astype(object) @ tile.astype(object).T).astype(np.int64)  # raises OverflowError if a score isn't a long


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id, best first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


class Best:
    """The k best candidates of each of some queries of one dimension."""

    def __init__(self, numbers: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int):
        self.numbers, self.own, self.vectors, self.k = numbers, own, vectors, k
        # free places hold the query's own id, which isn't emitted
        self.ids, self.scores = np.repeat(own[:, None], k, axis=1), np.zeros((len(own), k), np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in candidates, by products of at most CELLS scores: tiles of candidates with slabs of queries."""
        for begin in range(0, len(ids), TILE):
            tile = ids[begin : begin + TILE]
            slab = max(1, CELLS // len(tile))
            for first in range(0, len(self.own), slab):
                self._enter(first, _product(self.vectors[first : first + slab], vectors[begin : begin + TILE]), tile)

    def _enter(self, first: int, score: np.ndarray, ids: np.ndarray) -> None:
        mine = slice(first, first + len(score))
        # only queries with a score that can enter their list are looked at
        full = self.ids[mine, -1] != self.own[mine]
        enters = (score.max(axis=1) >= np.where(full, self.scores[mine, -1], np.iinfo(np.int64).min)) if score.size else np.zeros(0, bool)
        for i in np.flatnonzero(enters).tolist():
            at = first + i
            held, other = self.ids[at] != self.own[at], ids != self.own[at]
            s = np.concatenate([self.scores[at][held], score[i][other]])
            d = np.concatenate([self.ids[at][held], ids[other]])
            top = _best(s, d, self.k)
            self.ids[at], self.scores[at] = self.own[at], 0
            self.ids[at, : len(top)], self.scores[at, : len(top)] = d[top], s[top]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(self.own, self.k)
        real = self.ids.ravel() != query
        columns = [np.repeat(self.numbers, self.k)[real], query[real], self.ids.ravel()[real], self.scores.ravel()[real]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["number", "query_id", "vec_id", "score"])


def _by_dimension(batch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of an Arrow batch or table with list column v: dimension -> its rows and their vectors."""
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        out[int(dim)] = (rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), int(dim)))
    return out


def _started(queries: pa.Table, k: int) -> dict[int, Best]:
    number, own = (queries.column(c).to_numpy() for c in ("number", "vec_id"))
    return {dim: Best(number[rows], own[rows], vectors, k) for dim, (rows, vectors) in _by_dimension(queries).items()}


def _selector(block, k: int):
    """Each task keeps k candidates for each query of the block and emits them at its end."""

    def select(batches):
        kept = _started(block.value, k)
        for batch in sliced(batches, TILE):
            ids = batch.column("vec_id").to_numpy()
            for dim, (rows, vectors) in _by_dimension(batch).items():
                if dim in kept:
                    kept[dim].offer(ids[rows], vectors)
        for best in kept.values():
            yield best.rows()

    return select


def _cell(k: int):
    def select(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kept, ids = _started(queries, k), candidates.column("vec_id").to_numpy()
        for dim, (rows, vectors) in _by_dimension(candidates).items():
            if dim in kept:
                kept[dim].offer(ids[rows], vectors)
        return pa.Table.from_batches([best.rows() for best in kept.values()], _LIST)

    return select


def _bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0


def _grid(candidates: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    """Partial lists of any number of queries: blocks of queries meet shards of candidates, each of about BLOCK_BYTES, in the cells of a grid.

    Rows are dealt by a number of their own, so that repeated ones don't meet in one shard.
    """
    numbered = cut(candidates.withColumn("number", F.monotonically_increasing_id()))
    shards, many = (F.lit(-(-n // BLOCK_BYTES)) for n in (max(_bytes(numbered), 1), size))
    deal = lambda n: F.pmod(F.xxhash64("number"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = queries.select("number", "vec_id", "v", deal(many).alias("block"), every(shards).alias("shard"))
    right = numbered.select("vec_id", "v", deal(shards).alias("shard"), every(many).alias("block"))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_cell(k), "number long, query_id long, vec_id long, score long")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """Merge partial lists in two levels: of up to FAN groups of tasks each, then of the groups."""
    order = [F.desc("score"), F.asc("vec_id")]
    some = W.partitionBy("number", "part").orderBy(*order)
    lists = lists.withColumn("part", F.spark_partition_id() % FAN).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest integer inner product for each query.

    vectors and queries have vec_id and embedding. Candidates are all usable rows of vectors but those
    with the query's own vec_id; ties go to the smaller vec_id. Vectors that are null, or hold a null or non-finite component, take no part;
    vectors of different lengths aren't compared. Rows with a null vec_id take no part either. Repeated
    candidate rows count each; repeated query rows get a list each; other columns are ignored; empty tables give no rows. Queries of
    up to BLOCK_BYTES in all are broadcast, and candidates stay where they are read: a task multiplies tile by
    tile and holds k candidates a query. More queries meet the candidates in a grid of
    blocks and shards, without the driver. No product in a task has more than CELLS scores.
    """
    v = scaled(F.col("embedding"), scale).alias("v")
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    candidates = vectors.where(good).select(F.col("vec_id").cast("long"), v)
    spark = vectors.sparkSession
    asked = cut(queries.where(good).select(F.col("vec_id").cast("long"), v).withColumn("number", F.monotonically_increasing_id()))
    size = _bytes(asked)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size <= BLOCK_BYTES:
        shared = spark.sparkContext.broadcast(asked.toArrow())
        lists = candidates.mapInArrow(_selector(shared, k), "number long, query_id long, vec_id long, score long")
    else:
        lists = _grid(candidates, asked, k, size)
    return _merged(lists, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
