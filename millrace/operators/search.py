"""Filtered exact vector search, reranking order and presentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.vectors import METRICS, score
from millrace.operators.filters import Condition, matches

DEFAULT_LIMIT, MOST = 10, 100
#: Bytes of one block of queries or shard of rows, about, and scores that a task works out at once.
BLOCK_BYTES, TILE = 32 << 20, 1 << 21


def limits(limit: int = DEFAULT_LIMIT, candidates: int | None = None) -> tuple[int, int]:
    """The limit, and how many candidates a reranker gets: five times as many unless given, 100 at most."""
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    candidates = min(MOST, 5 * limit) if candidates is None else candidates
    if not limit <= candidates <= MOST:
        raise ValueError(f"candidates must be {limit} to {MOST}")
    return limit, candidates


def top_k(rows: DataFrame, query: list[float], vector: str, order: list[str], k: int = DEFAULT_LIMIT, metric: str = "cosine", conditions: list[Condition] = (), fields: tuple[str, ...] | None = None) -> DataFrame:
    """The k rows of greatest score that meet the conditions, ties by the order columns ascending.

    Filters come before the scoring; the query is a literal, so nothing is joined, and the plan ends
    in TakeOrderedAndProject: k rows a task, and no sort of the whole.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kept = rows.where(matches(rows.schema, list(conditions), fields)) if fields else rows.where(matches(rows.schema, list(conditions)))
    given = F.array(*(F.lit(float(x)) for x in query))
    return kept.withColumn("score", score(given, F.col(vector), metric)).orderBy(F.desc("score"), *order).limit(k)


def _vectors(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a column of arrays the matrices by length: rows' places and values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[size] = (rows, values[(ends[rows] - size)[:, None] + np.arange(size)])
    return out


def _tile(asked: np.ndarray, held: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all queries and candidates of a tile, equal to 12 digits for equal vectors."""
    found = asked @ held.T
    if metric == "cosine":
        size = np.sqrt((asked**2).sum(axis=1))[:, None] * np.sqrt((held**2).sum(axis=1))[None, :]
        found = np.divide(found, size, out=np.zeros_like(found), where=size != 0)
    elif metric == "euclidean":
        found = np.stack([-np.sqrt(((held - row) ** 2).sum(axis=1)) for row in asked]).reshape(found.shape)
    return np.round(found, 12)


def _best(candidates: pa.Table, queries: pa.Table, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k best (query, key, score) of some candidates (key, vector) for each of some queries (query_key, query), ties to the lesser key."""
    candidates = candidates.take(pc.sort_indices(candidates, [(candidates.column_names[0], "ascending")]))
    by_size = _vectors(candidates.column(1))
    for size, (at, asked) in _vectors(queries.column(1)).items():
        if size not in by_size:
            continue
        places, held = by_size[size]
        step = max(1, TILE // len(places))
        for begin in range(0, len(asked), step):
            found = _tile(asked[begin : begin + step], held, metric)
            best = np.argsort(-found, axis=1, kind="stable")[:, :k]
            ids, keys = np.repeat(at[begin : begin + step], best.shape[1]), places[best.ravel()]
            yield pa.RecordBatch.from_arrays([queries.column(0).combine_chunks().take(pa.array(ids)), candidates.column(0).combine_chunks().take(pa.array(keys)), pa.array(np.take_along_axis(found, best, axis=1).ravel())], names=["_query", "_key", "score"])


def top_k_batch(rows: DataFrame, queries: DataFrame, vector: str, key: str, query_key: str, k: int = DEFAULT_LIMIT, metric: str = "cosine", most: int = 4096) -> DataFrame:
    """(query_key, key, score, rank): the k best rows for each row of queries (query_key, query), any number of them, ties to the lesser key.

    Scores are products of matrices, tile by tile, of which each passes on k rows a query. Queries of up to BLOCK_BYTES in all, and `most` rows, go
    to all tasks, which read the rows once. More of them are cut into such blocks and the rows into shards as large, and each block meets each shard in one task: the rows
    are sent once for each block, the queries once for each shard, and none go through the driver. Vectors that are null or hold a null or no finite number take no
    part, nor do pairs of different lengths.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    whole = lambda df, c: df.where(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    held, asked = whole(rows, vector).select(F.col(key).alias("_key"), F.col(vector).alias("vector")), whole(queries, "query").select(F.col(query_key).alias("_query"), "query")
    n, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("query")), F.lit(0))).first()
    per = max(1, min(most, BLOCK_BYTES // (8 * max(wide, 1))))
    blocks = max(1, -(-n // per))
    kind = f"_query {asked.schema['_query'].dataType.simpleString()}, _key {held.schema['_key'].dataType.simpleString()}, score double"
    if blocks == 1:
        given = rows.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scored(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from _best(pa.Table.from_batches([batch]), given.value, k, metric)

        partial = held.mapInArrow(scored, kind)
    else:
        shards = max(1, -(-held.count() // per))
        spread = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
        mine = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        left = held.select("_key", "vector", mine("_key", shards).alias("shard"), spread("block", blocks))
        right = asked.select("_query", "query", mine("_query", blocks).alias("block"), spread("shard", shards))

        def met(a: pa.Table, b: pa.Table) -> pa.Table:
            found = list(_best(a.select(["_key", "vector"]), b.select(["_query", "query"]), k, metric)) if a.num_rows and b.num_rows else []
            return pa.Table.from_batches(found) if found else pa.table({"_query": b.column("_query").slice(0, 0), "_key": a.column("_key").slice(0, 0), "score": pa.array([], pa.float64())})

        partial = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(met, kind)
    best = W.partitionBy("_query").orderBy(F.desc("score"), "_key")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("_query").alias(query_key), F.col("_key").alias(key), "score", "rank")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Contents for at most MOST hits: these are broadcast to the chunks and documents, which are read for no others."""
    small = F.broadcast(hits)
    found = chunks.join(small, ["document_id", "chunk_id"])
    return documents.join(F.broadcast(found), "document_id")


def rerank(hits: DataFrame, new_score: Column, limit: int, order: list[str]) -> DataFrame:
    """Order hits anew: by new_score, ties by their rank before; semantic_score and semantic_rank are kept."""
    ranked = hits.withColumn("semantic_rank", F.row_number().over(W.orderBy(F.desc("score"), *order)))  # hits are few
    ranked = ranked.withColumnRenamed("score", "semantic_score").withColumn("score", new_score)
    return ranked.orderBy(F.desc("score"), "semantic_rank").limit(limit)


def rerank_or_keep(hits: DataFrame, provider, limit: int, order: list[str], failure: str = "error") -> DataFrame:
    """rerank with scores of provider(hits) (adds new_score); if it fails, raise or, with use-semantic-order, keep the order."""
    if failure not in ("error", "use-semantic-order"):
        raise ValueError(f"unknown failure mode {failure!r}")
    try:
        scored = provider(hits)
        bad = scored.where(F.col("new_score").isNull() | F.isnan("new_score") | (F.abs("new_score") == float("inf"))).limit(1).count()
        if bad or scored.count() != hits.count():
            raise ValueError("the reranker left out a candidate or gave no finite score")
    except Exception:
        if failure == "error":
            raise
        return hits.orderBy(F.desc("score"), *order).limit(limit)
    return rerank(scored, F.col("new_score"), limit, order).drop("new_score")


def group_by_document(hits: DataFrame) -> DataFrame:
    """One row for each document in order of its best hit, its chunks listed by rank; hits has document_id, chunk_id, rank, score."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    return hits.groupBy("document_id").agg(F.min("rank").alias("first_rank"), listed.alias("matched_chunks"))
