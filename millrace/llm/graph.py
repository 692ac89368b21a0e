"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, tidy


#: A key that more than one in so many rows have is hot, so there are fewer hot keys than this.
HOT = 4096


def join_keyed(rows: DataFrame, own: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with own, which has one row a key and in `n` how many of the `total` rows have it.

    Hot keys, HOT at most whatever the data, are joined by a broadcast, where their rows lie; only rows of other keys,
    each of which has a small share of all, move to their key's task.
    """
    hot = F.col("n") * HOT > total
    few = F.broadcast(own.where(hot).drop("n"))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(own.where(~hot).drop("n"), key))


def _starry(edges: DataFrame) -> bool:
    """Whether each edge (u, v) leads straight to its component's least node: one edge a node, none from a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(F.col("out") + F.col("in") > 1).where("out > 0")
    return odd.limit(1).count() == 0


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_keyed(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_keyed(down, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionAll(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (u, v); component is the least node.

    Alternates the large-star and small-star operations until the edges are stars
    around each component's least node. Loops (u = v) and repeated edges are
    allowed; an edge with a null end is ignored; no edges give no rows. Each round
    is checkpointed, so a lost executor repeats one round at most. Nodes with many
    neighbours are aggregated before the shuffle, and joined where their edges lie.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    while not _starry(edges):
        total = edges.count()
        edges = cut(_small_star(_large_star(edges, total), total))
        tidy(edges)
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)


def merge(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (u, v) join the components of grouped; a node that isn't in grouped is its own.

    Only the graph of components is solved, which is small where the links are few.
    """
    of = grouped.select(F.col("node").alias("u"), F.col("component").alias("a"))
    to = grouped.select(F.col("node").alias("v"), F.col("component").alias("b"))
    between = links.join(of, "u", "left").join(to, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    moved = cut(components(between).select(F.col("node").alias("component"), F.col("component").alias("now")))
    kept = grouped.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    new = moved.select(F.col("component").alias("node"), F.col("now").alias("component")).join(grouped.select("node"), "node", "left_anti")
    return cut(kept.unionAll(new))
