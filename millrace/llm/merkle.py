"""Merkle manifest of a dataset: partitions hold sparse forests of unresolved nodes, which merge as runs of siblings complete."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, fresh

ARITY = 16
#: Fragments that one step of the tree reduction merges.
FAN = 16


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts' text, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A leaf's part: `-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


class Forest:
    """A fragment: the nodes of any trees that still lack siblings, by tree, level and run.

    Fragments form a monoid: adding the nodes of one to another, in any order and grouping, gives the same forest, as a run
    resolves to its parent when all its siblings, whose number the tree's count of leaves tells, are there.
    """

    def __init__(self, arity: int):
        self.arity = arity
        self.open: dict[tuple[str, int, int], list] = {}

    def add(self, tree: str, leaves: int, level: int, index: int, own: str) -> Iterator[tuple]:
        """Put in a node; gives (tree, leaves, level, run, children, parent) for every run that this completes, up to the top."""
        while True:
            width = leaves
            for _ in range(level):
                width = -(-width // self.arity)
            if width <= 1:
                return
            run, place = divmod(index, self.arity)
            most = min(self.arity, width - run * self.arity)
            held = self.open.setdefault((tree, level, run), [leaves, 0, [None] * most])
            held[1] += 1
            held[2][place] = own
            if held[1] < most:
                return
            del self.open[tree, level, run]
            own = hashlib.sha256("".join(held[2]).encode()).hexdigest()
            yield tree, leaves, level, run, held[2], own
            level, index = level + 1, run

    def nodes(self) -> Iterator[tuple]:
        """What is unresolved: (tree, leaves, level, index, hash)."""
        for (tree, level, run), (leaves, _, children) in self.open.items():
            for place, own in enumerate(children):
                if own is not None:
                    yield tree, leaves, level, run * self.arity + place, own


def _batches(rows: Iterator[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    """(fragment, tree, leaves, level, index or run, hash or parent, children or null) as batches."""
    kinds = [("fragment", pa.int64()), ("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("children", pa.list_(pa.string()))]
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


_FOUND = "fragment long, tree string, leaves long, level int, index long, hash string, children array<string>"


def _resolving(arity: int):
    """Merge the nodes of each fragment, which come together; gives completed runs (with children) and what is unresolved (without)."""

    def rows(batches):
        now, forest = None, Forest(arity)

        def left():
            return ((now, *node, None) for node in forest.nodes())

        for batch in batches:
            names = ("fragment", "tree", "leaves", "level", "index", "hash")
            for fragment, *node in zip(*(batch.column(c).to_pylist() for c in names)):
                if fragment != now:
                    yield from left()
                    now, forest = fragment, Forest(arity)
                for tree, leaves, level, run, children, parent in forest.add(*node):
                    yield now, tree, leaves, level, run, parent, children
        yield from left()

    return lambda batches: _batches(rows(batches))


def _placing(batches):
    """Number each tree's rows in this partition from 0; rows come sorted by tree."""
    from pyspark import TaskContext

    part, tree, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for name in batch.column("tree").to_pylist():
            if name != tree:
                tree, n = name, 0
            places.append(n)
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, and others) with part, index (their rank in their tree by `order`) and leaves (how many it has).

    Rows are dealt to partitions by ranges of tree and order, so that a tree that holds most rows is spread over many tasks. Counts of
    each partition's part of each tree give the ranks; only these counts are summed up in order.
    """
    ranged = leaves.repartitionByRange(*(F.col(c) for c in ("tree", *order))).sortWithinPartitions("tree", *order)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    rows = cut(ranged.mapInArrow(_placing, f"{kind}, part long, place long"))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    offsets = counts.select("tree", "part", (F.sum("n").over(before) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("leaves"))
    return rows.join(offsets, ["tree", "part"]).withColumn("index", F.col("offset") + F.col("place")).drop("place", "offset")


def resolve(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """All runs (tree, leaves, level, run, children, parent) of the trees whose leaves are nodes (part, tree, leaves, index, hash).

    Each partition resolves what it can by itself: of a range of leaves, all but a few nodes at each level at either end. The unresolved nodes
    of up to FAN fragments are merged in one task at a time, until one is left: a tree reduction in which each step's runs are
    written, so that nothing but nodes on the borders of fragments moves, and nothing goes to the driver.
    """
    first = nodes.select(F.col("part").alias("fragment"), "tree", "leaves", F.lit(0).alias("level"), "index", "hash")
    found = cut(first.sortWithinPartitions("fragment", "tree", "index").mapInArrow(_resolving(arity), _FOUND))
    runs = found.where("children is not null")
    open_ = found.where("children is null")
    while open_.limit(1).count():
        step = open_.withColumn("fragment", F.floor(F.col("fragment") / FAN)).repartition("fragment").sortWithinPartitions("fragment", "tree", "level", "index")
        found = cut(step.mapInArrow(_resolving(arity), _FOUND))
        runs, open_ = runs.unionAll(found.where("children is not null")), found.where("children is null")
    return runs.select("tree", "leaves", "level", F.col("index").alias("run"), "children", F.col("hash").alias("parent"))


def _step(children: Column, place: Column) -> Column:
    """What stands before and after a child in its run."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), place), "").alias("before"), F.array_join(F.slice(children, place + 2, F.size(children)), "").alias("after"))


def _height(leaves: Column, arity: int) -> Column:
    """Levels above the leaves: how often the count is divided by arity, rounded up, until 1 is left."""
    out = F.lit(0)
    for k in range(1, 64):
        if arity ** (k - 1) >= 1 << 62:
            break
        out = out + (leaves > F.lit(arity ** (k - 1))).cast("int")
    return out


def paths(runs: DataFrame, tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, run, children, path, and the columns of tops) for each run of leaves.

    tops has a row for each tree (tree, path: that of its root in what holds it). path goes from a run's parent to the top: what stands
    before and after it and each node above it in their runs. It is handed down level by level, from a run to those of its children.
    """
    runs = runs.withColumn("top", F.col("level") == _height(F.col("leaves"), arity) - 1)
    carried = [c for c in tops.columns if c != "tree"]
    now = None
    highest = runs.agg(F.max("level")).first()[0]
    for level in range(highest if highest is not None else 0, -1, -1):
        here = runs.where(F.col("level") == level)
        begun = here.where("top").select("tree", "run", "children").join(tops, "tree")
        if now is None:
            now = begun
            continue
        above = now.select("tree", F.col("run").alias("above"), F.col("children").alias("siblings"), *carried)
        below = here.where("not top").select("tree", "run", "children", F.floor(F.col("run") / arity).alias("above")).join(above, ["tree", "above"])
        place = (F.col("run") % arity).cast("int")
        below = below.select("tree", "run", "children", *(F.concat(F.array(_step(F.col("siblings"), place)), F.col("path")).alias("path") if c == "path" else F.col(c) for c in carried))
        now = begun.unionByName(below)
    return now


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["before"], own, step["after"]))


def proof(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(rows: DataFrame, columns: list[str], key: str, group: str, arity: int = ARITY, keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns `keep`, with `leaf`, `subroot`, `root` and `path` (from the leaf to the root: what stands before and after each node).

    A leaf is H of the row's columns. The leaves of a group, by key and then by leaf, are a tree with subroot as
    its root; the subroots by group, null first and then by bytes, are the tree of root. Runs of arity nodes, or fewer at a level's
    end, become their H while several nodes remain, so a lone leaf is its tree's root itself.

    Nulls: any column may be null; a null key comes first, rows with a null group are a tree of their own. Repeated rows are leaves of their own.
    Texts are hashed whole. Other columns are kept as they are, whatever their names; where one is called as a new column, that gets underscores. An empty table gives no rows.
    """
    tree, leaf, own = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")), digest(*(field(F.col(c)) for c in columns)), F.struct(*(F.col(c) for c in (keep or rows.columns)))
    leaves = cut(rows.select(own.alias("row"), F.col(key).alias("key"), tree.alias("tree"), leaf.alias("hash")))
    names = rows.select(*(keep or rows.columns))
    return _proven(leaves, arity).select("row.*", *(F.col(c).alias(fresh(names, c)) for c in ("leaf", "subroot", "root", "path")))


def _proven(leaves: DataFrame, arity: int) -> DataFrame:
    """leaves (row, key, tree, hash) with leaf, subroot, root and path."""
    ranked = cut(placed(leaves, ["key", "hash"]))
    runs = cut(resolve(ranked, arity))
    lone = ranked.where("leaves = 1").select("tree", F.col("hash").alias("subroot"))
    # a tree's root is the parent of its topmost run; the roots are the leaves of one tree more
    roots = cut(runs.where(F.col("level") == _height(F.col("leaves"), arity) - 1).select("tree", F.col("parent").alias("subroot")).unionByName(lone))
    upper = cut(placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("hash")), ["name"]))
    upper_runs = cut(resolve(upper, arity))
    none = F.array().cast("array<struct<before:string,after:string>>")
    top = upper_runs.where(F.col("level") == _height(F.col("leaves"), arity) - 1).select("tree", F.col("parent").alias("root"), none.alias("path"))
    place = (F.col("index") % arity).cast("int")
    of_run = paths(upper_runs, top, arity)
    joined = upper.where("leaves > 1").withColumn("run", F.floor(F.col("index") / arity)).join(of_run, ["tree", "run"])
    tops = joined.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.concat(F.array(_step(F.col("children"), place)), "path").alias("path"))
    tops = cut(tops.unionByName(upper.where("leaves = 1").select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), F.col("hash").alias("root"), none.alias("path"))))
    held = ranked.where("leaves > 1").withColumn("run", F.floor(F.col("index") / arity)).join(paths(runs, tops, arity), ["tree", "run"])
    many = held.select("row", F.col("hash").alias("leaf"), "subroot", "root", F.concat(F.array(_step(F.col("children"), place)), "path").alias("path"))
    return many.unionByName(ranked.where("leaves = 1").join(tops, "tree").select("row", F.col("hash").alias("leaf"), "subroot", "root", "path"))
