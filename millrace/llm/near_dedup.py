"""MinHash near-duplicate detection: universal hash minima, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, cut, fresh, mix, raw, sliced, tidy, word_hashes
from millrace.llm.graph import components, join_keyed, merge

_U = np.uint64
BANDS, ROWS, SHINGLE = 40, 5, 5
#: A candidate is confirmed on its sets unless its minima agree less than the threshold by this much: 5.5 standard deviations of 200 minima.
MARGIN = 0.17
#: Buckets of more nodes are crowded: if one star doesn't settle them, their nodes meet again in so many longer bands.
CROWD, DEEP_BANDS, DEEP_ROWS = 32, 200, 10
#: Nodes and shingles of a tile, about.
TILE, TILE_SHINGLES = 2048, 2_000_000
#: Up to so many needed ids, 16 bytes each, are broadcast to find their texts; more are joined by a shuffle.
SMALL = 200_000


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))
    return (seed[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> _U(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes.

    A text with fewer than width words, but one, is a single shingle of its whole
    word sequence.
    """
    for begin, end in blocks(texts):
        words, first = word_hashes(texts[begin:end])
        whole = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            whole = whole * _U(0xFF51AFD7ED558CCD) + words[k : k + len(whole)]
        whole = mix(whole)
        for i in range(end - begin):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                one = _U(b - a)
                for w in words[a:b]:
                    one = one * _U(0xC4CEB9FE1A85EC53) + w
                yield mix(np.array([one], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a*x+b mod 2**32 over a set."""
    x = (found >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    width = max(16, 51_200 // len(a))
    for k in range(0, len(x), width):
        part = np.multiply.outer(x[k : k + width], a)
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25 + 2 * rows)
    for k in range(rows):
        key = mix(key * _U(0xFF51AFD7ED558CCD) + least[k::rows].astype(np.uint64))
    return key


def _signer(bands: int, rows: int, width: int):
    def sign(batches):
        a, b = _universal(bands * rows)
        with np.errstate(over="ignore"):
            for batch in sliced(batches):
                n, node, check, sketch, keys = [], [], [], [], []
                for found in shingle_sets(batch.column("raw").to_pylist(), width):
                    n.append(len(found))
                    if not len(found):
                        for out in (node, check, sketch, keys):
                            out.append(None)
                        continue
                    node.append(int(mix(found).sum(dtype=np.uint64).astype(np.int64)))
                    check.append(int(mix(found ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    least = minima(found, a, b)
                    sketch.append(least.astype(np.uint8).tobytes())
                    keys.append(_band_keys(least, bands, rows).view(np.int64))
                kept = [c for c in batch.schema.names if c != "raw"]
                made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "n_shingles", "node", "check", "sketch", "keys"])

    return sign


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, node, check, sketch, keys) of every row.

    node and check are a 128-bit digest of the shingle set, sketch the low byte of
    each universal minimum and keys a 64-bit hash of each band of whole minima.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw(F.col("text")).alias("raw")).mapInArrow(_signer(bands, rows, width), f"doc_id {kind}, n_shingles long, node long, check long, sketch binary, keys array<long>")


def _deepener(bands: int, rows: int, width: int):
    def deepen(batches):
        a, b = _universal(bands * rows)
        with np.errstate(over="ignore"):
            number = np.arange(1, bands * rows + 1, dtype=np.uint64) << _U(32)
            for batch in sliced(batches):
                keys, bits, sets = [], [], []
                for found in shingle_sets(batch.column("raw").to_pylist(), width):
                    least = minima(found, a, b)
                    keys.append(_band_keys(least, bands, rows).view(np.int64))
                    # as multipliers are odd, a minimum's own low bit is that of its shingle under every hash: it is drawn anew
                    drawn = np.packbits((mix(number | least) >> _U(63)).astype(np.uint8))
                    bits.append(np.pad(drawn, (0, -len(drawn) % 8)).tobytes())
                    sets.append(found.tobytes())
                made = [pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("node"), *made], names=["node", "keys", "bits", "shingles"])

    return deepen


def _tiler(percent: int, minima: int):
    """Links of a tile: for each node the others of different components, most alike by one-bit minima first, are compared on their
    full sets, but those that are less alike than the threshold by 5.5 standard deviations.

    Only a link that is confirmed joins components, and only nodes that are joined already are spared, so a tile
    returns fewer links than it has nodes, and none that could change a component is lost.
    """
    share = (1 + percent / 100) / 2
    most = minima * (1 - share + 5.5 * (share * (1 - share) / minima) ** 0.5)

    def tile(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
        found = table.column("shingles").to_pylist()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 8
        shingles = np.frombuffer(b"".join(found), np.uint64)
        del found
        begin = np.cumsum(sizes) - sizes
        two = side.any()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(node)),) * 2
        links = []
        for at, i in enumerate(left.tolist()):
            others = right if two else right[at + 1 :]
            others = others[component[others] != component[i]]
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            fit = apart <= most
            others = others[fit][np.argsort(apart[fit], kind="stable")]
            mine, some = shingles[begin[i] : begin[i] + sizes[i]], 16
            while len(others):
                now, others = others[:some], others[some:]
                ends = np.cumsum(sizes[now])
                theirs = shingles[np.repeat(begin[now] - ends + sizes[now], sizes[now]) + np.arange(ends[-1])]
                held = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(held, ends - sizes[now], dtype=np.int64)
                near = now[100 * shared >= percent * (sizes[i] + sizes[now] - shared)]
                joined, first = np.unique(component[near], return_index=True)
                links += [(node[i], node[j]) for j in near[first].tolist()]
                if len(joined):
                    component[np.isin(component, joined)] = component[i]
                    others = others[component[others] != component[i]]
                some = 256
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(ends.min(axis=1)), "v": pa.array(ends.max(axis=1))})

    return tile


def _crowds(deep: DataFrame, grouped: DataFrame) -> DataFrame:
    """(node, crowd, tiles) of deep (node, keys) that meet, over chains of buckets holding several components, in one crowd."""
    open_ = cut(_mixed(_met(deep), grouped, 1).select("node", "least"))
    crowds = cut(components(open_.select(F.col("least").alias("u"), F.col("node").alias("v"))).withColumnRenamed("component", "crowd"))
    size = crowds.join(deep.select("node", F.length("shingles").alias("held")), "node").groupBy("crowd")
    tiles = size.agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("held") / (8 * TILE_SHINGLES))).alias("tiles"))
    return cut(crowds.join(tiles, "crowd").select("node", "crowd", "tiles"))


def _tiled(deep: DataFrame, crowds: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of a crowd's nodes, as _tiler finds them in each tile.

    A crowd's nodes are dealt to tiles of about TILE by their hash, and each pair of tiles is
    compared in one step, so that memory doesn't grow with the crowd. A crowd of one component has nothing to find.
    """
    mine = F.least(F.floor((F.col("node") / F.lit(2.0**64) + 0.5) * F.col("tiles")), F.col("tiles") - 1)
    labelled = crowds.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    seats = labelled.join(deep.select("node", "bits", "shingles"), "node")
    seats = seats.select("crowd", "node", "component", "bits", "shingles", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    tiles = seats.select("crowd", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "component", "bits", "shingles")
    return tiles.groupBy("crowd", "i", "j").applyInArrow(_tiler(percent, DEEP_BANDS * DEEP_ROWS), "u long, v long")


def _agreeing(least: float):
    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("left_sketch", "right_sketch")]
                yield batch.select(["u", "v"]).filter(pa.array((sides[0] == sides[1]).mean(axis=1) >= least))

    return agree


def _confirming(percent: int, width: int):
    def confirm(batches):
        with np.errstate(over="ignore"):
            last: tuple[bytes | None, np.ndarray | None] = (None, None)
            for batch in sliced(batches):
                good = []
                for left, right in zip(batch.column("left_raw").to_pylist(), batch.column("right_raw").to_pylist()):
                    if left != last[0]:
                        last = (left, next(shingle_sets([left], width)))
                    a, b = last[1], next(shingle_sets([right], width))
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(100 * shared >= percent * (len(a) + len(b) - shared))
                yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _texts(docs: DataFrame, nodes: DataFrame, needed: DataFrame, named: bool, width: int) -> DataFrame:
    """(node, raw) of the needed nodes: by their least doc_id if ids name rows, else by hashing every row's set again."""
    if not named:
        return _noded(docs, width).join(needed, "node").groupBy("node").agg(F.min("raw").alias("raw"))
    ids = cut(nodes.select("node", "doc_id").join(needed, "node"))
    ids = F.broadcast(ids) if ids.count() <= SMALL else ids
    return docs.select("doc_id", raw(F.col("text")).alias("raw")).join(ids, "doc_id").select("node", "raw")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, margin: float = MARGIN) -> DataFrame:
    """Of the candidate pairs (u, v), those whose sketches are alike enough."""
    left = nodes.select(F.col("node").alias("u"), F.col("sketch").alias("left_sketch"))
    right = nodes.select(F.col("node").alias("v"), F.col("sketch").alias("right_sketch"))
    met = pairs.join(left, "u").join(right, "v").select("u", "v", "left_sketch", "right_sketch")
    return met.mapInArrow(_agreeing(percent / 100 - margin), "u long, v long")


def _confirmed(likely: DataFrame, nodes: DataFrame, docs: DataFrame, named: bool, percent: int, width: int) -> DataFrame:
    """Of the likely pairs (u, v), those whose full sets are alike enough."""
    needed = likely.select(F.col("u").alias("node")).unionAll(likely.select(F.col("v").alias("node"))).distinct()
    read = cut(_texts(docs, nodes, needed, named, width))
    left = read.select(F.col("node").alias("u"), F.col("raw").alias("left_raw"))
    right = read.select(F.col("node").alias("v"), F.col("raw").alias("right_raw"))
    return cut(likely.join(left, "u").join(right, "v").select("u", "v", "left_raw", "right_raw").mapInArrow(_confirming(percent, width), "u long, v long"))


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Rows with the same shingle set are collapsed to one node first, so groups of
    copies cost one signature. Nodes meet in band buckets. In each bucket every
    node is compared with the bucket's least node. While a bucket of up to CROWD nodes still holds
    nodes of several components, its other nodes become centres
    and are compared with the nodes of other components only. A larger one,
    mostly of texts that share one passage but are otherwise apart, isn't compared
    further: its nodes are signed again with DEEP_BANDS bands of DEEP_ROWS minima, in which such texts
    part. Nodes of different components that meet there are compared in tiles: where one bit of
    each minimum agrees enough, on their full shingle sets at once, so that of a tile only links that join components leave it. So
    all links that can change a component are tried. Other candidates whose minima agree are confirmed on
    their full shingle sets too. A pair at 0.75 fails to meet with a chance of 2 in
    100,000 in either signature.

    Nulls: a null text is empty; a text without words has n_shingles 0, no links
    and itself as component. A null doc_id takes part, but never is a
    component_id if the component has another; alone, its component_id is null and it is kept.
    Rows that share a doc_id are separate rows. Other columns are ignored. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(signatures(docs, bands, rows, width))
    nodes = cut(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(F.struct("sketch", "keys")).alias("of")).select("node", "doc_id", "copies", "of.*"))
    named = signed.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0

    def confirmed(likely: DataFrame) -> DataFrame:
        return _confirmed(likely, nodes, docs, named, percent, width)

    held = _met(nodes)
    grouped = cut(components(confirmed(cut(_likely(_stars(held), nodes, percent)))))
    open_ = cut(_mixed(held, grouped))
    del held
    tidy(open_)
    crowded = cut(open_.where(F.col("size") > CROWD).select("node").distinct())
    likely = cut(_likely(_further(open_.where(F.col("size") <= CROWD)), nodes, percent))
    if crowded.limit(1).count():
        grouped = merge(grouped, _in_crowds(docs, nodes, crowded, grouped, named, percent, width))
    # what crowds have joined needs no further comparison
    likely = cut(_apart(likely, grouped))
    if likely.limit(1).count():
        grouped = merge(grouped, confirmed(likely))
    # components are named by nodes, one of each set, before the rows are, so that copies move once at most
    sets = nodes.select("node", "doc_id", "copies").join(grouped, "node", "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("group"))
    sets = cut(sets)
    least = sets.groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named_sets = cut(join_keyed(sets, least, "group", sets.count()).select("node", F.col("least").cast(kind).alias("component_id"), F.col("copies").alias("n")))
    worded = signed.where("node is not null").select("doc_id", "n_shingles", "node")
    found = join_keyed(worded, named_sets, "node", signed.count()).select("doc_id", "n_shingles", "component_id")
    out = found.unionByName(signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs (doc_id, text and others), one of each group of near duplicates: that of least doc_id, null ids last.

    A row is known by its doc_id and text, not by its doc_id alone: other texts under the same id are rows of their own, ordered by a
    hash of the text. Of rows that repeat both, the least by all columns stays, so these must be orderable. Texts
    without words are in no group; as rows that repeat them they go too. An empty table gives no rows.
    """
    key = fresh(docs, "_row")
    own = F.struct(F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    keyed = docs.withColumn(key, own)
    repeated = cut(keyed.groupBy(key).count().where("count > 1").select(key))
    if repeated.limit(1).count():
        least = keyed.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("_least"))
        keyed = keyed.join(repeated, key, "left_anti").select(*docs.columns, key).unionAll(least.select("_least.*", key))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent)
    gone = found.where("not kept").select(F.col("doc_id").alias(key))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def _met(signed: DataFrame) -> DataFrame:
    """(bucket, node, least, size) of the buckets that hold several nodes of signed (node, keys)."""
    held = signed.select(F.explode("keys").alias("bucket"), "node")
    shared = held.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    return cut(held.join(shared, "bucket").select("bucket", "node", "least", "size"))


def _stars(held: DataFrame) -> DataFrame:
    return held.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()


def _in_crowds(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, grouped: DataFrame, named: bool, percent: int, width: int) -> DataFrame:
    """Links (u, v) between the crowded nodes, found in longer bands and tiles."""
    texts = _texts(docs, nodes, crowded, named, width).repartition("node")
    deep = cut(texts.mapInArrow(_deepener(DEEP_BANDS, DEEP_ROWS, width), "node long, keys array<long>, bits binary, shingles binary"))
    crowds = _crowds(deep, grouped)
    tidy(crowds)
    return cut(_tiled(deep, crowds, grouped, percent))


def _apart(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs (u, v) whose nodes are in different components."""
    of = grouped.select(F.col("node").alias("u"), F.col("component").alias("a"))
    to = grouped.select(F.col("node").alias("v"), F.col("component").alias("b"))
    return pairs.join(of, "u", "left").join(to, "v", "left").where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v")


def _mixed(held: DataFrame, grouped: DataFrame, settled: int = 2) -> DataFrame:
    """The nodes, with their components, of buckets that hold several components; buckets of up to `settled` nodes have nothing left to find."""
    labelled = held.where(F.col("size") > settled).join(grouped, "node", "left").select("bucket", "node", "least", "size", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return labelled.join(mixed.select("bucket"), "bucket")


def _noded(docs: DataFrame, width: int) -> DataFrame:
    """(node, raw) of every row that has words."""

    def sign(batches):
        with np.errstate(over="ignore"):
            for batch in sliced(batches):
                node = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in shingle_sets(batch.column("raw").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), batch.column("raw")], names=["node", "raw"])

    return docs.select(raw(F.col("text")).alias("raw")).mapInArrow(sign, "node long, raw binary").where("node is not null")


def _further(open_: DataFrame) -> DataFrame:
    """Pairs of a bucket's nodes but its least with greater nodes of other components."""
    now = open_.where("node <> least").select("bucket", F.col("node").alias("u"), F.col("component").alias("of"))
    met = open_.select("bucket", F.col("node").alias("v"), "component")
    return now.join(met, "bucket").where("v > u and component <> of").select("u", "v").distinct()
