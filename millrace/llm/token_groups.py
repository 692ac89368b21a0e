"""N-gram Jaccard join over a token-group matrix: groups of similar documents, the tokens each holds, bounds on overlap, and opening of groups that qualify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, mix, raw, sliced, tidy
from millrace.llm.graph import components, join_keyed
from millrace.llm.near_dedup import _band_keys, _confirmed, _likely, _met, _stars, _texts, _universal, minima, shingle_sets

_U = np.uint64
WIDTH, PERCENT = 4, 85
#: Minima that form groups, not what is found: nodes that share one of BANDS keys of ROWS minima with the key's least node may be of one group.
BANDS, ROWS = 8, 4
#: Less than the threshold by which minima may agree for two nodes to be of one group: 4 standard deviations.
MARGIN = 0.25
#: Nodes and tokens of a group at most, but for one node with more.
GROUP, GROUP_TOKENS = 256, 500_000
#: Tokens that are more than one in so many of all are common: fewer than this, so they can be sent to all tasks.
COMMON = 1 << 17
#: A block of texts names a token as perhaps common from so many of its sets on.
LOCAL = 4
#: Tokens of a bucket of the matrix, about, and queries that a group is opened for at once.
BUCKET, QUERIES = 2_000_000, 4096
#: Of which share of the tokens, one in so many, nodes without relatives are told first.
SHARE = 3


def _needed(n, percent: int):
    """Tokens that a set of n must share with a set that it links with, at least."""
    return -(-percent * n // 100)


def _digest(found: np.ndarray) -> int:
    return int(mix(found).sum(dtype=np.uint64).astype(np.int64))


def _distinct(texts: list[bytes], width: int) -> tuple[list[int], list[np.ndarray]]:
    """The different sets with tokens of a block of texts, and their digests."""
    sets: dict[int, np.ndarray] = {}
    for found in shingle_sets(texts, width):
        if len(found):
            sets.setdefault(_digest(found), found)
    return list(sets), list(sets.values())


def _measuring(width: int):
    """Of each text the size and digest of its set; on the first row of a block, the tokens that several of its sets have, and how many."""

    def measure(batches):
        with np.errstate(over="ignore"):
            for batch in sliced(batches, 2000):
                n, node, sets = [], [], {}
                for found in shingle_sets(batch.column("raw").to_pylist(), width):
                    n.append(len(found))
                    node.append(_digest(found) if len(found) else None)
                    if len(found):
                        sets.setdefault(node[-1], found)
                often = [None] * len(n)
                if sets:
                    token, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    some = times >= LOCAL
                    often[0] = np.stack([token[some].view(np.int64), times[some]]).T.ravel() if some.any() else None
                made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(often, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_shingles", "node", "often"])

    return measure


def _signing(width: int):
    def sign(batches):
        a, b = _universal(BANDS * ROWS)
        with np.errstate(over="ignore"):
            for batch in sliced(batches):
                least = [minima(found, a, b) for found in shingle_sets(batch.column("raw").to_pylist(), width)]
                made = [pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()), pa.array([_band_keys(x, BANDS, ROWS).view(np.int64) for x in least], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), *made], names=["node", "sketch", "keys"])

    return sign


def _often(signed: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The common tokens, fewer than COMMON, and their ranks, rarest first."""
    pairs = signed.where("often is not null").select(F.explode(F.expr("transform(sequence(0, cast(size(often) / 2 as int) - 1), i -> struct(often[2 * i] as token, often[2 * i + 1] as n))")).alias("of"))
    counts = pairs.groupBy("of.token").agg(F.sum("of.n").alias("n")).where(F.col("n") * COMMON > total).toArrow()
    token, n = counts.column("token").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.lexsort((token, n))
    rank = np.empty(len(token), np.int64)
    rank[order] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def _held(token: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are common, and their places among these."""
    at = np.minimum(np.searchsorted(common, token), max(len(common) - 1, 0))
    return (common[at] == token) if len(common) else np.zeros(len(token), bool), at


def _filling(common, buckets: int, percent: int, width: int, share: int):
    """Rows of the matrix by bucket, of one in `share` of the tokens: low halves of tokens by node, how many each node has and the nodes.

    Of negative buckets, odd ones have common tokens of prefixes (ranks), even ones how many different entries a node has in
    the others.
    """

    def fill(batches):
        tokens, ranks = common.value
        names = ["bucket", "low", "counts", "nodes"]
        with np.errstate(over="ignore"):
            for batch in sliced(batches, 2000):
                nodes, sets = _distinct(batch.column("raw").to_pylist(), width)
                if not nodes:
                    continue
                ids, sizes = np.array(nodes, np.int64), np.fromiter(map(len, sets), np.int64, len(sets))
                token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                is_common, at = _held(token, tokens)
                rest = ~is_common & ((token >> _U(5)) % _U(share) == 0) if share > 1 else ~is_common
                # bucket, node and low half of a token in one number
                entry = np.unique((token[rest] >> _U(32)) % _U(buckets) << _U(43) | owner[rest].astype(np.uint64) << _U(32) | token[rest] & _U(0xFFFFFFFF))
                own = (entry >> _U(32) & _U(0x7FF)).astype(np.int64)
                known = np.bincount(own, minlength=len(sets))
                spread = int(ids[0]) % buckets
                rows: list[tuple] = [(-2 - 2 * spread, known.tobytes(), b"", ids.tobytes())]
                edges = np.flatnonzero(np.diff(entry >> _U(43), prepend=_U(1 << 21), append=_U(1 << 21))) if len(entry) else []
                for begin, end in zip(edges[:-1], edges[1:]):
                    some, count = np.unique(own[begin:end], return_counts=True)
                    rows.append((int(entry[begin] >> _U(43)), entry[begin:end].astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), ids[some].tobytes()))
                if share == 1 and len(tokens):
                    lacking = sizes - _needed(sizes, percent) + 1 - known
                    few = is_common & (lacking[owner] > 0)
                    who, rank = owner[few], ranks[at[few]]
                    order = np.lexsort((rank, who))
                    who, rank = who[order], rank[order]
                    count = np.bincount(who, minlength=len(sets))
                    taken = np.arange(len(who)) - (np.cumsum(count) - count)[who] < lacking[who]
                    if taken.any():
                        rows.append((-1 - 2 * spread, rank[taken].tobytes(), b"", ids[who[taken]].tobytes()))
                for begin in range(0, len(rows), 512):
                    part = rows[begin : begin + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    return fill


_FILLED = "bucket long, low binary, counts binary, nodes binary"


def _bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different (token, node) of a bucket by token: low half, place of the node, how many nodes have the token; and the nodes."""
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    ids, code = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()]), return_inverse=True)
    pair = np.unique(low.astype(np.uint64) << _U(32) | np.repeat(code, counts).astype(np.uint64))
    edges = np.flatnonzero(np.diff(pair >> _U(32), prepend=_U(1 << 40)))
    n = np.diff(np.append(edges, len(pair)))
    return (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64), np.repeat(n, n), ids


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("nodes", "low"))


def _shared_by(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(node, known, shared): how many entries each node has, and how many of a bucket's tokens it shares with others."""
    if key[0].as_py() < 0:
        nodes, known = _unpacked(table)
        nodes, first = np.unique(nodes, return_index=True)
        return pa.table({"node": nodes, "known": known[first], "shared": np.zeros(len(nodes), np.int64)})
    _, place, n, ids = _bucket(table)
    shared = np.bincount(place[n > 1], minlength=len(ids))
    some = np.flatnonzero(shared)
    return pa.table({"node": ids[some], "known": np.zeros(len(some), np.int64), "shared": shared[some]})


def _sharing(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(node, token, n) of a bucket's tokens that several nodes have; n: how many, 0 with what a node has at all, -1 for common tokens."""
    bucket = key[0].as_py()
    if bucket < 0:
        nodes, value = _unpacked(table)
        return pa.table({"node": nodes, "token": -1 - value if bucket % 2 else value, "n": np.full(len(nodes), -1 if bucket % 2 else 0, np.int64)})
    low, place, n, ids = _bucket(table)
    some = n > 1
    return pa.table({"node": ids[place[some]], "token": low[some] + (bucket << 32), "n": n[some]})


def _longest(n: Column, percent: int) -> Column:
    """Length of the prefix of a set of n: what is left after it is too little for a link."""
    return n - F.ceil(n * percent / 100) + 1


def _buckets(docs: DataFrame, tokens: int) -> int:
    return min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET)), 1 << 20)


def related(docs: DataFrame, nodes: DataFrame, common, tokens: int, percent: int, width: int) -> DataFrame:
    """Those of nodes (node, n_shingles and others) that may link with another.

    A node that has more tokens alone than its prefix is long has none but such in it, rarest first, and links with no other. One in
    SHARE of the tokens is enough to tell most of these, so only the others' tokens are all looked at.
    """
    buckets = _buckets(docs, tokens // SHARE)
    filled = docs.select(raw(F.col("text")).alias("raw")).mapInArrow(_filling(common, buckets, percent, width, SHARE), _FILLED)
    counts = filled.groupBy("bucket").applyInArrow(_shared_by, "node long, known long, shared long").groupBy("node").agg((F.max("known") - F.sum("shared")).alias("alone"))
    return nodes.join(counts.select("node", "alone"), "node").where(F.col("alone") < _longest(F.col("n_shingles"), percent)).drop("alone")


def prefixes(texts: DataFrame, nodes: DataFrame, common, percent: int, width: int) -> DataFrame:
    """(token, node) of texts (node, raw): of each node's tokens, rarest first, the first as many as leave too few for a link, without those that no other node has.

    Two sets that link share a token of both these prefixes. The order is by how many nodes have a token, as the matrix's columns tell,
    and common tokens come last.
    """
    buckets = _buckets(texts, nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    filled = texts.mapInArrow(_filling(common, buckets, percent, width, 1), _FILLED)
    shared = filled.groupBy("bucket").applyInArrow(_sharing, "node long, token long, n long").repartition("node")
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("of")).join(nodes.select("node", "n_shingles"), "node")
    rare, often = F.filter("of", lambda x: x["n"] > 0), F.filter("of", lambda x: x["n"] < 0)
    known = F.element_at(F.filter("of", lambda x: x["n"] == 0), 1)["token"]
    take = F.greatest(_longest(F.col("n_shingles"), percent) - known + F.size(rare), F.lit(0)).cast("int")
    return listed.select(F.explode(F.array_distinct(F.concat(F.slice(rare, F.lit(1), take), often))).alias("of"), "node").select("of.token", "node")


def _opening(percent: int, width: int):
    """Links (u, v) between each group's members and the queries after them, as many as join their components: rows come sorted by group, part and side.

    A group's matrix column, the union of its members' tokens, bounds what a query can share with any
    of them; only if that could be enough is the group opened, and its members' shares are counted.
    """

    def of_group(nodes: list[int], comps: list[int], sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        union, first = np.unique(token, return_index=True)
        held = np.diff(np.append(first, len(token)))
        node, comp = np.array(nodes, np.int64), np.array(comps, np.int64)
        joined: dict[int, int] = {}

        def now(component: int) -> int:
            while component in joined:
                component = joined[component]
            return component

        def ask(own: int, mine: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
            at = np.minimum(np.searchsorted(union, found), len(union) - 1)
            at = at[union[at] == found]
            least = max(int(sizes.min()), _needed(len(found), percent))
            if len(at) < -(-percent * (len(found) + least) // (100 + percent)):
                return
            n = held[at]
            where = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[where], minlength=len(sets))
            near = np.flatnonzero(100 * shared >= percent * (len(found) + sizes - shared))
            mine, met = now(mine), {}
            for k in near[np.unique(comp[near], return_index=True)[1]].tolist():
                met.setdefault(now(int(comp[k])), k)
            # of components that earlier queries have joined one link is enough
            for other, k in met.items():
                if other != mine:
                    joined[other] = mine
                    yield min(own, int(node[k])), max(own, int(node[k]))
            comp[near] = mine

        return ask

    def links(batches):
        now, members, ask = None, ([], [], []), None
        for batch in sliced(batches):
            names = ("group", "part", "side", "node", "component")
            texts = batch.column("raw").to_pylist()
            for found, (group, part, side, node, component) in zip(shingle_sets(texts, width), zip(*(batch.column(c).to_pylist() for c in names))):
                if (group, part) != now:
                    now, members, ask = (group, part), ([], [], []), None
                if side == 0:
                    for to, value in zip(members, (node, component, found)):
                        to.append(value)
                    continue
                ask = ask or of_group(*members)
                yield from ask(node, component, found)

    def open_(batches):
        with np.errstate(over="ignore"):
            held = []
            for link in links(batches):
                held.append(link)
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names=["u", "v"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held)], names=["u", "v"])

    return open_


def _grouped(nodes: DataFrame, leads: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, n_shingles, component, pure, group, size, least, most): the nodes of each cluster, those of one lead, in groups of bounded size.

    Nodes that link with their lead are in groups of their own with it, whose component `pure` names; those still alone, with which a cluster may be full, are together.
    """
    linked = stars.select(F.col("v").alias("node"), F.col("u").alias("component"))
    heads = stars.select(F.col("u").alias("node"), F.col("u").alias("head")).distinct()
    own = nodes.select("node", "n_shingles").join(leads.select("node", F.col("lead").alias("cluster")), "node", "left").join(linked, "node", "left").join(heads, "node", "left")
    pure = F.coalesce("head", "component")
    own = own.select("node", "n_shingles", F.coalesce("head", "cluster", "node").alias("cluster"), F.coalesce(pure, "node").alias("component"), pure.alias("pure"))
    size = own.groupBy("cluster", "pure").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / GROUP_TOKENS)).alias("slices"))
    placed = own.join(size, (own["cluster"] == size["cluster"]) & own["pure"].eqNullSafe(size["pure"])).select(own["*"], "slices")
    placed = placed.withColumn("group", F.xxhash64("cluster", F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), F.pmod(F.xxhash64("node"), F.col("slices"))))
    each = placed.groupBy("group").agg(F.count("*").alias("size"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    return placed.join(each, "group").select("node", "n_shingles", "component", "pure", "group", "size", "least", "most")


def _candidates(prefix: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """(node, group): nodes that ask groups which may hold a node that they link with, in another component."""
    of = prefix.join(grouped, "node")
    index = of.select("token", "group", "pure", "size", "least", "most").distinct()
    several = index.groupBy("token").agg(F.count("*").alias("groups"), F.min("pure").alias("a"), F.max("pure").alias("b"), F.count("pure").alias("c")).where("groups > 1 and not (c = groups and a = b)").select("token")
    index = cut(index.join(several, "token"))
    asking = of.join(several, "token").select("token", "node", F.col("group").alias("own"), F.col("pure").alias("mine"), F.col("size").alias("mates"), "n_shingles")
    met = asking.join(index, "token").where("own <> group and (mine is null or pure is null or mine <> pure)")
    met = met.where("struct(mates, own) < struct(size, group)").where((F.col("most") * 100 >= F.col("n_shingles") * percent) & (F.col("n_shingles") * 100 >= F.col("least") * percent))
    return met.select("node", "group").distinct().unionAll(grouped.where("pure is null and size > 1").select("node", "group"))


def _parts(key: Column) -> Column:
    return F.pmod(F.xxhash64("node"), key)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text): components of links between sets with 100 * intersection >= percent * union.

    Rows with the same set of shingles are one node. Nodes that have enough tokens alone link with none and are left out first. Similar nodes are put into groups: those of one lead, the
    least node with which they agree in a key of minima. Where they link with it, on full sets, they are of one component before the search. The token-group matrix holds which nodes have a token, in
    buckets of tokens; by its counts, each node's rarest tokens are found, and the groups with which it shares one of those are asked for
    it: the union of a group's tokens bounds the overlap, and where that suffices the group is opened and its members are compared on full sets. A group
    in which all are of the query's component isn't asked. So every link that can change a component is found: minima only form the groups, common tokens and
    buckets only order and deal out tokens; none decides which links exist.

    Nulls: a null text is empty; a text without words has n_shingles 0, no links and itself as component. A text with fewer words than width is
    one shingle. A null doc_id takes part, but is a component_id only if its component has no other. Rows that share a doc_id are separate rows. Very long texts
    are taken whole. Other columns are ignored; an empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    signed = cut(docs.select("doc_id", raw(F.col("text")).alias("raw")).mapInArrow(_measuring(width), f"doc_id {kind}, n_shingles long, node long, often array<long>"))
    nodes = cut(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")))
    named = signed.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0
    total = signed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    common = spark.sparkContext.broadcast(_often(signed, total))

    open_ = cut(related(docs, nodes, common, total, percent, width))
    tidy(open_)
    texts = _texts(docs, nodes, open_.select("node"), named, width)
    open_ = cut(open_.join(texts.mapInArrow(_signing(width), "node long, sketch binary, keys array<long>"), "node"))
    leads = cut(_likely(_stars(_met(open_)), open_, percent, MARGIN).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("lead")))
    stars = cut(_confirmed(leads.select(F.col("lead").alias("u"), F.col("node").alias("v")), open_, docs, named, percent, width))
    grouped = cut(_grouped(open_, leads, stars))
    tidy(grouped)

    prefix = cut(prefixes(texts, open_, common, percent, width))
    tidy(prefix)
    asked = cut(_candidates(prefix, grouped, percent))
    links = _opened(docs, nodes, asked, grouped, named, percent, width)
    found = components(stars.unionAll(links))

    sets = cut(nodes.select("node", "doc_id", "copies").join(found, "node", "left").select("node", "doc_id", "copies", F.coalesce("component", "node").alias("group")))
    least = sets.groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named_sets = cut(join_keyed(sets, least, "group", sets.count()).select("node", F.col("least").cast(kind).alias("component_id"), F.col("copies").alias("n")))
    worded = signed.where("node is not null").select("doc_id", "n_shingles", "node")
    out = join_keyed(worded, named_sets, "node", signed.count()).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _opened(docs: DataFrame, nodes: DataFrame, asked: DataFrame, grouped: DataFrame, named: bool, percent: int, width: int) -> DataFrame:
    """Links (u, v) that the asked (node, group) have."""
    parts = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    members = grouped.select("node", "component", "group").join(parts, "group")
    needed = asked.select("node").unionAll(members.select("node")).distinct()
    read = cut(_texts(docs, nodes, needed, named, width))
    queries = asked.join(parts, "group").join(grouped.select("node", "component"), "node").select("group", _parts(F.col("parts")).alias("part"), F.lit(1).alias("side"), "node", "component")
    held = members.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node", "component")
    rows = held.unionAll(queries).join(read, "node").repartition("group", "part").sortWithinPartitions("group", "part", "side")
    return cut(rows.select("group", "part", "side", "node", "component", "raw").mapInArrow(_opening(percent, width), "u long, v long"))
