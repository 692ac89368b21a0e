"""Edit-distance join of names: rare-first positional q-gram prefixes, an inverted-index join, and filters that are safe for transpositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, mix, sliced

_U = np.uint64
GRAM = 3
#: Grams, and the posting lists of their prefixes, are counted in so many slots, whatever the input: all that goes to the driver and the tasks.
SLOTS = 1 << 16
#: Names of a block: longer posting lists are cut into blocks, and each block of one side meets each of the other.
BLOCK = 1024
#: Pairs, and cells of a matrix of names, that a task compares at once.
PAIRS, CELLS = 1 << 20, 1 << 22
#: Places in a name whose grams share a posting list; more than twice the distance.
PLACES = 16
#: More than any distance that is asked for.
_FAR = 1 << 20
_POSTS = "key long, side int, name string, pos int"
_ENDS = "key long, block long, side int, name string, pos int"


def lower_ascii(name: Column) -> Column:
    """A-Z as a-z, all other characters as they are."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _points(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all names in a row, each name's first and its length."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    data = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.cumsum(lengths) - lengths, lengths


def _grams(names: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, name and position of every q-gram, by name and position."""
    data, first, lengths = _points(names)
    counts = np.maximum(lengths - q + 1, 0)
    owner = np.repeat(np.arange(len(names)), counts)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, out = first[owner] + pos, np.full(len(owner), q, np.uint64)
    for k in range(q):
        out = mix(out * _U(0xC4CEB9FE1A85EC53) + data[at + k].astype(np.uint64))
    return out, owner, pos


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(48)).astype(np.int64) % SLOTS


def _counting(q: int):
    def count(batches):
        for batch in sliced(batches, 2000):
            found = np.bincount(_slots(_grams(batch.column("name").to_pylist(), q)[0]), minlength=SLOTS)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["slot", "n"])

    return count


def _table(counts: DataFrame) -> np.ndarray:
    """counts (slot, n) as an array over all slots: of the same size for any input."""
    out = np.zeros(SLOTS, np.int64)
    for row in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row.slot] = row.n
    return out


def prefixes(names: list[str], counts: np.ndarray, q: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, name and position of the grams of each name's prefix, and which names are too short to have one.

    Grams are ordered by the count of their slot, rarest first, then by hash. A prefix is the shortest one
    whose grams can't all be destroyed by `most` operations; as one operation, an exchange at worst, destroys
    grams at q + 1 consecutive positions only, it ends with the gram that makes a cover by windows of that
    width need one window more. Of two names within the distance the one whose prefix ends earlier keeps one of its grams, and the other has it
    at most `most` positions away. That is in the other's prefix too, or it is a later place of the prefix's last gram: later by no more
    places than operations can make grams, so as many more of its places are added.
    """
    hashes, owner, pos = _grams(names, q)
    count = counts[_slots(hashes)]
    order = np.lexsort((pos, hashes, count, owner))
    hashes, owner, pos = hashes[order], owner[order], pos[order]
    own = np.bincount(owner, minlength=len(names))
    first = np.cumsum(own) - own
    widest = most * (q + 1) + 1
    taken = np.full((len(names), widest), np.iinfo(np.int64).max)
    rank = np.arange(len(owner)) - first[owner]
    few = rank < widest
    taken[owner[few], rank[few]] = pos[few]
    needed = np.zeros(len(names), np.int64)
    for m in range(most + 1, widest + 1):
        places, end, windows = np.sort(taken[:, :m], axis=1), np.full(len(names), -1), np.zeros(len(names), np.int64)
        for k in range(m):
            new = (places[:, k] > end) & (places[:, k] < np.iinfo(np.int64).max)
            windows += new
            end = np.where(new, places[:, k] + q, end)
        needed[(needed == 0) & (windows > most) & (own >= m)] = m
    short = needed == 0
    last = hashes[np.minimum(first + needed - 1, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(len(names), np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(owner) else rank
    time = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
    within = ~short[owner] & ((rank < needed[owner]) | ((hashes == last[owner]) & (time < widest + most * (q + 1))))
    return hashes[within], owner[within], pos[within], short


def _posting(side: int, counts: np.ndarray, q: int, most: int):
    """Rows (key, side, name, pos) of each name for each gram of its prefix: one on the left side, for its own length and range of places; on the right
    side one for each length and range that may meet its own.

    Names of which one is too short for a prefix meet by their lengths alone: short ones of the left in one range of keys, short
    ones of the right with longer ones of the left in another.
    """
    longest = most * (q + 1) + q - 1  # of the names without a prefix

    def post(batches):
        with np.errstate(over="ignore"):
            for batch in sliced(batches, 2000):
                names = batch.column("name").to_pylist()
                lengths = np.fromiter(map(len, names), np.int64, len(names))
                hashes, owner, pos, short = prefixes(names, counts, q, most)
                kept = [(hashes, owner, pos)]
                near = np.flatnonzero(lengths <= longest + most)
                # kind 1: the left name is short; kind 2: it isn't, and the right name is
                kinds = ((1, near[short[near]]), (2, near[~short[near]])) if side == 0 else ((1, near), (2, near[short[near]]))
                for kind, own in kinds:
                    kept.append((np.full(len(own), kind, np.uint64), own, np.zeros(len(own), np.int64)))
                hashes, owner, pos = (np.concatenate(x) for x in zip(*kept))
                for step in range(-most, most + 1) if side else (0,):
                    for shift in (-most, most) if side else (0,):
                        places = np.where(hashes < 3, 0, (pos + shift) // PLACES)
                        some = slice(None) if shift <= 0 else np.flatnonzero(places != np.where(hashes < 3, 0, (pos - shift) // PLACES))
                        own = owner[some]
                        key = mix(mix(hashes[some] * _U(0x9E3779B97F4A7C15) + (lengths[own] + step).astype(np.uint64)) + places[some].astype(np.uint64)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), side, np.int32)), batch.column("name").take(pa.array(own)), pa.array(pos[some].astype(np.int32))], names=["key", "side", "name", "pos"])

    return post


def _dealing(sides: tuple[np.ndarray, np.ndarray]):
    """Give each posting a block of its own side, and one row for each block of the other."""

    def deal(batches):
        with np.errstate(over="ignore"):
            for batch in sliced(batches, 2000):
                key = batch.column("key").to_numpy()
                side = batch.column("side").to_numpy()
                slot = _slots(key.view(np.uint64))
                blocks = [np.maximum(-(-s[slot] // BLOCK), 1) for s in sides]
                spread = mix(np.arange(1, len(key) + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + key.view(np.uint64)) >> _U(1)
                mine, theirs = np.where(side == 0, *blocks), np.where(side == 1, *blocks)
                own = (spread % mine.astype(np.uint64)).astype(np.int64)
                rows = np.repeat(np.arange(len(key)), theirs)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(theirs) - theirs, theirs)
                left, right = np.where(side[rows] == 0, own[rows], other), np.where(side[rows] == 0, other, own[rows])
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([out.column("key"), pa.array(left * (1 << 31) + right), *(out.column(c) for c in ("side", "name", "pos"))], names=["key", "block", "side", "name", "pos"])

    return deal


def _matrix(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, width: int, pad: int) -> np.ndarray:
    at = first[:, None] + np.arange(width)
    return np.where(np.arange(width) < lengths[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.uint32(pad), np.uint32(pad))


def distances(left: list[str], right: list[str], most: int) -> np.ndarray:
    """Optimal string alignment distance of each pair, or _FAR where it is over `most`; only the 2 * most + 1 diagonals in reach are worked out."""
    out = np.full(len(left), _FAR, np.int64)
    a_data, a_first, a_len = _points(left)
    b_data, b_first, b_len = _points(right)
    order = np.argsort(a_len, kind="stable")
    order = order[np.abs(a_len - b_len)[order] <= most]
    begin = 0
    while begin < len(order):
        end = begin + max(1, CELLS // (int(a_len[order[min(begin + PAIRS, len(order)) - 1]]) + most + 1))
        now = order[begin:end]
        begin += len(now)
        la, lb = a_len[now], b_len[now]
        rows = int(la.max())
        a, b = _matrix(a_data, a_first[now], la, rows, 0xFFFFFFFF), _matrix(b_data, b_first[now], lb, rows + most, 0xFFFFFFFE)
        wide = 2 * most + 1
        before, last = np.full((wide, len(now)), _FAR), np.full((wide, len(now)), _FAR)
        last[most:] = np.arange(most + 1)[:, None]
        done = np.where(la == 0, lb, _FAR)
        for i in range(1, rows + 1):
            here = np.full((wide, len(now)), _FAR)
            for d in range(wide):
                j = i + d - most
                if j < 0:
                    continue
                if j == 0:
                    here[d] = i
                    continue
                best = last[d] + (a[:, i - 1] != b[:, j - 1])
                if d + 1 < wide:
                    np.minimum(best, last[d + 1] + 1, out=best)
                if d:
                    np.minimum(best, here[d - 1] + 1, out=best)
                if i > 1 and j > 1:
                    swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                    np.minimum(best, np.where(swapped, before[d] + 1, _FAR), out=best)
                here[d] = best
            ended = np.flatnonzero(la == i)
            done[ended] = here[lb[ended] - i + most, ended]
            before, last = last, here
        out[now] = np.where(done <= most, done, _FAR)
    return out


def _shared(grams: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """How many grams of each row of the first matrix stand in the same row of the second, at most `most` positions away; 0 is no gram."""
    found = np.zeros(grams.shape, bool)
    for shift in range(-most, most + 1):
        a, b = max(0, -shift), max(0, shift)
        width = min(grams.shape[1] - a, other.shape[1] - b)
        if width > 0:
            found[:, a : a + width] |= grams[:, a : a + width] == other[:, b : b + width]
    return (found & (grams != 0)).sum(axis=1)


def _marked(names: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name: how many grams it has, 64 bits of hashed grams, and the grams by position, of the first 64."""
    hashes, owner, pos = _grams(names, q)
    own = np.bincount(owner, minlength=len(names))
    bits = np.zeros(len(names), np.uint64)
    np.bitwise_or.at(bits, owner, _U(1) << (hashes >> _U(58)))
    width = int(min(own.max(initial=0), 64))
    table = np.zeros((len(names), width), np.uint64)
    seen = pos < width
    table[owner[seen], pos[seen]] = hashes[seen] | _U(1)
    return own, bits, table


def _within(names: list[str], marks: tuple[np.ndarray, np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray, q: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (left, right) of names, given by their places, that are at most `most` apart, and their distances.

    First by count filters: an operation destroys q + 1 grams at most, so of each name's grams all but most * (q + 1) must be in the
    other; that is tested on 64 bits of hashed grams, then on the grams and their positions. Names of more than 64 grams skip the second test.
    """
    own, bits, table = marks
    lost = most * (q + 1)
    a, b = bits[left], bits[right]
    both = a & b
    fit = np.flatnonzero((np.bitwise_count(a ^ both) <= lost) & (np.bitwise_count(b ^ both) <= lost))
    met = np.unique(left[fit] << 32 | right[fit])
    left, right = met >> 32, met & 0xFFFFFFFF
    fit = np.ones(len(left), bool)
    for begin in range(0, len(left), PAIRS // 8):
        i, j = left[begin : begin + PAIRS // 8], right[begin : begin + PAIRS // 8]
        far = np.maximum(own[i], own[j]) > table.shape[1]
        fit[begin : begin + PAIRS // 8] = far | ((_shared(table[i], table[j], most) >= own[i] - lost) & (_shared(table[j], table[i], most) >= own[j] - lost))
    left, right = left[fit], right[fit]
    far = distances([names[i] for i in left.tolist()], [names[j] for j in right.tolist()], most)
    near = far <= most
    return left[near], right[near], far[near]


def _matching(q: int, most: int):
    """Compare the names of each key and block; rows come sorted by both, the left side first, then by place."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table.column("name").combine_chunks().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        marks, code = _marked(names, q), code.astype(np.int64)
        key, block, side, pos = (table.column(c).to_numpy() for c in ("key", "block", "side", "pos"))
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) - 1
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        # rows of a group stand in order of their places, so those that are near enough to one are a range
        places = group << 32 | pos.astype(np.int64)
        low = np.searchsorted(places[left], places[right] - most)
        n = np.searchsorted(places[left], places[right] + most, "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(right):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            some, many = slice(at, upto), n[at:upto]
            at = upto
            first = np.repeat(low[some] - np.cumsum(many) + many, many)
            l, r = left[first + np.arange(len(first))], np.repeat(right[some], many)
            i, j, far = _within(names, marks, code[l], code[r], q, most)
            if len(i):
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(i)), coded.dictionary.take(pa.array(j)), pa.array(far.astype(np.int32))], names=["left", "right", "distance"])

    def match(batches):
        held: list[pa.RecordBatch] = []
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                if sum(b.num_rows for b in held) < 4 * BLOCK:
                    continue
                table = pa.Table.from_batches(held)
                key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
                # the last key may go on in the next batch
                done = int(np.flatnonzero((key != key[-1]) | (block != block[-1])).max(initial=-1)) + 1
                if done:
                    yield from pairs(table.slice(0, done))
                held = table.slice(done).combine_chunks().to_batches()
            if held:
                yield from pairs(pa.Table.from_batches(held))

    return match


def near_names(left: DataFrame, right: DataFrame, most: int = 2, q: int = GRAM) -> DataFrame:
    """(left, right, distance) of the names of left (name) and right (name) whose optimal string alignment distance is at most `most`.

    Each pair of different names comes once, however often the names are repeated: they are made distinct first,
    before anything moves, so a name that a third of the rows have is one name. Null and empty names take no part; other
    columns are ignored; an empty table gives no pairs. Names of any length are compared whole.

    Two tables of SLOTS counts, of fixed size, go to the driver and to the tasks: how often the grams of a slot occur,
    which orders grams, and how long the posting lists of a slot are, which says in how many blocks they are cut. Neither decides which pairs are found.
    """
    sides = [cut(side.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()) for side in (left, right)]
    counts = _table(sides[0].unionAll(sides[1]).mapInArrow(_counting(q), "slot long, n long"))
    posted = [cut(side.mapInArrow(_posting(k, counts, q, most), _POSTS)) for k, side in enumerate(sides)]
    slot = F.pmod(F.shiftrightunsigned("key", 48), F.lit(SLOTS)).alias("slot")
    lists = tuple(_table(p.groupBy(slot).agg(F.count("*").alias("n"))) for p in posted)
    dealt = posted[0].unionAll(posted[1]).mapInArrow(_dealing(lists), _ENDS)
    met = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "side", "pos")
    return met.mapInArrow(_matching(q, most), "left string, right string, distance int").distinct()


def misspelt(vendor_id: Column, name: Column) -> Column:
    """name with two neighbouring characters exchanged, at a place that the id's hash names, where that hash is even."""
    h, size = F.crc32(vendor_id.cast("string").cast("binary")), F.length(name)
    at = (h % (size - 1)).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, size))
    return F.when((h % 2 == 0) & (size >= 2), swapped).otherwise(name)


def join_by_name(clients: DataFrame, vendors: DataFrame, most: int = 2) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) for vendors (vendor_id, name) and clients (client_id, name).

    One row for each vendor and distance of at most `most` at which clients are: how many client rows, the smallest
    client_id and the sum of the ids' crc32. Names are compared as given. Repeated rows count as often as they
    stand: a pair is one client row and one vendor row. A null client_id counts as a client, but has no crc; where all are null the
    smallest is null and the sum 0. Rows of vendors with a null id are one vendor. Other columns are ignored; an empty table gives no rows.
    """
    crc = F.coalesce(F.crc32(F.col("client_id").cast("string").cast("binary")), F.lit(0))
    ours = clients.select("client_id", F.col("name").cast("string").alias("left")).where("left <> ''").groupBy("left").agg(F.count("*").alias("n"), F.min("client_id").alias("least"), F.sum(crc).alias("crc"))
    theirs = vendors.select("vendor_id", F.col("name").cast("string").alias("right")).where("right <> ''").groupBy("vendor_id", "right").agg(F.count("*").alias("times"))
    ours, theirs = cut(ours), cut(theirs)
    found = near_names(ours.select(F.col("left").alias("name")), theirs.select(F.col("right").alias("name")), most)
    met = found.join(ours, "left").join(theirs, "right")
    return met.groupBy("vendor_id", "distance").agg(F.sum(F.col("n") * F.col("times")).alias("n_clients"), F.min("least").alias("first_client_id"), F.sum(F.col("crc") * F.col("times")).alias("clients_crc"))
