"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, mix, sliced

_U = np.uint64
_SPACE = "▁"
#: No piece goes beyond such a chunk: a space begins a piece, and a line feed is a byte of its own.
_CHUNK = re.compile(f"\n|{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+")
_MASK = (1 << 64) - 1
_PIECE, _PLACE, _FIRST, _SECOND = 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_NONE, _EMPTY = 1 << 30, -1 << 62
#: Chunks of up to so many symbols go through the agenda together.
_WIDTHS = np.array([1, 2, 4, 6, 8, 10, 12, 16, 20, 26, 34, 48, 62])


class Vocabulary:
    """Pieces of a merge-type model: ids of characters and bytes, and for each mergeable pair its rank and id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte, normal = [0] * 256, {}
        self.text = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal[piece] = i
                self.text[i] = piece.replace(_SPACE, " ").encode()
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        by_score = sorted(normal, key=lambda p: (-model.get_score(normal[p]), normal[p]))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, piece in enumerate(by_score):
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (rank, normal[piece])
        self.table = Pairs(self.pairs)
        self.by_point = np.full(0x110000, -1, np.int32)
        self.by_point[[ord(c) for c in self.single]] = list(self.single.values())

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts before it."""
        data = b"".join(map(self.text.__getitem__, ids))
        return data[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _skipped(key: int, code: int, bound: int) -> bool:
    """Whether the candidate `code` is skipped in the occurrence `key`; as _skips, for one."""
    x = (key ^ code) * _FIRST & _MASK
    return (x ^ x >> 32) * _SECOND & _MASK < bound


def _skips(keys: np.ndarray, codes: np.ndarray, bound: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ codes) * _U(_FIRST)
        return (x ^ (x >> _U(32))) * _U(_SECOND) < _U(bound)


class Pairs:
    """The mergeable pairs as a hash table of arrays, looked up many at a time."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        rank, made = (np.array([v[k] for v in pairs.values()], np.int32) for k in (0, 1))
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made
        self.bits = max(10, (4 * len(pairs) - 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, _EMPTY, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        keys = left << 32 | right
        slots, left_over = self._slots(keys), np.arange(len(keys))
        while len(left_over):
            free = left_over[self.keys[slots[left_over]] == _EMPTY]
            self.keys[slots[free]], self.ranks[slots[free]] = keys[free], rank[free]  # the last of several for one slot stays
            left_over = left_over[self.keys[slots[left_over]] != keys[left_over]]
            slots[left_over] = slots[left_over] + 1 & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) * _U(_PLACE)
            return ((x ^ x >> _U(32)) * _U(_SECOND) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each left symbol with the right one, _NONE if there is none."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        held, out = self.keys[slots], self.ranks[slots]
        missed = np.flatnonzero(held != keys)
        out[missed] = _NONE
        missed = missed[held[missed] != _EMPTY]
        while len(missed):
            slots[missed] = slots[missed] + 1 & (1 << self.bits) - 1
            held = self.keys[slots[missed]]
            hit = held == keys[missed]
            out[missed[hit]] = self.ranks[slots[missed[hit]]]
            missed = missed[~hit & (held != _EMPTY)]
        return out


class Lists:
    """Lists of numbers one after another in a growing array."""

    def __init__(self, kind):
        self.flat, self.begin, self.used, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0, 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Append lists of the given sizes, their values in one array."""
        for name, need in (("flat", self.used + len(values)), ("begin", self.n + len(sizes) + 1)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * need))
        self.flat[self.used : self.used + len(values)] = values
        self.begin[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(values), self.n + len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the lists named, one after another, and each one's size."""
        sizes = self.begin[which + 1] - self.begin[which]
        return self.flat[_ranges(self.begin[which], sizes)], sizes


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts under a seed; remembers up to `most` chunks: their symbols, candidates and ids where none is skipped.

    Where a candidate is skipped, the agendas of all such chunks of a block of texts run side by side in arrays; chunks of more than
    `short` symbols or with symbols out of the vocabulary run one by one.
    """

    def __init__(self, path: str, seed: int, dropout: float, most: int = 400_000, short: int = 62):
        self.short = short
        self.vocabulary, self.seed, self.most = vocabulary(path), seed, most
        self.bound = min(int(dropout * 2.0**64), _MASK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.symbols, self.codes, self.ids = Lists(np.int32), Lists(np.uint64), Lists(np.int32)
        self.hard = np.zeros(1 << 10, bool)

    def segment(self, chunk: str, key: int, bound: int) -> tuple[tuple[int, ...], list[tuple[int, bool]]]:
        """Ids of one chunk, and the candidates asked for: an agenda of candidate merges, best first, leftmost on ties.

        A candidate (the place where it begins and the piece that it makes) is skipped by its hash under the
        occurrence's key as it comes to the agenda; what else merges goes on.
        """
        single, pairs, asked = self.vocabulary.single, self.vocabulary.pairs, []
        symbols = [single.get(c, -1) for c in chunk]

        def skips(made: int, place: int) -> bool:
            code = made * _PIECE + place * _PLACE & _MASK
            skip = _skipped(key, code, bound)
            asked.append((code, skip))
            return skip

        if len(symbols) <= self.short:
            return self._short(chunk, symbols, skips), asked
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found and not skips(found[1], i):
                agenda.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, made, left, right = heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -2
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    found = pairs.get((symbols[a], symbols[b]))
                    if found and not skips(found[1], a):
                        heappush(agenda, (found[0], a, found[1], symbols[a], symbols[b]))
        out = []
        for i, symbol in enumerate(symbols):
            if symbol >= 0:
                out.append(symbol)
            elif symbol == -1:
                # a bar that stands for itself comes as its three bytes, so that it doesn't decode to a space
                out += map(self.vocabulary.byte.__getitem__, ("▁" if chunk[i] == "\x00" and chunk == "\x00" else chunk[i]).encode("utf-8", "replace"))
        return tuple(out), asked

    def _short(self, chunk: str, symbols: list[int], skips) -> tuple[int, ...]:
        """As segment does, with the agenda of a short chunk as a list by place."""
        get = self.vocabulary.pairs.get
        places = list(range(len(symbols)))
        # rank of the merge of each symbol with the next, _NONE if there is none or it is skipped
        ranks, made = [], []
        for i in range(len(symbols) - 1):
            found = get((symbols[i], symbols[i + 1]))
            live = found and not skips(found[1], i)
            ranks.append(found[0] if live else _NONE)
            made.append(found[1] if live else -1)
        ranks.append(_NONE)
        made.append(-1)
        while (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            symbols[i] = made[i]
            del symbols[i + 1], ranks[i + 1], made[i + 1], places[i + 1]
            for j in (i - 1, i):
                if j < 0:
                    continue
                found = get((symbols[j], symbols[j + 1])) if j + 1 < len(symbols) else None
                if found and not skips(found[1], places[j]):
                    ranks[j], made[j] = found
                else:
                    ranks[j] = _NONE
        if -1 not in symbols:
            return tuple(symbols)
        out = []
        for symbol, place in zip(symbols, places):
            if symbol >= 0:
                out.append(symbol)
            else:
                out += map(self.vocabulary.byte.__getitem__, chunk[place].encode("utf-8", "replace"))
        return tuple(out)

    def encode(self, text: str, key: int) -> array:
        """Ids of a text; key (the document's), seed and each chunk's position choose what is skipped in it."""
        return array("I", self.encode_all([text], [key])[0].tolist())

    def encode_all(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text. A text that holds U+2581 itself is encoded in parts: these come as bytes, the text between them as ever."""
        parts, own, of = [], [], []
        for i, (text, key) in enumerate(zip(texts, keys)):
            if not text:
                continue
            for k, part in enumerate(text.split(_SPACE)):
                marked = part.replace(" ", _SPACE)
                parts.append(marked if k else _SPACE + marked)
                own.append(key + k & _MASK)
                of.append(i)
        found, out = self._block(parts, own), [np.zeros(0, np.uint32)] * len(texts)
        bar = np.array([self.vocabulary.byte[b] for b in _SPACE.encode()], np.uint32)
        at = 0
        while at < len(of):
            end = at + 1
            while end < len(of) and of[end] == of[at]:
                end += 1
            pieces = [x for k in range(at, end) for x in ((bar, found[k]) if k > at else (found[k],))]
            out[of[at]] = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
            at = end
        return out

    def _block(self, parts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each part, all at once."""
        if len(self.known) > self.most:
            self._forget()
        split = [_CHUNK.findall(part) for part in parts]
        chunks = list(chain.from_iterable(split))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        del split
        self._learn([c for c in dict.fromkeys(chunks) if c not in self.known])
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        first = np.cumsum(counts) - counts
        drawn, dropped = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if self.bound and len(which):
            with np.errstate(over="ignore"):
                place = _ranges(np.ones(len(counts), np.int64), counts).astype(np.uint64)
                drawn = mix(place * _U(0x9E3779B97F4A7C15) + np.repeat(np.array(keys, np.uint64), counts) ^ mix(np.array([self.seed & _MASK], np.uint64)))
            codes, sizes = self.codes.take(which)
            owner = np.repeat(np.arange(len(which)), sizes)
            dropped = np.unique(owner[_skips(drawn[owner], codes, self.bound)])
        sizes = self.ids.begin[which + 1] - self.ids.begin[which]
        made = []
        for rows in self._alike(which[dropped]):
            rows = dropped[rows]
            if self.hard[which[rows[0]]]:
                ids = [self.segment(chunks[i], k, self.bound)[0] for i, k in zip(rows.tolist(), drawn[rows].tolist())]
                values, n = np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
            else:
                values, n, _ = self._agendas(which[rows], drawn[rows])
            sizes[rows] = n
            made.append((rows, values))
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        plain = np.ones(len(which), bool)
        plain[dropped] = False
        out[_ranges((ends - sizes)[plain], sizes[plain])] = self.ids.take(which[plain])[0]
        for rows, values in made:
            out[_ranges((ends - sizes)[rows], sizes[rows])] = values
        edge = np.concatenate([[0], ends])
        return [out[edge[a] : edge[b]] for a, b in zip(first.tolist(), (first + counts).tolist())]

    def _alike(self, which: np.ndarray):
        """Places of chunks that go through the agenda together: hard ones, the others by size."""
        sizes = self.symbols.begin[which + 1] - self.symbols.begin[which]
        group = np.where(self.hard[which], -1, np.searchsorted(_WIDTHS, sizes))
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order])) + 1
        return [rows[i : i + 65536] for rows in np.split(order, edges) for i in range(0, len(rows), 65536)] if len(which) else []

    def _learn(self, chunks: list[str]) -> None:
        """Take in new chunks: their symbols, the candidates asked for and the ids, without dropout."""
        if not chunks:
            return
        begin, sizes = len(self.known), np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.vocabulary.by_point[points]
        hard = (sizes > self.short) | np.logical_or.reduceat(symbols < 0, np.cumsum(sizes) - sizes)
        self.symbols.extend(symbols, sizes)
        if begin + len(chunks) > len(self.hard):
            self.hard = np.resize(self.hard, 2 * (begin + len(chunks)))
        self.hard[begin : begin + len(chunks)] = hard
        self.known.update(zip(chunks, range(begin, begin + len(chunks))))
        made, asked = [], []
        for rows in self._alike(np.arange(begin, begin + len(chunks))):
            if hard[rows[0]]:
                found = [self.segment(chunks[i], 0, 0) for i in rows.tolist()]
                values, n = np.array([x for ids, _ in found for x in ids], np.int32), np.array([len(ids) for ids, _ in found])
                owner, code = np.repeat(np.arange(len(rows)), [len(c) for _, c in found]), np.array([x for _, c in found for x, _ in c], np.uint64)
            else:
                values, n, (owner, code) = self._agendas(begin + rows, None)
                order = np.argsort(owner, kind="stable")
                owner, code = owner[order], code[order]
            made.append((rows, values, n))
            asked.append((rows, code, np.bincount(owner, minlength=len(rows))))
        for lists, parts in ((self.ids, made), (self.codes, asked)):
            sizes = np.zeros(len(chunks), np.int64)
            for rows, _, n in parts:
                sizes[rows] = n
            ends = np.cumsum(sizes)
            flat = np.empty(int(ends[-1]), lists.flat.dtype)
            for rows, values, n in parts:
                flat[_ranges((ends - sizes)[rows], n)] = values
            lists.extend(flat, sizes)

    def _agendas(self, which: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The agendas of many chunks side by side: in each round every chunk makes its best merge, the leftmost on ties.

        keys are the occurrences', None to skip nothing. Returns the ids, each chunk's number of them, and all candidates asked for:
        of which chunk, and their codes.
        """
        pairs = self.vocabulary.table
        given, sizes = self.symbols.take(which)
        n, width = len(which), int(sizes.max()) + 2
        # the first column and those after a chunk's end are walls
        symbols = np.full(n * width, -1, np.int32)
        symbols[_ranges(np.arange(n) * width + 1, sizes)] = given
        rank = np.full(n * width, _NONE, np.int32)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
        asked: list[tuple[np.ndarray, np.ndarray]] = []

        def offer(rows: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
            """Put the merges found at places into the agendas but those that are skipped."""
            some = np.flatnonzero(found < _NONE)
            with np.errstate(over="ignore"):
                code = pairs.made[found[some]].astype(np.uint64) * _U(_PIECE) + (at[some] - rows[some] * width - 1).astype(np.uint64) * _U(_PLACE)
            if keys is None:
                asked.append((rows[some], code))
            else:
                found[some[_skips(keys[rows[some]], code, self.bound)]] = _NONE
            rank[at] = found

        at = _ranges(np.arange(n) * width + 1, sizes - 1)
        offer(np.repeat(np.arange(n), sizes - 1), at, pairs(symbols[at], symbols[at + 1]))
        rows = np.arange(n)
        while len(rows):
            now = rank.reshape(n, width)[rows]
            column = now.argmin(axis=1)
            best = now[np.arange(len(rows)), column]
            live = best < _NONE
            rows, column, best = rows[live], column[live], best[live]
            if not len(rows):
                break
            base = rows * width
            i = base + column
            j = base + after[i]
            made = pairs.made[best]
            symbols[i], symbols[j], rank[j] = made, -2, _NONE
            k = base + after[j]
            after[i], before[k] = after[j], column
            offer(rows, i, pairs(made, symbols[k]))
            h = base + before[i]
            offer(rows, h, pairs(symbols[h], made))
        kept = symbols.reshape(n, width) >= 0
        owner = np.concatenate([a for a, _ in asked]) if asked else np.zeros(0, np.int64)
        return symbols[kept.ravel()], kept.sum(axis=1), (owner, np.concatenate([c for _, c in asked]) if asked else np.zeros(0, np.uint64))


def _encoding(path: str, seed: int, dropout: float, with_ids: bool):
    def encode(batches):
        encoder = Encoder(path, seed, dropout)
        for batch in batches:
            for part in sliced([batch]):
                n, crc, digest, same, ids_ = [], [], [], [], []
                texts, keys = [t or "" for t in part.column("text").to_pylist()], [k & _MASK for k in part.column("key").to_pylist()]
                found = (ids for begin, end in blocks(texts) for ids in encoder.encode_all(texts[begin:end], keys[begin:end]))
                for text, ids in zip(texts, found):
                    back = encoder.vocabulary.decode(ids.tolist())
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    digest.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == text)
                    if with_ids:
                        ids_.append(ids.tobytes())
                made = [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())] + [pa.array(ids_, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"] + ["ids"] * with_ids)

    return encode


def encode(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1, with_ids: bool = False) -> DataFrame:
    """Encode every text of docs (doc_id, text) under seed, and decode it again.

    Returns doc_id, n_tokens, ids_crc32 (of the little-endian unsigned 32-bit ids), decoded_sha256 (of the text read back from
    the ids), lossless (whether it is the text) and, if asked for, ids. The same seed, doc_id and text give the same ids; without dropout they
    are the model's own. U+2581 in a text is encoded as bytes, so that it reads back. A null text is
    empty and has no ids; repeated rows stay; null ids are kept; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids binary" * with_ids
    return docs.select("doc_id", F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_encoding(path, seed, dropout, with_ids), schema)
