"""Sequence packing: shortest-pack-first over the histogram of piece lengths, joined back by rank."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import cut, sliced

SALTS = 64
#: A character beyond what both libraries are known to cut alike: all but line feeds and Latin letters and marks.
_OTHER = re.compile("[^\n -~\u00a1-\u024f]")


@lru_cache(maxsize=2)
def _ranked(path: str):
    """A tiktoken encoder of the vocabulary in a tokenizers file, if that is byte-level with merges in order of ids; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> array:
    """Ids of a text by the tokenizers file at path, without special tokens added.

    Texts in Latin letters are encoded by tiktoken over the same vocabulary, merges and
    special strings, which gives the same ids in a third of the time; all others, and
    other kinds of files, by tokenizers itself.
    """
    ranked = _ranked(path)
    if ranked is not None and not _OTHER.search(text):
        return array("I", ranked.encode(text, allowed_special="all"))
    return array("I", _tokenizer(path).encode(text, add_special_tokens=False).ids)


def _cutter(path: str, end_id: int, size: int, with_ids: bool):
    def pieces(batches):
        for part in sliced(batches):
            rows = defaultdict(list)
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = encode(text or "", path)
                ids.append(end_id)
                data = ids.tobytes()
                for start in range(0, len(ids), size):
                    piece = data[4 * start : 4 * (start + size)]
                    rows["row"].append(i)
                    rows["start"].append(start)
                    rows["length"].append(len(piece) // 4)
                    rows["ids_crc32"].append(zlib.crc32(piece))
                    rows["doc_tokens"].append(len(ids))
                    if with_ids:
                        rows["ids"].append(piece)
            index = pa.array(rows.pop("row"), pa.int64())
            made = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(index), *made], names=["doc_id", *rows])

    return pieces


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, end_id included, into pieces of at most size ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids
    (little-endian unsigned 32-bit). A null text is empty: one piece, the end id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, end_id, size, with_ids), schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern for a histogram of piece lengths.

    Lengths are placed longest first. Each goes to the packs that hold the least
    so far, if it fits there, and else opens new packs; packs of one pattern move
    together, so the work depends on the number of lengths and patterns only.
    """
    room: dict[int, list[list]] = defaultdict(list)  # free space: [count, lengths] of open patterns
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(free: int, count: int, lengths: tuple[int, ...]) -> None:
        if free:
            room[free].append([count, lengths])
        else:
            done.append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((k for k, v in room.items() if v), default=0)
            if free < length:
                each = size // length  # new packs take this length as often as it fits
                if left >= each:
                    put(size - each * length, left // each, (length,) * each)
                if left % each:
                    put(size - (left % each) * length, 1, (length,) * (left % each))
                break
            count, lengths = room[free].pop()
            moved = min(count, left)
            if moved < count:
                room[free].append([count - moved, lengths])
            put(free - length, moved, (*lengths, length))
            left -= moved
    return done + [(count, lengths) for v in room.values() for count, lengths in v]


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, the first rank, first sequence and offset of each of its places in the patterns."""
    found, taken, sequence = defaultdict(list), defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            found[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in found.items()}


def _seater(places):
    def seat(batches):
        at = places.value
        for batch in sliced(batches, 20_000):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine = length == value
                first, base, start = at[value]
                slot = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine] = base[slot] + rank[mine] - first[slot]
                offset[mine] = start[slot]
            keep = [c for c in batch.schema.names if c not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return seat


def assign(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...).

    Only the histogram, at most size rows, and its patterns come to the driver. A
    piece's rank among those of its length is its rank within a salt, by (doc_id,
    start, ids_crc32), plus the pieces of the lesser salts, so a length that a third of all pieces have
    is ranked by many tasks. Pieces that equal each other in all columns may change places freely.
    """
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")))
    cells = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = cells.collect()  # at most size * SALTS rows
    histogram = defaultdict(int)
    before = []
    for row in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        before.append((row["length"], row["salt"], histogram[row["length"]]))
        histogram[row["length"]] += row["n"]
    spark = pieces.sparkSession
    places = spark.sparkContext.broadcast(_places(shortest_pack_first(dict(histogram), size)))
    ahead = spark.createDataFrame(before, "length long, salt int, ahead long")
    mine = W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(mine)).join(F.broadcast(ahead), ["length", "salt"])
    kept = [c for c in pieces.columns if c != "salt"]
    ranked = ranked.select(*kept, (F.col("rank") - 1 + F.col("ahead")).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "salt")
    return ranked.mapInArrow(_seater(places), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack every document of docs (doc_id, text) into sequences of at most size tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (and ids). A document's pieces cover its ids once and in order; the pieces of a
    sequence lie without gaps from 0. Repeated rows are packed each for itself; a null doc_id is kept; an empty
    table gives no rows; other columns are ignored.
    """
    return assign(pieces(docs, tokenizer, end_id, size, with_ids), size)
