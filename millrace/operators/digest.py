"""Digests over ordered lines, by one pass over sorted rows that holds a line at a time."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hashing(batches):
    now, n, state = None, 0, hashlib.sha256()

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([n], pa.int64()), pa.array([f"sha256:{state.hexdigest()}"])], names=["_group", "files", "membership_hash"])

    for batch in batches:
        for group, path, digest in zip(*(batch.column(c).to_pylist() for c in ("_group", "path", "hash"))):
            if group != now:
                if now is not None:
                    yield row()
                now, n, state = group, 0, hashlib.sha256()
            state.update(f"{chr(10) if n else ''}{path}\0{digest}".encode())
            n += 1
    if now is not None:
        yield row()


def ordered_digests(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, files, membership_hash) of rows (groups, path, hash): path, NUL and hash of each row in order of the paths' bytes, joined by line feeds.

    Such a hash can only be made in order, so each group's lines go through one task; but they are sorted outside of memory
    and read as a stream, so that a group may have any number of them. Without groups the rows are one. A group may be null; a null path or hash is left
    out of its set. No rows give no digest.
    """
    key = F.to_json(F.struct(*groups)).cast("binary") if groups else F.lit(b"x")
    lines = rows.where("path is not null and hash is not null").select(key.alias("_group"), "path", "hash", *groups)
    found = lines.select("_group", "path", "hash").repartition("_group").sortWithinPartitions("_group", "path", "hash").mapInArrow(_hashing, "_group binary, files long, membership_hash string")
    if not groups:
        return found.drop("_group")
    names = lines.groupBy("_group").agg(*(F.first(g).alias(g) for g in groups))
    return names.join(found, "_group").select(*groups, "files", "membership_hash")
