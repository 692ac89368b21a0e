"""Which buckets of a store may hold any of some ids: Bloom filters, one for each bucket of each write."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each id of a filter at least, and places that an id sets; about one id in two thousand that isn't there is taken for one that may be.
BITS, PLACES = 16, 8


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an id, 0 .. buckets - 1."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _hashed(ids: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, a, b) of each id that isn't null: two hashes of which its places in any filter are made."""
    return ids.where(F.col(key).isNotNull()).select(bucket_of(F.col(key), buckets).alias("bucket"), F.xxhash64(F.lit("a"), key).alias("a"), F.xxhash64(F.lit("b"), key).alias("b"))


def _places(ids: pa.Table, bits: int) -> np.ndarray:
    """For each id the PLACES bits that it has in a filter of so many, a power of two."""
    a, b = (ids.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    steps = np.arange(PLACES, dtype=np.uint64)
    return (a[:, None] + steps * (b | np.uint64(1))[:, None]) & np.uint64(bits - 1)


def _made(ids: pa.Table) -> pa.Table:
    bits = 1 << max(6, (BITS * len(ids) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(ids, bits)] = True
    return pa.table({"bucket": pa.array([ids.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def _claimed(ids: pa.Table, filters: pa.Table) -> pa.Table:
    """The writes whose filter of the bucket claims any of the ids."""
    claim = []
    for row in filters.to_pylist() if len(ids) else []:
        packed = np.frombuffer(row["bits"], np.uint8)
        at = _places(ids, 8 * len(packed))
        if ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1).any():
            claim.append((row["part"], row["bucket"]))
    return pa.table({"part": pa.array([p for p, _ in claim], pa.string()), "bucket": pa.array([b for _, b in claim], pa.int32())})


def filters_of(ids: DataFrame, key: str, buckets: int, part: str) -> DataFrame:
    """(bucket, bits, part): a filter of the ids of each bucket of a write; a task holds 16 bytes for each id of one bucket, and its filter."""
    return _hashed(ids, key, buckets).groupBy("bucket").applyInArrow(_made, "bucket int, bits binary").withColumn("part", F.lit(part))


def claimed_buckets(ids: DataFrame, key: str, filters: DataFrame, buckets: int) -> list[tuple[str, int]]:
    """(part, bucket) of the writes' buckets that may hold any of ids; in no other is any of them.

    Ids meet the filters of their bucket alone. What comes to the driver is at most a pair for each filter.
    """
    asked = _hashed(ids, key, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return sorted(map(tuple, asked.applyInArrow(_claimed, "part string, bucket int").collect()))
