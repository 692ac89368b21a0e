"""Shared helpers of the training-data operators: folds, durable cuts and word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not glibc
    _LIBC = None
#: One random-looking odd multiplier and its inverse modulo 2**64 drive the rolling word hash.
_ROLL = 0x9E3779B97F4A7C15
_UNROLL = pow(_ROLL, -1, 1 << 64)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Send Python at most so many rows and about so many bytes at a time: texts may be long, and a task holds a whole batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table by name; the path may be in any store that Spark's readers open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a session on this machine alone, as in tests, may do without and gets a temporary one."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(df: DataFrame) -> None:
    """Have the driver collect garbage, so that Spark's cleaner removes shuffles and checkpoints that nothing refers to from disk."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The `most` rows of least hash of key, or all if there are no more; ties by the key.

    Only rows whose hash is below a bound for about twice as many are sorted, so what
    tasks send doesn't grow with their number.
    """
    rows = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_key", key)
    n = rows.count()
    if n > 4 * most:
        few = rows.where(F.col("_hash") < F.lit(int(-(2**63) + 2**64 * 2 * most / n)))
        rows = few if few.count() >= most else rows
    return rows.orderBy("_hash", "_key").limit(most).drop("_hash", "_key")


def raw(text: Column) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(text.cast("binary"), F.expr("X''"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: What A-Z become in lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_GROWN: dict[str, np.ndarray] = {"up": _powers(_ROLL, 1 << 16), "down": _powers(_UNROLL, 1 << 16)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_GROWN["up"]) < n:
        size = 1 << (n - 1).bit_length()
        _GROWN.update(up=_powers(_ROLL, size), down=_powers(_UNROLL, size))
    return _GROWN["up"][:n], _GROWN["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's first word's index.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z taken as a-z. The
    texts are hashed together, without a Python step per word.
    """
    return _spans(texts)[:2]


def word_forms(texts: list[bytes], forms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and each word's form in 0..forms-1, a hash of its last two bytes."""
    hashes, first, data, starts, ends = _spans(texts)
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    prior = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    return hashes, first, (mix(last * _U(256) + prior + _U(1)) % _U(forms)).astype(np.int64)


def _spans(texts: list[bytes]):
    joined = b"\n".join(texts).translate(LOWER) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) > len(ends):
        starts = starts[: len(ends)]
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begin), data, starts, ends


def sliced(batches, rows: int = 512):
    """Arrow batches of at most so many rows, so that a batch of long texts isn't turned into Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def release() -> None:
    """Give memory that a task has freed back to the system: workers are used again, also by other stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes, to bound working memory."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)
