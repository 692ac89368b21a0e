"""Content-addressed identity as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(value: Column) -> Column:
    """`sha256:` and the hex digest of bytes or of UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def _field(value: Column) -> Column:
    data = value.cast("string").cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def identity(namespace: str, *fields: Column) -> Column:
    """namespace_hex: SHA-256 over the namespace, version 1 and the fields, each led by its length as four bytes."""
    if not re.fullmatch("[a-z]+(-[a-z]+)*", namespace):
        raise ValueError(f"not a namespace: {namespace!r}")
    parts = [_field(x) for x in (F.lit(namespace), F.lit("1"), *fields)]
    return F.concat(F.lit(f"{namespace}_"), F.sha2(F.concat(*parts), 256))


def file_revision_id(hash_: Column) -> Column:
    return identity("file-revision", hash_)


def document_id(snapshot: Column, path: Column, revision: Column) -> Column:
    return identity("document", snapshot, path, revision)


def chunk_id(revision: Column, strategy: Column, start: Column, end: Column, hash_: Column) -> Column:
    return identity("chunk", revision, strategy, start, end, hash_)


def all_equal(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two rows of columns, as of two model identities."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))
