"""Filter conditions over the closed set of metadata fields."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

# The fields that can be filtered on.
FIELDS = ("path", "language", "format", "extension", "traits", "chunkingStrategy", "chunkKind", "symbolNames", "symbolKinds", "sourceId", "tags")


@dataclass(frozen=True)
class Condition:
    """field equals one value, or is in several."""

    field: str
    operator: str
    values: tuple

    def check(self, fields: tuple[str, ...] = FIELDS) -> None:
        if self.field not in fields:
            raise ValueError(f"unknown filter field {self.field!r}")
        if self.operator not in ("equals", "in"):
            raise ValueError(f"unknown filter operator {self.operator!r}")
        if not self.values:
            raise ValueError(f"no values for {self.field!r}")
        for v in self.values:
            if not isinstance(v, str | bool | int | float) or isinstance(v, float) and not math.isfinite(v):
                raise ValueError(f"not a filter value: {v!r}")


def _same_kind(kind: DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    return isinstance(kind, StringType) if isinstance(value, str) else isinstance(kind, NumericType)


def matches(schema: StructType, conditions: list[Condition], fields: tuple[str, ...] = FIELDS) -> Column:
    """Whether all conditions hold; a missing field never matches, an array does with any element, and types aren't converted."""

    def one(c: Condition) -> Column:
        c.check(fields)
        kind = schema[c.field].dataType if c.field in schema.names else None
        if kind is None or c.operator == "equals" and len(c.values) != 1:
            return F.lit(False)
        element = kind.elementType if isinstance(kind, ArrayType) else kind
        values = [v for v in c.values if _same_kind(element, v)]
        if not values:
            return F.lit(False)
        held = F.arrays_overlap(c.field, F.array(*map(F.lit, values))) if isinstance(kind, ArrayType) else F.col(c.field).isin(*values)
        return F.coalesce(held, F.lit(False))

    return reduce(lambda a, b: a & b, map(one, conditions), F.lit(True))
