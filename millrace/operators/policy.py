"""Indexing policies: whether and how a file is indexed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.classification import TRAITS

EXCLUDED = ("generated", "minified", "lockfile", "configuration")
LIMIT = 10 * 1024 * 1024


def _decision(action: str, reason: Column | str | None = None, strategy: Column | str | None = None, trait: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(action).alias("action"), as_column(reason).alias("reason"), as_column(strategy).alias("strategy"), as_column(trait).alias("trait"))


def code_only(kind: Column, size: Column, language: Column, traits: Column, parses: Column, excluded: tuple[str, ...] = EXCLUDED, limit: int = LIMIT, oversized: str = "skip") -> Column:
    """Struct (action, reason, strategy, trait): index only code that a parser reads. oversized: skip or reject."""
    barred = F.try_element_at(F.filter(F.array(*(F.lit(x) for x in TRAITS if x in excluded)), lambda t: F.array_contains(traits, t)), F.lit(1)) if excluded else F.lit(None).cast("string")
    return (
        F.when(kind == "binary", _decision("skip", "binary-content")).when(kind == "unknown", _decision("skip", "unknown-content"))
        .when((size == 0) | F.array_contains(traits, "empty"), _decision("skip", "empty-file")).when(language.isNull(), _decision("skip", "plain-text"))
        .when(barred.isNotNull(), _decision("skip", "excluded-trait", trait=barred)).when(size > limit, _decision(oversized, "file-too-large"))
        .when(~parses, _decision("skip", "cast-parser-unavailable")).otherwise(_decision("index", strategy="cast"))
    )


def text_and_code(kind: Column, size: Column, traits: Column, parses: Column, limit: int = LIMIT) -> Column:
    """Struct as of code_only: index every text, by its parser or else by windows."""
    strategy = F.when(parses, F.lit("cast")).otherwise(F.lit("sliding-window"))
    return (
        F.when(kind == "binary", _decision("skip", "binary-content")).when(kind == "unknown", _decision("skip", "unknown-content"))
        .when((size == 0) | F.array_contains(traits, "empty"), _decision("skip", "empty-file")).when(size > limit, _decision("skip", "file-too-large"))
        .otherwise(_decision("index", strategy=strategy))
    )
