"""Texts that models are given, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATTER = "millrace-v1"


def _context(scope: Column | None, symbols: Column | None, imports: Column | None, heads: tuple[str, str, str]) -> list[Column]:
    """Lines for scope, defined symbols and imports; nothing for those that are absent or empty."""
    none = F.array().cast("array<string>")
    out = []
    if scope is not None:
        named = F.array_join(F.transform(scope, lambda s: F.concat_ws(" ", s["kind"], s["name"])), " > ")
        out.append(F.when(F.size(scope) > 0, F.array(F.concat(F.lit(heads[0]), named))).otherwise(none))
    if symbols is not None:
        out.append(F.transform(symbols, lambda s: F.concat(F.lit(heads[1]), s["kind"], F.lit(" "), s["signature"])))
    if imports is not None:
        bound = lambda i: F.when(F.size(i["bindings"]) == 0, i["source"]).otherwise(F.concat(F.array_join(i["bindings"], ", "), F.lit(" from "), i["source"]))
        out.append(F.transform(imports, lambda i: F.concat(F.lit(heads[2]), bound(i))))
    return out


def embedding_input(path: Column, language: Column, content: Column, kind: Column | None = None, scope: Column | None = None, symbols: Column | None = None, imports: Column | None = None, prefix: str = "", suffix: str = "") -> Column:
    """A chunk's text for the embedding model: header lines, a blank line, the content."""
    lines = [F.concat(F.lit("path: "), path), F.concat(F.lit("language: "), language)]
    if kind is not None:
        lines.append(F.concat(F.lit("kind: "), kind))  # null is left out by concat_ws
    header = F.concat_ws("\n", F.lit(f"formatter: {FORMATTER}"), *lines, *_context(scope, symbols, imports, ("scope: ", "defines: ", "imports: ")))
    return F.concat(F.lit(prefix), header, F.lit("\n\n"), content, F.lit(suffix))


def rerank_candidate(path: Column, language: Column, content: Column, scope: Column | None = None, symbols: Column | None = None, imports: Column | None = None) -> Column:
    """A result's text for the reranker."""
    header = F.concat_ws("\n", F.concat(F.lit("Path: "), path), F.concat(F.lit("Language: "), language), *_context(scope, symbols, imports, ("Scope: ", "Defines: ", "Imports: ")))
    return F.concat(header, F.lit("\nCode:\n"), content)
