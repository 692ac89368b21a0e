"""Chunkers: windows of text, and syntax-guided splitting; one document to many chunks, in its task."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.positions import BLANK, Lines
from millrace.functions.positions import units as utf16_units
from millrace.syntax.cast import Fragment, context, fragments
from millrace.syntax.registry import Registry, standard
from millrace.syntax.tree import ParseFailure, Tree

# Delimiters by preference.
WINDOW_DELIMITERS = ("\n\n", "\n", " ")
LEAF_DELIMITERS = ("\n\n", "\n", ";", ",", "\t", " ")


class Units:
    """A text addressed in UTF-16 units; plain slicing where no character is beyond the basic plane."""

    def __init__(self, text: str):
        self.wide = utf16_units(text) > len(text)
        self.text = text if not self.wide else "".join(c if c <= "\uffff" else chr(0xD800 + (ord(c) - 0x10000 >> 10)) + chr(0xDC00 + (ord(c) - 0x10000 & 0x3FF)) for c in text)

    def slice(self, start: int, end: int) -> str:
        part = self.text[start:end]
        return part if not self.wide else part.encode("utf-16-le", "surrogatepass").decode("utf-16-le")

    def whole(self, text: str) -> str:
        """A part of the text as it was written, surrogates joined; a lone one is replaced."""
        return text if not self.wide else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def splits(self, at: int) -> bool:
        """Whether a cut at `at` would part a surrogate pair."""
        return self.wide and 0 < at < len(self.text) and "\udc00" <= self.text[at] <= "\udfff" and "\ud800" <= self.text[at - 1] <= "\udbff"


def check_window(most: int, overlap: int) -> None:
    if most < 1 or overlap < 0 or overlap >= most:
        raise ValueError(f"windows need most >= 1 and 0 <= overlap < most, not {most} and {overlap}")


def windows(units: Units, most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of windows of about `most` units, cut after a delimiter in their second half where there is one."""
    text, size, out, start = units.text, len(units.text), [], 0
    while start < size:
        reach = min(size, start + most)
        end = reach
        if reach < size:
            half = start + (reach - start) // 2
            for mark in WINDOW_DELIMITERS:
                # a mark may begin at the window's last unit and so end beyond it
                found = text.rfind(mark, half, reach - 1 + len(mark))
                if found >= half:
                    end = found + len(mark)
                    break
        if units.splits(end):
            end = end - 1 if end - 1 > start else end + 1
        out.append((start, end))
        if end >= size:
            break
        start = max(start + 1, end - overlap)
        if units.splits(start):
            start += 1
    return out


def leaf_cuts(units: Units, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Cut a range that no syntax divides: after the last delimiter in a part's second half, else at most units."""
    text, out = units.text, []
    while end - start > most:
        reach = start + most
        half = start + most // 2
        cut = next((at + len(m) for m in LEAF_DELIMITERS if (at := text.rfind(m, half, reach)) >= half), reach)
        if units.splits(cut):
            cut = cut - 1 if cut - 1 > start else cut + 1
        out.append((start, cut))
        start = cut
    return [*out, (start, end)] if end > start else out


def syntax_fragments(units: Units, most: int, language: str | None, format_: str | None = None, registry: Registry | None = None) -> tuple[list[Fragment], Tree]:
    """Fragments along the tree of a text, and the tree; a text that no parser reads is a ParseFailure."""
    tree = (registry or _standard()).parse(units.text, language, format_)
    return fragments(units.text, tree, most, lambda start, end: leaf_cuts(units, start, end, most)), tree


def syntax_chunks(units: Units, most: int, language: str) -> list[tuple[int, int]]:
    """Contiguous ranges of about `most` units at most along the text's syntax; where no parser reads it, cut as a leaf."""
    try:
        return [(f.start, f.end) for f in syntax_fragments(units, most, language)[0]]
    except ParseFailure:
        return leaf_cuts(units, 0, len(units.text), most)


@lru_cache(maxsize=1)
def _standard() -> Registry:
    return standard()


_SYMBOLS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string())]))
_IMPORTS = pa.list_(pa.struct([("source", pa.string()), ("bindings", pa.list_(pa.string()))]))
_PLACES = "chunk_index int, start_offset int, end_offset int, start_line int, end_line int, content string"
_SAID = "kind string, scope array<struct<name:string,kind:string,signature:string>>, symbols array<struct<name:string,kind:string,signature:string>>, imports array<struct<source:string,bindings:array<string>>>, searchable boolean, error string"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to as many tasks as the session shuffles to, and as it runs at once at least, before costly work on each row: a file's rows may all come in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _windowed(units: Units, most: int, overlap: int):
    for start, end in windows(units, most, overlap):
        yield Fragment(start, end, "text-window"), None


def _along_syntax(units: Units, most: int, language: str | None, format_: str | None, registry: Registry | None, failure: str):
    """(fragment, context) of a text; a text that isn't read gives its error in the place of the context."""
    try:
        found, tree = syntax_fragments(units, most, language, format_, registry)
    except ParseFailure as error:
        if failure == "error":
            raise
        yield from ((Fragment(a, b, None), str(error)) for a, b in ([(0, len(units.text))] if failure == "report" else leaf_cuts(units, 0, len(units.text), most)))
        return
    for part in found:
        yield part, context(units.text, tree, part)


def chunk(docs: DataFrame, strategy: str = "sliding-window", most: int = 1500, overlap: int = 200, failure: str = "leaf", registry: Registry | None = None, whole: bool = False) -> DataFrame:
    """Chunks of docs (doc_id, text; language and format for the syntax strategy): index, start and end in UTF-16 units, lines, content.

    Chunks of white space only, and blank ones that syntax leaves over, aren't searchable: they are left out, unless `whole` keeps them with a null
    index; index counts the others. Documents are dealt to tasks by their ids first, as a small file may hold very many in one piece. The syntax strategy adds the node's kind, the symbols around and in a chunk and the imports it uses, searchable, and
    error, of a text that its parser doesn't read: by `failure` that is cut as a leaf, reported in one row without an index, or raised. A null or
    empty text has no chunks.
    """
    if strategy == "sliding-window":
        check_window(most, overlap)
    elif strategy != "syntax":
        raise ValueError(f"unknown strategy {strategy!r}")
    elif most < 1 or failure not in ("leaf", "report", "error"):
        raise ValueError(f"chunks need most >= 1, and a failure is leaf, report or error, not {most} and {failure!r}")
    kind, syntax = docs.schema["doc_id"].dataType.simpleString(), strategy == "syntax"

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7 + 6 * syntax)]
            given = zip(*(batch.column(c).to_pylist() for c in ("text", "language", "format")))
            for i, (text, language, format_) in enumerate(given):
                if not text:
                    continue
                units = Units(text)
                lines, n = Lines(units.text), 0
                for part, said in _along_syntax(units, most, language, format_, registry, failure) if syntax else _windowed(units, most, overlap):
                    content = units.slice(part.start, part.end)
                    good = part.lean is None and bool(content.strip(BLANK)) and not (failure == "report" and isinstance(said, str))
                    if not good and not whole and not isinstance(said, str):
                        continue
                    row = (i, n if good else None, part.start, part.end, *lines.span(part.start, part.end), content)
                    if syntax:
                        around, inside, used = said if isinstance(said, tuple) else ([], [], [])
                        whole_ = units.whole
                        named = [[{"name": whole_(s.name), "kind": s.kind, "signature": whole_(s.signature)} for s in symbols] for symbols in (around, inside)]
                        row += (part.kind, *named, [{"source": whole_(s), "bindings": list(map(whole_, b))} for s, b in used], good, said if isinstance(said, str) else None)
                    for column, value in zip(columns, row):
                        column.append(value)
                    n += good
            index = pa.array(columns[0], pa.int64())
            kinds = [pa.int32()] * 5 + [pa.string()] + [pa.string(), _SYMBOLS, _SYMBOLS, _IMPORTS, pa.bool_(), pa.string()] * syntax
            names = ["chunk_index", "start_offset", "end_offset", "start_line", "end_line", "content"] + ["kind", "scope", "symbols", "imports", "searchable", "error"] * syntax
            made = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(index), *made], names=["doc_id", *names])

    told = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("language", "format")]
    return dealt(docs.select("doc_id", "text", *told), "doc_id").mapInArrow(run, f"doc_id {kind}, {_PLACES}" + f", {_SAID}" * syntax)
