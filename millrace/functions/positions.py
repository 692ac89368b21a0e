"""Lines and UTF-16 offsets of text."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of the character at a 0-based offset; LF, CRLF and a lone CR end lines."""
    before = F.substring(text, F.lit(1), offset)
    breaks = F.regexp_count(before, F.lit("\r\n|\r|\n"))
    # between CR and LF the break isn't over yet
    split = F.endswith(before, F.lit("\r")) & (F.substring(text, offset + 1, F.lit(1)) == "\n")
    return breaks - split.cast("int") + 1


# Fixed value: what counts as white space.
BLANK = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BREAK = re.compile(r"\r\n|\r|\n")


class Lines:
    """Line starts of one text, for work inside a task."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in _BREAK.finditer(text))]

    def at(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """First and last line of text[start:end]."""
        return self.at(start), self.at(end - 1)


class Utf8Offsets:
    """From places by line and UTF-8 byte, as parsers give them, to offsets in UTF-16 units."""

    def __init__(self, text: str):
        self.lines, self.starts, at = [], [], 0
        for line in _LINES.findall(text):
            self.lines.append(line)
            self.starts.append(at)
            at += units(line)

    def at(self, line: int, byte: int) -> int:
        """The offset of a byte in a 1-based line."""
        own = self.lines[line - 1]
        return self.starts[line - 1] + (byte if own.isascii() else units(own.encode("utf-8")[:byte].decode("utf-8", "ignore")))


_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z|\Z")


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def byte_to_unit(text: Column, byte: Column) -> Column:
    """The offset in UTF-16 units of a byte offset in the UTF-8 form of text; a byte inside a character counts as its start."""
    head = F.substring(text.cast("binary"), F.lit(1), byte)
    # bytes that begin a character, and one more unit for each four-byte one
    whole = F.regexp_replace(F.hex(head), "(..)", "$1 ")
    return (F.regexp_count(whole, F.lit("(?:[0-7C-F].) ")) + F.regexp_count(whole, F.lit("F. "))).cast("int") - F.when(byte >= F.octet_length(text), 0).otherwise(_partial(text, byte))


def _partial(text: Column, byte: Column) -> Column:
    """Units that were counted for a character which begins before the byte and ends after it."""
    raw = F.hex(F.substring(text.cast("binary"), byte + 1, F.lit(1)))
    inside = F.regexp_like(raw, F.lit("^[89AB]"))
    lead = F.regexp_extract(F.hex(F.substring(text.cast("binary"), F.lit(1), byte)), "([C-F].)(?:[89AB].)*$", 1)
    return F.when(inside, F.when(lead.startswith("F"), 2).otherwise(1)).otherwise(0)
