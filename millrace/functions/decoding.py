"""Which encoding a document's bytes are read in, and what comes of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.classification import SAMPLE, SIGNATURES, control_ratio, decode, sample_text
from millrace.sources.files import glob_regex

# The labels of encodings, and the largest document.
LABELS = {"utf-8": "utf-8", "utf8": "utf-8", "windows-1251": "windows-1251", "windows1251": "windows-1251", "cp1251": "windows-1251", "win1251": "windows-1251"}
LIMIT = 10 * 1024 * 1024


def label(value: str | None) -> str | None:
    """The encoding that a label names, whatever its case; another label is an error."""
    if value is None:
        return None
    found = LABELS.get(value.strip().lower())
    if found is None:
        raise ValueError(f"unsupported encoding {value!r}")
    return found


def labelled(value: Column) -> Column:
    """As `label`, of a column; a label that isn't known stays as it is, for `read` to report."""
    own = F.lower(F.trim(value))
    return F.coalesce(reduce(lambda acc, x: acc.when(own == x, F.lit(LABELS[x])), LABELS, F), own)


def selection(path: Column, own: Column | None = None, globs: list[tuple[str, str]] = (), fallback: str | None = None) -> Column:
    """Struct (override, fallback) of a document: its own encoding, else that of the first glob that its path matches."""
    by_glob = F.lit(None).cast("string")
    for pattern, encoding in reversed(list(globs)):
        by_glob = F.when(F.regexp_like(path, F.lit(f"^{glob_regex(pattern)}$")), F.lit(label(encoding))).otherwise(by_glob)
    last = label(fallback)
    if last not in (None, "windows-1251"):
        raise ValueError(f"unsupported fallback encoding {fallback!r}")
    return F.struct(F.coalesce(labelled(own), by_glob).alias("override") if own is not None else by_glob.alias("override"), F.lit(last).cast("string").alias("fallback"))


def read(data: Column, chosen: Column, limit: int = LIMIT) -> Column:
    """Struct (text, encoding, source, byte_length, error) of a whole document.

    The override is taken if there is one; else a byte-order mark or valid bytes say UTF-8; else the fallback reads
    them. What is too large, malformed or in an unknown encoding has an error and no text.
    """
    utf8, other = decode(data), decode(data, "windows-1251")
    as_1251 = _as_1251(data)
    marked = F.hex(F.substring(data, 1, 3)) == "EFBBBF"
    out = lambda text, encoding, source, error=None: F.struct(
        F.lit(None).cast("string").alias("text") if text is None else text.alias("text"), F.lit(encoding).cast("string").alias("encoding"), F.lit(source).cast("string").alias("source"),
        F.octet_length(data).cast("long").alias("byte_length"), F.lit(error).cast("string").alias("error"),
    )
    override, fallback = chosen["override"], chosen["fallback"]
    return (
        F.when(F.octet_length(data) > limit, out(None, None, None, "file-too-large"))
        .when(override.isNotNull() & ~override.isin(*set(LABELS.values())), out(None, None, "override", "unsupported-encoding"))
        .when(override == "windows-1251", out(as_1251, "windows-1251", "override"))
        .when((override == "utf-8") & utf8["text"].isNull(), out(None, "utf-8", "override", "malformed-content"))
        .when(override == "utf-8", out(utf8["text"], "utf-8", "override"))
        .when(marked & utf8["text"].isNotNull(), out(utf8["text"], "utf-8", "byte-order-mark"))
        .when(marked, out(None, "utf-8", "byte-order-mark", "malformed-content"))
        .when(utf8["text"].isNotNull(), out(utf8["text"], "utf-8", "utf-8-validation"))
        .when(fallback == "windows-1251", out(other["text"], "windows-1251", "fallback"))
        .otherwise(out(None, None, None, "malformed-content"))
    )


def _as_1251(data: Column) -> Column:
    upper = bytes(range(0x80, 0x100))
    page = "".join(bytes([b]).decode("cp1251") if b != 0x98 else "\u0098" for b in upper)
    return F.translate(F.decode(data, "ISO-8859-1"), upper.decode("latin-1"), page)


def compatible_encodings(chosen: Column) -> Column:
    """The encodings under which an earlier build may have read the same document."""
    either = F.array(F.lit("utf-8"), F.lit("windows-1251"))
    return F.when(chosen["override"].isNotNull(), F.array(chosen["override"])).when(chosen["fallback"].isNotNull(), either).otherwise(F.array(F.lit("utf-8")))


def classify(data: Column, chosen: Column, size: Column | None = None, sample: Column | None = None) -> Column:
    """Struct (kind, confidence, encoding, evidence) of a file from its first bytes, by the selected encodings; sample: its sample_text, if that is at hand.

    In order: a binary signature, a NUL byte, an empty file, no sample, then the share of control characters of the text that the override, a
    byte-order mark, valid UTF-8 or the fallback reads, and of the raw bytes where none does. evidence lists (signal, conclusion, confidence, detail).
    """
    size = F.octet_length(data) if size is None else size
    head = F.substring(data, 1, SAMPLE)
    override, fallback = chosen["override"], chosen["fallback"]
    item = lambda signal, conclusion, sure, detail: F.struct(F.lit(signal).alias("signal"), (conclusion if isinstance(conclusion, Column) else F.lit(conclusion)).alias("conclusion"), F.lit(sure).cast("double").alias("confidence"), F.lit(detail).alias("detail"))
    out = lambda kind, sure, encoding, *items: F.struct(F.lit(kind).alias("kind"), F.lit(sure).cast("double").alias("confidence"), (encoding if isinstance(encoding, Column) else F.lit(encoding)).cast("string").alias("encoding"), F.array(*items).alias("evidence"))
    steps = F
    for name, digits in SIGNATURES.items():
        steps = steps.when(F.substring(data, 1, len(digits) // 2) == F.unhex(F.lit(digits)), out("binary", 1, None, item("byte-sample", "binary", 1, f"{name} signature")))
    utf8 = sample_text(data) if sample is None else sample
    old = _as_1251(head)
    marked = F.substring(data, 1, 3) == F.unhex(F.lit("EFBBBF"))

    def told(text: Column, encoding: str, source: str, sure: float) -> Column:
        ratio = control_ratio(text)
        says = item("configuration" if source in ("override", "fallback") else "byte-sample", encoding, sure, source)
        graded = lambda kind, most: out(kind, min(most, sure), encoding, says, item("byte-sample", kind, most, "share of control characters"))
        return F.when(ratio <= 0.02, graded("text", 0.98)).when(ratio >= 0.3, graded("binary", 0.9)).otherwise(graded("unknown", 0.55))

    raw = F.regexp_replace(F.decode(head, "ISO-8859-1"), "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]", "")
    share = 1 - F.length(raw) / F.octet_length(head)
    return (
        steps.when(F.contains(head, F.unhex(F.lit("00"))), out("binary", 0.99, None, item("byte-sample", "binary", 0.99, "a NUL byte")))
        .when(size == 0, out("text", 1, F.coalesce(override, F.lit("utf-8")), item("byte-sample", F.coalesce(override, F.lit("utf-8")), 1, "nothing to read"), item("byte-sample", "text", 1, "the file is empty")))
        .when(F.octet_length(head) == 0, out("unknown", 0.2, override, item("byte-sample", "unknown", 0.2, "no bytes at hand")))
        .when(override == "windows-1251", told(old, "windows-1251", "override", 0.99)).when((override == "utf-8") & utf8.isNotNull(), told(utf8, "utf-8", "override", 0.99))
        .when(override.isNotNull(), out("unknown", 0.9, override, item("configuration", "malformed", 0.9, "the bytes aren't in the override's encoding")))
        .when(marked & utf8.isNotNull(), told(utf8, "utf-8", "byte-order-mark", 1.0)).when(utf8.isNotNull(), told(utf8, "utf-8", "utf-8-validation", 0.98))
        .when(fallback == "windows-1251", told(old, "windows-1251", "fallback", 0.85))
        .when(share >= 0.3, out("binary", 0.9, None, item("byte-sample", "binary", 0.9, "control bytes"))).otherwise(out("unknown", 0.5, None, item("byte-sample", "unknown", 0.5, "malformed UTF-8")))
    )


def classified(files, chosen: Column):
    """files (path, content, and _sample if that is at hand) with `classified`: content kind, encoding, evidence, and language and format, which binary content has none of."""
    from millrace.functions.classification import classify_language

    sample = F.col("_sample") if "_sample" in files.columns else sample_text(F.col("content"))
    rows = files.withColumn("_said", classify(F.col("content"), chosen, sample=sample)).withColumn("_named", classify_language(F.col("path"), sample))
    textual = F.col("_said.kind") != "binary"
    out = F.struct("_said.kind", "_said.confidence", "_said.encoding", F.when(textual, F.col("_named.language")).alias("language"), F.when(textual, F.col("_named.format")).alias("format"), "_said.evidence")
    return rows.withColumn("classified", out).drop("_said", "_named")
