"""File classification and decoding as Column expressions over path and bytes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages (and formats, where these differ) by extension, file name and interpreter.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript/typescript-jsx", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript/javascript-jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python/python-stub", "php": "php", "inc": "php", "twig": "twig", "vue": "vue",
    "cs": "c-sharp", "java": "java", "c": "c", "h": "c/c-header", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp/cpp-header",
    "go": "go", "rs": "rust", "sh": "shell", "bash": "shell/bash", "zsh": "shell/zsh", "html": "html", "htm": "html",
    "css": "css", "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "markdown": "markdown", "rst": "restructuredtext",
}
FILENAMES = {"dockerfile": "dockerfile", "makefile": "make/makefile", "gnumakefile": "make/makefile", "jenkinsfile": "groovy/jenkinsfile"}
INTERPRETERS = [("javascript", r"\b(?:node|nodejs)\b"), ("python", r"\bpython(?:2|3)?\b"), ("shell", r"\b(?:bash|sh|zsh|dash|ksh)\b"), ("ruby", r"\bruby\b"), ("perl", r"\bperl\b")]
# First bytes of binary formats.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif87a": "474946383761", "gif89a": "474946383961", "zip": "504B0304", "gzip": "1F8B", "elf": "7F454C46", "pdf": "255044462D"}
# Names that mark traits, and the traits' order.
TRAITS = ("generated", "minified", "lockfile", "configuration", "documentation", "test", "declaration", "empty")
LOCKFILES = ("cargo.lock", "composer.lock", "gemfile.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock")
CONFIGURATION = {"names": (".editorconfig", "composer.json", "package.json", "package-lock.json"), "extensions": ("conf", "config", "ini", "toml", "yaml", "yml")}
DOCUMENTATION = ("adoc", "md", "markdown", "rst")
DECLARATIONS = ("h", "hpp", "pyi")
# Media types by extension.
MEDIA_TYPES = {
    "css": "text/css", "csv": "text/csv", "html": "text/html", "htm": "text/html", "js": "text/javascript", "json": "application/json", "jsx": "text/javascript",
    "md": "text/markdown", "markdown": "text/markdown", "mjs": "text/javascript", "py": "text/x-python", "ts": "text/typescript", "tsx": "text/typescript",
    "txt": "text/plain", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml",
}
SAMPLE = 65_536
#: Control characters other than tab, line feed, form feed and return: a list is looked up in a table, while ranges are tried one after another.
CONTROL = "[" + "".join(f"\\x{c:02x}" for c in (*range(9), 0x0B, *range(0x0E, 0x20), *range(0x7F, 0xA0))) + "]"
#: What generated files say, in any case; a first character that few have is tried before the rest.
GENERATED = "[@gGdD](?i:(?<=@)generated|(?<=g)enerated code|(?<=d)o not edit)"


def filename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))


def extension(path: Column) -> Column:
    """Lower-case text after a name's last dot; null if there is none, or it is the first or last character."""
    found = F.regexp_extract(filename(path), r"^.+\.([^.]+)$", 1)
    return F.nullif(found, F.lit(""))


def media_type(path: Column) -> Column:
    return F.coalesce(_lookup(MEDIA_TYPES, extension(path)), F.lit("application/octet-stream"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), key)


def sample_text(data: Column) -> Column:
    """Text of the first SAMPLE bytes, less a mark and a character that the sample's end cuts; null if it isn't UTF-8."""
    tail = F.hex(F.substring(data, SAMPLE - 2, 3))
    # bytes of a character that begins before the sample's end and ends after it
    begun = F.when(F.regexp_like(tail, F.lit("[CDEF].$")), 1).when(F.regexp_like(tail, F.lit("[EF].[89AB].$")), 2).when(F.regexp_like(tail, F.lit("^F.[89AB].[89AB].$")), 3).otherwise(0)
    whole = F.when(F.octet_length(data) > SAMPLE, F.substring(data, F.lit(1), F.lit(SAMPLE) - begun)).otherwise(data)
    return F.try_validate_utf8(_unmarked(whole).cast("string"))


def _unmarked(data: Column) -> Column:
    """Bytes without a leading byte-order mark of UTF-8."""
    return F.when(F.substring(data, 1, 3) == F.unhex(F.lit("EFBBBF")), F.substring(data, F.lit(4), F.octet_length(data))).otherwise(data)


def control_ratio(text: Column) -> Column:
    """Share of control characters other than tab, line feed, form feed and return."""
    plain = F.regexp_replace(text, CONTROL, "")
    # most texts have none, and then aren't written anew
    return F.when(~F.regexp_like(text, F.lit(CONTROL)), F.lit(0.0)).otherwise((F.length(text) - F.length(plain)) / F.length(text))


def classify_content(data: Column) -> Column:
    """Struct (kind, confidence, encoding, signal): what the bytes of a file say of it.

    In order: a binary signature; a NUL byte; nothing at all; malformed UTF-8; then by the share of control
    characters text, unknown or binary. A byte-order mark vouches for UTF-8 wholly, valid UTF-8 for 0.98.
    """
    head = F.substring(data, 1, SAMPLE)
    outcome = lambda kind, confidence, encoding, signal: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).cast("double").alias("confidence"), F.lit(encoding).cast("string").alias("encoding"), F.lit(signal).alias("signal"))
    steps = F
    for name, digits in SIGNATURES.items():
        steps = steps.when(F.substring(data, 1, len(digits) // 2) == F.unhex(F.lit(digits)), outcome("binary", 1.0, None, name))
    text = sample_text(data)
    ratio = control_ratio(text)
    marked = F.substring(data, 1, 3) == F.unhex(F.lit("EFBBBF"))
    sure = F.when(marked, F.lit(1.0)).otherwise(F.lit(0.98))
    graded = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.least(F.lit(confidence), sure).alias("confidence"), F.lit("utf-8").alias("encoding"), F.lit("control-ratio").alias("signal"))
    return (
        steps.when(F.instr(F.decode(head, "ISO-8859-1"), "\u0000") > 0, outcome("binary", 0.99, None, "nul-byte"))
        .when(F.octet_length(data) == 0, outcome("text", 1.0, "utf-8", "empty"))
        .when(text.isNull(), outcome("unknown", 0.5, None, "malformed"))
        .when(ratio <= 0.02, graded("text", 0.98)).when(ratio >= 0.3, graded("binary", 0.9)).otherwise(graded("unknown", 0.55))
    )


def classify_language(path: Column, text: Column) -> Column:
    """Struct (language, format, signal, confidence): shebang before file name before extension; null fields if none tells."""
    line = F.when(text.startswith("#!"), F.regexp_extract(F.substring(text, 1, 256), r"^#!([\x01-\x09\x0b\x0c\x0e-\x7f]*)(?:\r|\n|$)", 1))
    shebang = F.lit(None).cast("string")
    for language, pattern in reversed(INTERPRETERS):
        shebang = F.when(F.regexp_like(line, F.lit(pattern)), F.lit(language)).otherwise(shebang)
    by_name, by_end = _lookup(FILENAMES, filename(path)), _lookup(EXTENSIONS, extension(path))
    found = F.coalesce(shebang, by_name, by_end)
    signal = F.when(shebang.isNotNull(), "shebang").when(by_name.isNotNull(), "filename").when(by_end.isNotNull(), "extension")
    sure = F.when(shebang.isNotNull(), 0.98).when(by_name.isNotNull(), 0.95).when(by_end.isNotNull(), 0.85)
    return F.struct(F.split_part(found, F.lit("/"), F.lit(1)).alias("language"), F.element_at(F.split(found, "/"), -1).alias("format"), signal.alias("signal"), sure.alias("confidence"))


def minified(text: Column) -> Column:
    """Whether a text of 500 characters and more has a line as long and less than a tenth of white space."""
    # spaces alone are told fast, and in prose they are more than a tenth
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    longest = F.array_max(F.transform(F.split(text, "\r?\n"), F.length))
    blank = F.length(text) - F.length(F.regexp_replace(text, "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]", ""))
    return (F.length(text) >= 500) & (spaces / F.length(text) < 0.1) & (longest >= 500) & (blank / F.length(text) < 0.1)


def classify_traits(path: Column, size: Column, text: Column) -> Column:
    """Array of a file's traits in their fixed order; text may be null (unreadable)."""
    whole, name, end = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), filename(path), extension(path)
    text_says = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "generated": F.regexp_like(whole, F.lit("(^|/)(dist|build|generated|gen)(/|$)")) | F.regexp_like(name, F.lit(r"\.(generated|g|designer)\.")) | text_says(F.regexp_like(text, F.lit(GENERATED))),
        "minified": F.regexp_like(name, F.lit(r"\.min\.(css|js|mjs|cjs)$")) | text_says(minified(text)),
        "lockfile": name.isin(*LOCKFILES),
        "configuration": name.startswith(".env") | name.isin(*CONFIGURATION["names"]) | F.regexp_like(name, F.lit(r"^[jt]sconfig(\.[^.]+)?\.json$")) | text_says(end.isin(*CONFIGURATION["extensions"])),
        "documentation": F.regexp_like(name, F.lit(r"^(readme|changelog|license|contributing|authors)(\.|$)")) | text_says(end.isin(*DOCUMENTATION)),
        "test": F.regexp_like(whole, F.lit("(^|/)(__tests__|tests?|specs?)(/|$)")) | F.regexp_like(name, F.lit(r"(^|\.)(test|spec)\.[^.]+$|_test\.go$|^test_.*\.py$")),
        "declaration": F.regexp_like(name, F.lit(r"\.d\.[mc]?ts$")) | text_says(end.isin(*DECLARATIONS)),
        "empty": size == 0,
    }
    return F.array_compact(F.array(*(F.when(rules[t], F.lit(t)) for t in TRAITS)))


def decode(data: Column, fallback: str | None = None) -> Column:
    """Struct (text, encoding): UTF-8 without its mark, else the fallback windows-1251; null if neither reads the bytes."""
    plain = _unmarked(data).cast("string")
    good = F.is_valid_utf8(plain)
    if fallback is None:
        return F.struct(F.when(good, plain).alias("text"), F.when(good, F.lit("utf-8")).alias("encoding"))
    if fallback.strip().lower() not in ("windows-1251", "windows1251", "cp1251", "win1251"):
        raise ValueError(f"unsupported fallback encoding {fallback!r}")
    # byte by byte: Latin-1 gives each byte a character, which is then replaced by that of the code page
    upper = bytes(range(0x80, 0x100))
    page = "".join(bytes([b]).decode("cp1251") if b != 0x98 else "\u0098" for b in upper)
    old = F.translate(F.decode(data, "ISO-8859-1"), upper.decode("latin-1"), page)
    return F.struct(F.when(good, plain).otherwise(old).alias("text"), F.when(good, F.lit("utf-8")).otherwise(F.lit("windows-1251")).alias("encoding"))
