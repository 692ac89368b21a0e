"""Paths, target names, prompts and fences."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reranker's prompt, and its model's opener of control strings.
RERANK_SYSTEM = 'Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".'
CONTROL = "<|"


def relative_path(path: Column) -> Column:
    """A path below its root: slashes for backslashes, without empty and `.` parts. An absolute path, one with `..` or none is an error."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.coalesce(path, F.lit("null")))).cast("string")
    return (
        F.when(path.isNull() | (F.size(parts) < 1) | (F.trim(path) == ""), fail("a path names a file"))
        .when(F.regexp_like(slashed, F.lit("^(/|[A-Za-z]:/)")), fail("a path is relative"))
        .when(F.array_contains(parts, ".."), fail("a path stays below its root")).otherwise(F.array_join(parts, "/"))
    )


def target_name(value: str) -> str:
    """The name of a retrieval target: 1 to 128 letters, digits, dots, underscores, slashes or hyphens, a letter or digit first."""
    name = value.strip()
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._/-]{0,127}", name) or ".." in name or "//" in name or name.endswith("/"):
        raise ValueError(f"not a target name: {value!r}")
    return name


def live_target(branch: str | None, head: str | None = None) -> str:
    """The target of a branch's live builds; of a name that no target can have, a slug with ten digits of its hash."""
    if branch is None:
        return f"live/detached/{head[:12]}" if head else "live/unborn"
    try:
        return target_name(f"live/{branch}")
    except ValueError:
        slug = re.sub(r"[^A-Za-z0-9._/-]+", "-", unicodedata.normalize("NFKD", branch))
        slug = re.sub(r"/{2,}", "/", re.sub(r"\.{2,}", ".", slug))
        slug = re.sub(r"^[/.-]+|[/.-]+$", "", slug)[:96] or "branch"
        return target_name(f"live/{slug}-{hashlib.sha256(branch.encode()).hexdigest()[:10]}")


def plain(text: Column) -> Column:
    """A text in which no control string of the model opens: a zero-width space parts its marks."""
    return F.replace(text, F.lit(CONTROL), F.lit("<​|"))


def rerank_prompt(instruction: Column, query: Column, document: Column) -> Column:
    """The prompt of a reranker that answers yes or no."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{RERANK_SYSTEM}<|im_end|>\n<|im_start|>user\n<Instruct>: "), plain(instruction), F.lit("\n<Query>: "), plain(query),
        F.lit("\n<Document>: "), plain(document), F.lit("<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"),
    )


def query_input(query: Column, prefix: str = "", suffix: str = "") -> Column:
    """A query's text for the embedding model."""
    return F.concat(F.lit(prefix), query, F.lit(suffix))


def fence(content: Column) -> Column:
    """Backticks enough to fence a text: one more than its longest run, three at least."""
    runs = F.regexp_extract_all(content, F.lit("(`+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def fence_language(language: Column) -> Column:
    return F.when(F.regexp_like(language, F.lit("^[A-Za-z0-9_+-]+$")), language).otherwise("")


def location(path: Column, first: Column, last: Column) -> Column:
    """path:line, or path:first-last."""
    return F.concat(path, F.lit(":"), first.cast("string"), F.when(first == last, "").otherwise(F.concat(F.lit("-"), last.cast("string"))))
