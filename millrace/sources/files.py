"""Discovery of files in a folder, with ignore rules, as DataFrames; and driver tables as documents."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.identity import content_hash
from millrace.operators.digest import ordered_digests

LIMIT = 10 * 1024 * 1024


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ** over folders, * and ? within one, [..] and {a,b}; dots are ordinary."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        if c == "{" and (end := pattern.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in pattern[i + 1 : end].split(",")) + ")", end + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignored, regex) of the lines of an ignore file, to be tried in order; the last that matches decides."""
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\) +$", "", line.rstrip("\n\r"))
        if not line or line.startswith("#"):
            continue
        again = line.startswith("!")
        line = line[1:] if again else line
        folder = line.endswith("/")
        body = line.strip("/") if not line.startswith("\\") else line
        anchored = "/" in line.rstrip("/")
        regex = ("^" if anchored else "^(?:.*/)?") + glob_regex(body) + ("/.+$" if folder else "(?:/.*)?$")
        rules.append((not again, regex))
    return rules


def ignored(path: Column, lines: list[str]) -> Column:
    out = F.lit(False)
    for on, regex in ignore_rules(lines):
        out = F.when(F.regexp_like(path, F.lit(regex)), F.lit(on)).otherwise(out)
    return out


def discover(files: DataFrame, include: list[str] = (), exclude: list[str] = (), gitignore: list[str] = (), hidden: bool = False, limit: int = LIMIT) -> DataFrame:
    """files (path relative to the root, length, ...) with `reason`, null for files that are taken.

    In order: the version-control folder, hidden names, ignore rules, not included, larger than limit.
    """
    path = F.col("path")
    wanted = F.lit(True) if not include else F.regexp_like(path, F.lit("^(?:" + "|".join(glob_regex(p) for p in include) + ")$"))
    reason = (
        F.when(F.regexp_like(path, F.lit(r"(^|/)\.git(/|$)")), "version-control").when(F.lit(not hidden) & F.regexp_like(path, F.lit(r"(^|/)\.[^/]")), "hidden")
        .when(ignored(path, [*gitignore, *exclude]), "ignored").when(~wanted, "not-included").when(F.col("length") > limit, "file-too-large")
    )
    return files.withColumn("reason", reason)


def read_folder(spark: SparkSession, root: str, limit: int = LIMIT) -> DataFrame:
    """(path, modified_at, length, content) of all files below root; paths are relative. Any store that Spark reads."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    tail = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z0-9]+:/*", "", base)) + "/", "")
    return found.select(tail.alias("path"), F.col("modificationTime").alias("modified_at"), "length", "content")


def _hashed(files: DataFrame, *groups: str) -> DataFrame:
    return files.select(*groups, "path", content_hash(F.col("content")).alias("hash"))


def snapshot(files: DataFrame) -> DataFrame:
    """One row (files, bytes, membership_hash) for a set of files (path, content)."""
    whole = files.agg(F.sum(F.octet_length("content")).alias("bytes"))
    return whole.join(ordered_digests(_hashed(files)), how="left").select(F.coalesce("files", F.lit(0)).alias("files"), "bytes", F.coalesce("membership_hash", content_hash(F.lit(""))).alias("membership_hash"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Files of several sources together; a path that two of them have is an error when it is read."""
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    twice = whole.groupBy("path").agg(F.count("*").alias("times"))
    checked = F.when(F.col("times") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("two sources have "), F.col("path"))).cast("string"))
    return whole.join(twice, "path").withColumn("path", checked).drop("times")


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as prepared files: path source/doc_id.md, text and bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.withColumn("path", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit(".md")))


def discovery_order(path: Column) -> Column:
    """A sort key of paths: the files of a folder first, then its folders, each by name, depth first."""
    parts = F.split(path, "/")
    # a folder's name is led by a character that comes after that of a file
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("\u0000")).otherwise(F.lit("\u0001")), p))


def diagnostics(found: DataFrame) -> DataFrame:
    """(path, code, detail) of the files that discovery left out for what they are, in discovery order.

    found: as `discover` returns it, with `entry` (file, symbolic-link or another kind; null: a file) and `readable`, if it has them.
    """
    entry = F.coalesce(F.col("entry"), F.lit("file")) if "entry" in found.columns else F.lit("file")
    readable = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in found.columns else F.lit(True)
    open_ = F.col("reason").isNull() | (F.col("reason") == "file-too-large")
    code = F.when(~open_, None).when(entry == "symbolic-link", "symbolic-link-skipped").when(entry != "file", "unsupported-entry").when(~readable, "entry-unreadable").when(F.col("reason") == "file-too-large", "file-too-large")
    return found.select("path", code.alias("code"), F.concat(F.lit("length "), F.coalesce("length", F.lit(0)).cast("string")).alias("detail")).where("code is not null").orderBy(discovery_order(F.col("path")))


def local_entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, entry, readable) of what lies below a folder of the driver's machine, its links not followed; for discovery's diagnostics."""
    rows, agenda = [], [Path(root)]
    while agenda:
        folder = agenda.pop()
        try:
            inside = sorted(folder.iterdir(), key=lambda p: p.name)
        except OSError:
            rows.append((str(folder.relative_to(root)), 0, "file", False))
            continue
        for p in inside:
            link = p.is_symlink()
            if p.is_dir() and not link:
                agenda.append(p)
                continue
            kind = "symbolic-link" if link else "file" if p.is_file() else "other"
            rows.append((str(p.relative_to(root)), p.lstat().st_size, kind, os.access(p, os.R_OK) if not link else True))
    return spark.createDataFrame(rows, "path string, length long, entry string, readable boolean")


def selection_hash(include: list[str] = (), exclude: list[str] = (), hidden: bool = False, limit: int = LIMIT) -> str:
    """The hash of what discovery was asked for: the same options, in any order, give the same."""
    told = json.dumps({"exclude": sorted(exclude), "hidden": hidden, "include": sorted(include), "limit": limit}, separators=(",", ":"), sort_keys=True)
    return "sha256:" + hashlib.sha256(told.encode()).hexdigest()


def memberships(files: DataFrame, group: str) -> DataFrame:
    """(group, files, membership_hash): the hash over the sorted lines of each set, which go through memory one at a time."""
    return ordered_digests(_hashed(files, group), [group])


def directory_source(files: DataFrame) -> dict:
    """A folder's snapshot as a source: its identity says what lies in it."""
    row = snapshot(files).first()
    return {"kind": "directory", "identity": f"directory:{row['membership_hash']}", "files": row["files"], "bytes": row["bytes"] or 0}


def documentation_revision(content_hash_: Column, title: Column, media: Column, tags: Column, attributes: Column) -> Column:
    """The revision of a managed document: its bytes and what is told of it, so that a new title or tag is a new revision."""
    told = F.to_json(F.struct(content_hash_.alias("content"), title.alias("title"), media.alias("mediaType"), F.array_sort(tags).alias("tags"), F.array_sort(F.map_entries(attributes)).alias("attributes")))
    return content_hash(told)
