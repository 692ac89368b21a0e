"""Working trees under version control as sources; git runs on the driver."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import directory_source, discover, read_folder


@dataclass(frozen=True)
class Change:
    path: str
    kind: str
    staged: bool
    unstaged: bool
    previous: str | None = None


@dataclass(frozen=True)
class TreeState:
    """What is checked out: head is None in an unborn tree, branch in a detached one."""

    head: str | None
    branch: str | None
    changes: tuple[Change, ...]

    @property
    def dirty(self) -> bool:
        return bool(self.changes)


def _git(root: str, *words: str) -> str | None:
    """What git prints; None if it says no in the ordinary way."""
    done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=60, check=False)
    return done.stdout if done.returncode == 0 else None


def change_kind(staged: str, unstaged: str) -> str:
    """The kind of a change by its two letters; of several the first of: conflicted, renamed, copied, deleted, added."""
    both = staged + unstaged
    if both == "??":
        return "untracked"
    if "U" in both or both in ("AA", "DD"):
        return "conflicted"
    return next((kind for letter, kind in (("R", "renamed"), ("C", "copied"), ("D", "deleted"), ("A", "added")) if letter in both), "modified")


def parse_status(printed: str) -> list[Change]:
    """Changes, by path, of `status --porcelain=v1 -z`; the old path of a rename or copy is an entry of its own."""
    out, entries = [], iter([e for e in printed.split("\0") if e])
    for entry in entries:
        if len(entry) < 4:
            continue
        staged, unstaged, path = entry[0], entry[1], entry[3:].replace("\\", "/")
        previous = next(entries, "").replace("\\", "/") or None if staged in "RC" else None
        out.append(Change(path, change_kind(staged, unstaged), staged not in " ?", unstaged != " " or staged == "?", previous))
    return sorted(out, key=lambda c: c.path)


def tree_root(folder: str) -> str | None:
    """The root of the working tree that a folder lies in."""
    printed = _git(folder, "rev-parse", "--show-toplevel")
    return printed.strip() or None if printed else None


def tree_state(root: str) -> TreeState:
    head, branch = (_git(root, *words) for words in (("rev-parse", "--verify", "HEAD"), ("symbolic-ref", "--quiet", "--short", "HEAD")))
    status = _git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all")
    if status is None:
        raise ValueError(f"git can't tell the state of {root}")
    strip = lambda x: x.strip() or None if x else None
    return TreeState(strip(head), strip(branch), tuple(parse_status(status)))


def resolve_ref(root: str, ref: str) -> str:
    """The commit that a ref names."""
    found = _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}")
    if found is None:
        raise ValueError(f"no commit is named {ref!r}")
    return found.strip()


def ignore_lines(root: str) -> list[str]:
    """The lines of the ignore files of a tree, each moved to its folder."""
    lines = []
    for file in sorted(Path(root).rglob(".gitignore"), key=lambda p: len(p.parts)):
        folder = str(file.parent.relative_to(root)).replace("\\", "/")
        for line in file.read_text("utf-8", "replace").splitlines():
            if not line.strip() or line.startswith("#") or folder == ".":
                lines.append(line)
                continue
            again, body = line.startswith("!"), line.removeprefix("!")
            lines.append("!" * again + f"{folder}/{body.lstrip('/') if '/' in body.rstrip('/') else '**/' + body}")
    return lines


def project_source(spark: SparkSession, root: str, allow_dirty: bool = True, **options) -> tuple[DataFrame, dict]:
    """The files of a folder as they are, and its source: a working tree's if git knows it, else a directory's.

    A dirty tree is refused unless allowed. The identity says the head, or `unborn`, and what lies in the folder.
    """
    tree = tree_root(root)
    state = tree_state(tree) if tree else None
    if state and state.dirty and not allow_dirty:
        raise ValueError(f"{root} has {len(state.changes)} changes that aren't committed")
    found = discover(read_folder(spark, root), gitignore=ignore_lines(root), **options).where(F.col("reason").isNull())
    source = directory_source(found)
    if state:
        source |= {"kind": "git-working-tree", "identity": f"git-working-tree:{state.head or 'unborn'}:{source['identity'].removeprefix('directory:')}", "head": state.head, "branch": state.branch, "dirty": state.dirty}
    return found, source
