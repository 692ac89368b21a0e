"""The catalogue of documentations, retrieval targets and projects: small manifests, each change a new revision."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import target_name

PROVIDERS = ("embedding", "reranking", "compression")


class Manifests:
    """Named JSON values in a folder of any store that Spark writes; an update names the revision that it was made from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _revisions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if self._fs.exists(folder) else []

    def names(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()) if self._fs.exists(root) else []

    def read(self, name: str) -> tuple[int, dict]:
        """The newest revision and its value; (0, {}) if there is none."""
        found = self._revisions(name)
        if not found:
            return 0, {}
        return int(found[-1].split(".")[0]), json.loads(self.spark.read.text(f"{self.root}/{name}/{found[-1]}", wholetext=True).first()[0])

    def write(self, name: str, value: dict, after: int) -> int:
        """Publish the revision after `after`; an error if another writer did."""
        temporary, final = self._path(f"{self.root}/{name}/.{uuid4().hex}"), self._path(f"{self.root}/{name}/{after + 1:010d}.json")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{name} was changed by another writer")
        return after + 1

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def _required(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} is required")
    return value.strip()


def _hash(*fields: str) -> str:
    return hashlib.sha256("\0".join(fields).encode()).hexdigest()


class Documentations:
    """Documentations by id; names are unique whatever their case."""

    def __init__(self, spark: SparkSession, root: str):
        self.manifests = Manifests(spark, root)

    def all(self) -> list[dict]:
        return sorted((self.manifests.read(n)[1] for n in self.manifests.names()), key=lambda d: (d["name"].lower(), d["id"]))

    def create(self, name: str, now: str) -> dict:
        name = _required(name, "a name")
        if any(d["name"].lower() == name.lower() for d in self.all()):
            raise ValueError(f"there is a documentation {name!r} already")
        made = {"id": "documentation-" + uuid4().hex, "name": name, "revision": 1, "sources": {}, "active": None, "created_at": now, "updated_at": now}
        self.manifests.write(made["id"], made, 0)
        return made

    def resolve(self, reference: str) -> dict:
        """By id, else by name whatever its case."""
        found = [d for d in self.all() if d["id"] == reference.strip()] or [d for d in self.all() if d["name"].lower() == reference.strip().lower()]
        if not found:
            raise KeyError(f"no documentation {reference!r}")
        return found[0]

    def _change(self, reference: str, now: str, change) -> dict:
        """Apply change(value); the configuration gets a new revision if the sources became others."""
        id_ = self.resolve(reference)["id"]
        number, old = self.manifests.read(id_)
        new = deepcopy(old)
        change(new)
        if new == old:
            return old
        new["updated_at"] = now
        if new["sources"] != old["sources"]:
            new["revision"] = old["revision"] + 1
        self.manifests.write(id_, new, number)
        return new

    def rename(self, reference: str, name: str, now: str) -> dict:
        name, own = _required(name, "a name"), self.resolve(reference)["id"]
        if any(d["name"].lower() == name.lower() and d["id"] != own for d in self.all()):
            raise ValueError(f"there is a documentation {name!r} already")
        return self._change(reference, now, lambda d: d.update(name=name))

    def delete(self, reference: str) -> None:
        self.manifests.remove(self.resolve(reference)["id"])

    def upsert(self, reference: str, documents: list[dict], now: str) -> dict:
        """Put managed documents (external_id, content; title, path, media_type, tags, attributes, encoding) by their external id.

        What isn't given is taken from the document before, else from its id. A path that another source has is an error, and then nothing
        is changed; documents that say what is there already change no revision.
        """
        if not documents:
            raise ValueError("at least one document is required")

        def change(d: dict) -> None:
            for given in documents:
                external = _required(given["external_id"], "an external id")
                id_ = "source-" + _hash(d["id"], f"managed:{external}")
                old = d["sources"].get(id_, {})
                title = (given.get("title") or "").strip() or old.get("title") or PurePosixPath(external).name
                path = given.get("path") or old.get("path") or f"sources/{id_}/{''.join(c if c.isalnum() or c in '._-' else '-' for c in title)}"
                path = _plain_path(path)
                if other := next((k for k, s in d["sources"].items() if k != id_ and s.get("path") == path), None):
                    raise ValueError(f"the path {path} belongs to {other}")
                content = given["content"].encode() if isinstance(given["content"], str) else bytes(given["content"])
                new = {
                    "kind": "managed", "external_id": external, "path": path, "title": title, "media_type": (given.get("media_type") or "").strip() or old.get("media_type") or "text/plain",
                    "bytes": len(content), "content_hash": "sha256:" + hashlib.sha256(content).hexdigest(), "tags": sorted({t.strip() for t in given.get("tags", old.get("tags", [])) if t.strip()}),
                    "attributes": dict(sorted(given.get("attributes", old.get("attributes", {})).items())), "encoding": given.get("encoding") or old.get("encoding"), "created_at": old.get("created_at", now),
                }
                if {k: v for k, v in old.items() if k != "updated_at"} != new:
                    d["sources"][id_] = new | {"updated_at": now}

        return self._change(reference, now, change)

    def add_directory(self, reference: str, root: str, now: str, include: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> dict:
        id_ = lambda d: "source-" + _hash(d["id"], f"directory:{root}")
        return self._change(reference, now, lambda d: d["sources"].setdefault(id_(d), {"kind": "directory", "root": _required(root, "a root"), "include": list(include), "tags": sorted(set(tags)), "created_at": now, "updated_at": now}))

    def remove_source(self, reference: str, source: str, now: str) -> dict:
        if source not in self.resolve(reference)["sources"]:
            raise KeyError(f"no source {source!r}")
        return self._change(reference, now, lambda d: d["sources"].pop(source))

    def tag(self, reference: str, source: str, how: str, tags: tuple[str, ...], now: str) -> dict:
        """set, add, remove or clear the tags of a source; a change that changes nothing keeps the revision."""
        if how not in ("set", "add", "remove", "clear"):
            raise ValueError(f"unknown change of tags {how!r}")
        if source not in self.resolve(reference)["sources"]:
            raise KeyError(f"no source {source!r}")

        def change(d: dict) -> None:
            own, given = set(d["sources"][source]["tags"]), {t.strip() for t in tags if t.strip()}
            now_ = sorted({"set": given, "add": own | given, "remove": own - given, "clear": set()}[how])
            if now_ != d["sources"][source]["tags"]:
                d["sources"][source] |= {"tags": now_, "updated_at": now}

        return self._change(reference, now, change)

    def activate(self, reference: str, build: str, revision: int, now: str) -> dict:
        """Make a build the active one, if the configuration is still of the revision that it was made from."""
        if self.resolve(reference)["revision"] != revision:
            raise RuntimeError("the documentation was changed while its build was made")
        return self._change(reference, now, lambda d: d.update(active={"build": build, "revision": revision}))

    def active(self, reference: str) -> str | None:
        """The active build; None if there is none or it was made from another configuration."""
        found = self.resolve(reference)
        return found["active"]["build"] if found["active"] and found["active"]["revision"] == found["revision"] else None


def _plain_path(path: str) -> str:
    slashed = path.replace("\\", "/")
    parts = [p for p in slashed.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or slashed.startswith("/") or slashed[1:3] == ":/":
        raise ValueError(f"not a path below a root: {path!r}")
    return "/".join(parts)


def merge_documents(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The same as a DataFrame: rows of new over those of old by key, null columns inherited, with change (added, updated, kept)."""
    a, b = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("_old")), new.select(key, *columns, F.lit(True).alias("_new"))
    met = a.join(b, key, "full_outer")
    values = [F.coalesce(c, f"old_{c}").alias(c) for c in columns]
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(c, f"old_{c}").eqNullSafe(F.col(f"old_{c}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull() | same, "kept").otherwise("updated")
    return met.select(key, *values, change.alias("change"))


@dataclass
class Targets:
    """Named retrieval targets of a project, what is selected, and the lease of a live session."""

    manifests: Manifests
    project: str
    retained: int = 20
    stale: float = 10.0
    _empty: dict = field(default_factory=lambda: {"targets": {}, "selection": None, "session": None})

    def read(self) -> tuple[int, dict]:
        number, value = self.manifests.read(self.project)
        return number, value or deepcopy(self._empty)

    def _change(self, change) -> dict:
        number, value = self.read()
        change(value)
        self.manifests.write(self.project, value, number)
        return value

    def assign(self, name: str, build: str, ready: set[str]) -> dict:
        """Point a target to a ready build; the build that it pointed to before is retained."""
        name = target_name(name)
        if build not in ready:
            raise ValueError(f"build {build} isn't ready")

        def change(v: dict) -> None:
            old = v["targets"].get(name, {"build": None, "retained": []})
            kept = [b for b in [old["build"], *old["retained"]] if b and b != build]
            v["targets"][name] = {"build": build, "retained": kept[: self.retained]}

        return self._change(change)

    def switch(self, target: str | None = None, build: str | None = None, ready: set[str] = frozenset()) -> dict:
        """Select a target, or a build; either must be ready."""
        _, v = self.read()
        if (target is None) == (build is None):
            raise ValueError("select a target or a build")
        if target is not None and target_name(target) not in v["targets"]:
            raise KeyError(f"no target {target!r}")
        chosen = v["targets"][target_name(target)]["build"] if target is not None else build
        if chosen not in ready:
            raise ValueError(f"build {chosen} isn't ready")
        return self._change(lambda v: v.update(selection={"target": target_name(target)} if target is not None else {"build": build}))

    def deactivate(self) -> dict:
        return self._change(lambda v: v.update(selection={"none": True}))

    def rename(self, name: str, to: str) -> dict:
        name, to = target_name(name), target_name(to)
        _, v = self.read()
        if name not in v["targets"] or to in v["targets"]:
            raise ValueError(f"{name!r} can't become {to!r}")

        def change(v: dict) -> None:
            v["targets"][to] = v["targets"].pop(name)
            if v["selection"] == {"target": name}:
                v["selection"] = {"target": to}

        return self._change(change)

    def remove(self, name: str) -> dict:
        """Remove a target; if it was selected, nothing is."""
        name = target_name(name)
        if name not in self.read()[1]["targets"]:
            raise KeyError(f"no target {name!r}")

        def change(v: dict) -> None:
            del v["targets"][name]
            if v["selection"] == {"target": name}:
                v["selection"] = {"none": True}

        return self._change(change)

    def resolve(self, latest: str | None = None) -> tuple[str, str] | None:
        """(how, build) of what is selected: nothing, a target's build, a build, or without a selection the latest ready build."""
        _, v = self.read()
        chosen = v["selection"]
        if chosen is None:
            return ("latest-ready", latest) if latest else None
        if "none" in chosen:
            return None
        if "build" in chosen:
            return "build", chosen["build"]
        if chosen["target"] not in v["targets"]:
            raise KeyError(f"the selected target {chosen['target']!r} is gone")
        return "target", v["targets"][chosen["target"]]["build"]

    def protected(self) -> set[str]:
        """Builds that may not be deleted: those that targets point to or that are selected."""
        _, v = self.read()
        return {t["build"] for t in v["targets"].values()} | ({v["selection"]["build"]} if v["selection"] and "build" in v["selection"] else set())

    def delete_build(self, store, build: str) -> dict[str, int]:
        if build in self.protected():
            raise ValueError(f"build {build} is in use")
        return store.delete(build)

    def lease(self, session: str, now: float, latest: str | None = None) -> dict:
        """Take or renew the lease of a live session, remembering what was selected before; another session's is an error until it is stale."""
        _, v = self.read()
        held = v["session"]
        if held and held["id"] != session and now - held["at"] <= self.stale and held["phase"] != "stopped":
            raise RuntimeError("another live session is running")
        if held and held["id"] != session:
            self.recover(now)
            _, v = self.read()
        before = v["session"]["before"] if v["session"] and v["session"]["id"] == session else v["selection"] or ({"build": latest} if latest else {"none": True})
        return self._change(lambda v: v.update(session={"id": session, "at": now, "phase": "starting", "before": before, "build": None} if not v["session"] or v["session"]["id"] != session else v["session"] | {"at": now}))

    def publish(self, session: str, name: str, build: str, ready: set[str], now: float) -> dict:
        """Point a live target to a build of the session, and select it."""
        _, v = self.read()
        if not v["session"] or v["session"]["id"] != session:
            raise RuntimeError("the live session's lease is lost")
        self.assign(name, build, ready)
        return self._change(lambda v: v.update(selection={"target": target_name(name)}, session=v["session"] | {"at": now, "phase": "ready", "build": build}))

    def recover(self, now: float) -> bool:
        """Of a session that stopped or went stale, give back what was selected before it."""
        _, v = self.read()
        held = v["session"]
        if not held or held["phase"] != "stopped" and now - held["at"] <= self.stale:
            return False
        self._change(lambda v: v.update(selection=held["before"], session=None))
        return True

    def stop(self, session: str, now: float) -> None:
        _, v = self.read()
        if v["session"] and v["session"]["id"] == session:
            self._change(lambda v: v.update(session=v["session"] | {"phase": "stopped", "at": now}))
            self.recover(now)

    def fresh(self, build: str, now: float) -> str:
        """The build, if it may be searched: while a live session runs it must be ready and the build its own; one that stopped or is stale is ignored."""
        _, v = self.read()
        held = v["session"]
        if held and held["phase"] != "stopped" and now - held["at"] <= self.stale and (held["phase"] != "ready" or held["build"] != build):
            raise RuntimeError("the live index isn't up to date")
        return build


def nearest_project(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, project): for each path the project whose root is the nearest folder around it, null if none is; roots: project, root.

    Each path is led to by itself and the folders around it, which meet the roots by equality; of several projects
    with that root the greatest name holds.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = paths.select("path").distinct()
    around = asked.where("path is not null").select("path", F.explode(folders).alias("root"))
    best = around.join(roots.groupBy("root").agg(F.max("project").alias("project")), "root").groupBy("path").agg(F.max_by("project", F.length("root")).alias("project"))
    return asked.join(best, "path", "left")


class Configurations:
    """Recipes, presets and provider profiles: named values of one kind, each checked when it is put."""

    def __init__(self, spark: SparkSession, root: str, kind: str, allowed: dict[str, type]):
        self.manifests, self.kind, self.allowed = Manifests(spark, f"{root.rstrip('/')}/{kind}"), kind, allowed

    def put(self, name: str, value: dict) -> None:
        if unknown := set(value) - set(self.allowed):
            raise ValueError(f"a {self.kind} has no {sorted(unknown)}")
        if wrong := [k for k, v in value.items() if not isinstance(v, self.allowed[k])]:
            raise ValueError(f"{wrong[0]} of a {self.kind} is a {self.allowed[wrong[0]].__name__}")
        name = target_name(name)
        self.manifests.write(name, value | {"name": name}, self.manifests.read(name)[0])

    def get(self, name: str) -> dict:
        value = self.manifests.read(target_name(name))[1]
        if not value:
            raise KeyError(f"no {self.kind} {name!r}")
        return value

    def all(self) -> list[dict]:
        return [self.get(n) for n in self.manifests.names()]

    def remove(self, name: str) -> None:
        self.get(name)
        self.manifests.remove(target_name(name))
