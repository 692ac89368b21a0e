"""Immutable index builds: parquet partitions by build, shared chunks and embeddings, and a manifest."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.identity import content_hash
from millrace.operators.membership import bucket_of, claimed_buckets, filters_of
from millrace.operators.relations import unreferenced
from millrace.operators.versions import Versions


def _folder(build: str) -> str:
    return f"build_id={quote(build, safe='')}"


class Workspace:
    """A folder of tables for one piece of work; whoever makes it removes it."""

    def __init__(self, spark: SparkSession, root: str, fs, path):
        self.spark, self.at, self._fs, self._path = spark, f"{root}/work/{uuid4().hex}", fs, path

    def placed(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written and read again."""
        kind = rows.schema
        rows.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(kind).parquet(f"{self.at}/{name}")

    def remove(self) -> None:
        self._fs.delete(self._path(self.at), True)


class _Newer(Exception):
    """Parts that another writer has added aren't compared yet."""


class BuildStore:
    """Builds under one folder of any store that Spark writes.

    Data files are written first; a build is seen only once its manifest row says `ready`. Each
    change of the manifest is a new file of the next number, which one writer alone can make, so readers never see half a change
    and writers at the same time lose none: a change is worked out anew from what another has written.

    Embeddings are parts, one for each put, in folders by the bucket of their id, each with a Bloom filter for a bucket, and are seen
    once the manifest names their part. Ids are looked up in the buckets alone whose filters claim any of them; a filter that claims too much costs time
    and nothing else. `buckets` counts for a new store and is kept in it; choose it so that a bucket has some ten million ids at most.

    What a delete leaves without a reference is named in a tombstone of the delete's number, and hidden
    from readers where it was written before; so a delete writes as much as its build had, and `compact` takes the hidden rows out.
    """

    STATES = ("building", "ready", "failed", "cancelled")

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        if buckets < 1:
            raise ValueError("a store has a bucket at least")
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self.manifest = Versions(spark, f"{self.root}/manifest")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def workspace(self) -> Workspace:
        return Workspace(self.spark, self.root, self._fs, self._path)

    def _whole(self, state: dict) -> dict:
        return {"builds": {}, "tombstones": [], "parts": {}, "buckets": self._buckets} | state

    def _state(self) -> dict:
        return self._whole(self.manifest.read()[1])

    def builds(self) -> dict[str, dict]:
        """Manifest rows by build id, the newest first, then by id."""
        builds = self._state()["builds"]
        return dict(sorted(sorted(builds.items()), key=lambda x: x[1]["created_at"], reverse=True))

    def _change(self, work: Callable[[dict], None]) -> dict:
        """Publish what `work` makes of the manifest's state in place; its errors go through."""

        def changed(state: dict) -> dict:
            state = self._whole(state)
            work(state)
            return state

        return self.manifest.change(changed)[1]

    def begin(self, build: str, model: dict, created_at: str, compatibility: str = "", repository: str = "", snapshot: str = "") -> bool:
        """Open a build of a repository's snapshot; False if it is ready already, so that nothing is to be done."""
        opened = []

        def open_(state: dict) -> None:
            row = state["builds"].get(build)
            opened[:] = [row is None]
            if row is not None and row["status"] != "ready":
                raise ValueError(f"build {build} is {row['status']}")
            if row is None:
                state["builds"][build] = {"status": "building", "model": model, "created_at": created_at, "compatibility": compatibility, "repository": repository, "snapshot": snapshot}

        if self.builds().get(build, {}).get("status") == "ready":
            return False
        self._change(open_)
        return opened[0]

    def set_status(self, build: str, status: str, completed_at: str | None = None) -> None:
        """Move a build on from `building`; from any other state is an error."""

        def move(state: dict) -> None:
            if status not in self.STATES or state["builds"].get(build, {}).get("status") != "building":
                raise ValueError(f"build {build} can't become {status}")
            state["builds"][build] |= {"status": status, "completed_at": completed_at}

        self._change(move)

    def _rows(self, state: dict, folders: list[tuple[str, int]]) -> DataFrame:
        """Embeddings of some buckets of parts: (embedding_id, vector, input_hash, written, part, bucket); only their folders are listed and read."""
        kind = f"embedding_id string, vector {state.get('vector', 'array<float>')}, input_hash string, written long, part string, bucket int"
        at = f"{self.root}/embeddings"
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", at).parquet(*(f"{at}/part={p}/bucket={b}" for p, b in folders))

    @staticmethod
    def _folders(state: dict, parts: list[str] | None = None) -> list[tuple[str, int]]:
        """(part, bucket) of all that is there, or of some parts."""
        return [(p, b) for p, row in state["parts"].items() if parts is None or p in parts for b in row["buckets"]]

    def _embeddings(self, state: dict, folders: list[tuple[str, int]]) -> DataFrame:
        """The embeddings that aren't hidden, as _rows has them."""
        rows = self._rows(state, folders)
        if not state["tombstones"]:
            return rows
        hidden = self.spark.read.parquet(*(f"{self.root}/tombstones/{t}" for t in state["tombstones"])).groupBy("embedding_id").agg(F.max("hidden").alias("hidden"))
        return rows.join(hidden, "embedding_id", "left").where("hidden is null or written > hidden").drop("hidden")

    def possible(self, ids: DataFrame, parts: list[str] | None = None, state: dict | None = None) -> list[tuple[str, int]]:
        """(part, bucket) that may hold any of ids (embedding_id), by the filters of all parts or some; none of the ids is in another."""
        state = state or self._state()
        names = list(state["parts"]) if parts is None else parts
        if not names:
            return []
        filters = self.spark.read.schema("bucket int, bits binary, part string").parquet(*(f"{self.root}/filters/{p}" for p in names))
        return claimed_buckets(ids, "embedding_id", filters, state["buckets"])

    def table(self, table: str) -> DataFrame:
        if table == "embeddings":
            state = self._state()
            return self._embeddings(state, self._folders(state)).select("embedding_id", "vector")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}")

    def put_diagnostics(self, build: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/diagnostics/{_folder(build)}")

    def diagnostics(self, build: str) -> DataFrame:
        """What a build left out or failed on, by path."""
        return self.spark.read.parquet(f"{self.root}/diagnostics/{_folder(build)}").orderBy("path")

    def put(self, build: str, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> None:
        """Write a build's documents and chunks, and such embeddings as the store doesn't have yet."""
        if self.builds().get(build, {}).get("status") != "building":
            raise ValueError(f"build {build} isn't being built")
        # a build's own folders are written anew, so that a put that is tried again doubles nothing
        documents.write.mode("overwrite").parquet(f"{self.root}/documents/{_folder(build)}")
        chunks.write.mode("overwrite").parquet(f"{self.root}/memberships/{_folder(build)}")
        self._add(embeddings, self.builds()[build]["model"])

    def _write(self, rows: DataFrame, part: str) -> list[int]:
        """Write a part's rows by bucket, large buckets by several tasks; the buckets that it has."""
        at = f"{self.root}/embeddings/part={part}"
        rows.drop("part").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def _erase(self, part: str) -> None:
        for at in (f"embeddings/part={part}", f"filters/{part}"):
            self._fs.delete(self._path(f"{self.root}/{at}"), True)

    def _add(self, embeddings: DataFrame, model: dict) -> None:
        """Add a part of the embeddings that no part has; each is made once, also where another writer's part must be compared with too."""
        number = self.manifest.read()[0]
        state, part = self._state(), f"p-{uuid4().hex}"
        kind = embeddings.schema["vector"].dataType.simpleString()
        if state.get("vector", kind) != kind:
            raise ValueError(f"vectors are {state['vector']}, not {kind}")
        told = F.col("input_hash") if "input_hash" in embeddings.columns else F.lit(None).cast("string").alias("input_hash")
        keyed = embeddings.dropDuplicates(["embedding_id"]).select("embedding_id", "vector", told, F.lit(number).cast("long").alias("written"))
        state["parts"][part] = {"model": model, "buckets": self._write(keyed.withColumn("bucket", bucket_of(F.col("embedding_id"), state["buckets"])), part)}
        state["vector"], compared = kind, set()
        while state["parts"][part]["buckets"]:
            others = [p for p in state["parts"] if p != part and p not in compared]
            mine = self._rows(state, self._folders(state, [part]))
            if maybe := self.possible(mine, others, state):
                known = self._embeddings(state, maybe).select("embedding_id")
                if known.join(mine.select("embedding_id"), "embedding_id", "left_semi").limit(1).count():
                    old, part = part, f"p-{uuid4().hex}"
                    state["parts"][part] = {"model": model, "buckets": self._write(mine.join(known, "embedding_id", "left_anti"), part)}
                    del state["parts"][old]
                    self._erase(old)
                    if not state["parts"][part]["buckets"]:
                        break
            compared |= {*others}
            filters_of(self._rows(state, self._folders(state, [part])), "embedding_id", state["buckets"], part).write.mode("overwrite").parquet(f"{self.root}/filters/{part}")
            row = state["parts"][part]

            def add(fresh: dict) -> None:
                if {*fresh["parts"]} - compared:
                    raise _Newer
                fresh |= {"parts": {**fresh["parts"], part: row}, "vector": kind}  # noqa: B023

            try:
                self._change(add)
                return
            except _Newer:
                state = self._state() | {"vector": kind}
                state["parts"][part] = row
        self._erase(part)

    def _met(self, ids: DataFrame, model: dict | None, how: str) -> DataFrame:
        """ids, each once, with the vector that is held for them; one that was made of another input or by another model is an error when it is read."""
        wanted, state = ids.dropDuplicates(["embedding_id"]), self._state()
        held = self._embeddings(state, self.possible(wanted, state=state)).select("embedding_id", F.lit(True).alias("_held"), "vector", "input_hash", "part")
        same = F.lit(True) if model is None else F.col("part").isin([p for p, row in state["parts"].items() if row["model"] == model])
        if "text" in wanted.columns:
            same = same & F.coalesce(F.col("input_hash") == content_hash(F.col("text")), F.lit(True))
        sure = F.when(F.col("_held") & ~same, F.raise_error(F.concat(F.lit("another input or model under the id "), F.col("embedding_id"))).cast("boolean")).otherwise(F.col("_held"))
        return wanted.join(held, "embedding_id", how).withColumn("_held", sure)

    def missing(self, ids: DataFrame, model: dict | None = None) -> DataFrame:
        """Of (embedding_id, text), those inputs that are still to be embedded, each once; held ones must be of the same input and, if given, model."""
        return self._met(ids, model, "left").where("_held is null").select(*ids.columns)

    def held(self, ids: DataFrame, model: dict | None = None) -> DataFrame:
        """Of (embedding_id, and text if it is to be checked), those that are embedded, each once, with their vector."""
        return self._met(ids, model, "inner").where("_held").select(*ids.columns, "vector")

    def searchable(self, build: str, model: dict | None = None) -> DataFrame:
        """Memberships of a ready build with their vectors; none for any other build, an error for another model."""
        row = self.builds().get(build)
        rows = self.table("memberships").where(F.col("build_id") == build)
        if row is None or row["status"] != "ready":
            rows = rows.where("false")
        elif model is not None and model != row["model"]:
            raise ValueError("the build was made with another model")
        return rows.join(self.table("embeddings"), "embedding_id")

    def document_chunks(self, build: str, path: str) -> DataFrame:
        """Chunks of one document of a build, by index."""
        found = self.table("documents").where((F.col("build_id") == build) & (F.col("path") == path)).select("document_id")
        return self.table("memberships").where(F.col("build_id") == build).join(F.broadcast(found.limit(1)), "document_id").orderBy("chunk_index", "chunk_id")

    def delete(self, build: str) -> dict[str, int]:
        """Delete a finished build, and hide embeddings that no other has; the numbers of rows deleted.

        Only ids of the build itself can lose their last reference, so these alone are looked for in the other builds, and what
        is written is the list of those that did.
        """
        if self.builds().get(build, {"status": "building"})["status"] == "building":
            raise ValueError(f"build {build} is missing or being built")
        mine, rest = F.col("build_id") == build, F.col("build_id") != build
        members, documents = self.table("memberships"), self.table("documents")
        own = members.where(mine).select("document_id", "chunk_id", "embedding_id")
        counts = {"documents": documents.where(mine).count(), "memberships": own.count()}
        lost = unreferenced(own.select("document_id", "chunk_id").distinct(), members.where(rest), ["document_id", "chunk_id"])
        counts["chunks"] = lost.count()
        state = self._state()
        hers = [r[0] for r in own.select(bucket_of(F.col("embedding_id"), state["buckets"])).where("embedding_id is not null").distinct().collect()]
        held = self._embeddings(state, [(p, b) for p, b in self._folders(state) if b in hers]).select("embedding_id", "written")
        gone = unreferenced(held.join(own.select("embedding_id").distinct(), "embedding_id"), members.where(rest), ["embedding_id"])
        name = f"hidden-{uuid4().hex}"
        gone.select("embedding_id", F.col("written").alias("hidden")).write.parquet(f"{self.root}/tombstones/{name}")
        counts["embeddings"] = self.spark.read.parquet(f"{self.root}/tombstones/{name}").count()

        def drop(state: dict) -> None:
            if state["builds"].pop(build, None) is None:
                raise ValueError(f"build {build} was deleted by another")
            if counts["embeddings"]:
                state["tombstones"] = [*state["tombstones"], name]

        self._change(drop)  # no reader finds the build, or the hidden vectors, from here on
        for table in ("documents", "memberships", "diagnostics"):
            self._fs.delete(self._path(f"{self.root}/{table}/{_folder(build)}"), True)
        return counts

    def compact(self, buckets: int | None = None) -> int:
        """Write the embeddings anew without those that are hidden, one part for each model, in so many buckets, if given; how many tombstones that ends.

        No build may be written meanwhile. Folders that no part of the manifest has, as writers that were lost leave them, are removed.
        """
        state = self._state()
        if any(row["status"] == "building" for row in state["builds"].values()):
            raise ValueError("a build is being written")
        count, at = buckets or state["buckets"], self._path(f"{self.root}/embeddings")
        there = {s.getPath().getName().removeprefix("part=") for s in self._fs.listStatus(at)} if self._fs.exists(at) else set()
        models = []
        for row in state["parts"].values():
            if row["model"] not in models:
                models.append(row["model"])
        if not state["tombstones"] and len(state["parts"]) == len(models) and count == state["buckets"]:
            return 0
        parts = {}
        for model in models:
            mine = self._folders(state, [p for p, row in state["parts"].items() if row["model"] == model])
            rows, part = self._embeddings(state, mine).drop("bucket"), f"p-{uuid4().hex}"
            held = self._write(rows.withColumn("bucket", bucket_of(F.col("embedding_id"), count)), part)
            if held:
                parts[part] = {"model": model, "buckets": held}
                filters_of(self._rows(state, [(part, b) for b in held]), "embedding_id", count, part).write.parquet(f"{self.root}/filters/{part}")

        def swap(fresh: dict) -> None:
            if fresh["parts"] != state["parts"] or fresh["tombstones"] != state["tombstones"] or any(row["status"] == "building" for row in fresh["builds"].values()):
                raise RuntimeError("the store was changed meanwhile")
            fresh |= {"parts": parts, "tombstones": [], "buckets": count}

        self._change(swap)
        for name in there:
            self._erase(name)
        for gone in state["tombstones"]:
            self._fs.delete(self._path(f"{self.root}/tombstones/{gone}"), True)
        return len(state["tombstones"])
