"""The live state of a tree of files: a table keyed by path to which each batch of changes is merged, with what was deleted kept as tombstones."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.identity import content_hash
from millrace.operators.digest import ordered_digests
from millrace.operators.relations import snapshot_diff
from millrace.operators.versions import Conflict, Versions

#: The hash of no files.
NOTHING = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_KEPT = "path string, hash string, content {kind}, at long, nth long, deleted boolean, bucket int"


@dataclass(frozen=True)
class Applied:
    """What a batch made of the snapshot: the revision, its hash and number of files, and how many were added, changed or removed."""

    revision: int
    fingerprint: str
    files: int
    changes: dict[str, int]

    @property
    def changed(self) -> bool:
        return any(self.changes.values())


class LiveSnapshot:
    """Files by path under a folder of any store that Spark writes, as of the newest of each path's changes.

    The table is cut into buckets by path. A batch rewrites the buckets that it touches and names them in a new revision; all others stay
    as they are, so what it writes follows the changes, not the tree. A revision is seen whole or not at all. A
    batch whose number was applied before changes nothing, so a stream may hand it over again after a crash.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/revisions")
        self.buckets = self.versions.read()[1].get("of", buckets)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, tombstones too, of a revision, or those of some of its buckets."""
        held = {int(k): v for k, v in state.get("buckets", {}).items() if buckets is None or int(k) in buckets}
        if not held:
            return None
        return self.spark.read.schema(_KEPT.format(kind=state["kind"]).removesuffix(", bucket int")).parquet(*(f"{self.root}/{folder}/bucket={k}" for k, folder in sorted(held.items())))

    def files(self, revision: int | None = None) -> DataFrame:
        """(path, content, hash) of the files that are there, in the newest revision or another that is still kept."""
        state = self.versions.read(revision)[1]
        rows = self._rows(state)
        if rows is None:
            return self.spark.createDataFrame([], f"path string, content {state.get('kind', 'string')}, hash string")
        return rows.where("not deleted").select("path", "content", "hash")

    def state(self) -> Applied:
        number, state = self.versions.read()
        return Applied(number, state.get("fingerprint", NOTHING), state.get("files", 0), state.get("changes", {}))

    def apply(self, changes: DataFrame, batch: int | None = None) -> Applied:
        """Merge changes (path, content, and if given modified_at, nth, deleted) and publish the snapshot that follows.

        Of the changes of a path, those that the table has among them, the one of greatest (modified_at, nth) holds, of equal ones a deletion, then the greatest
        content's hash; so batches may come late and overlap. Without modified_at a batch is newer than all before it. A null path is no file and is left out; a null content is
        a deletion. A deleted path stays as a tombstone, so that an older change doesn't bring it back.
        """
        number, state = self.versions.read()
        if batch is not None and batch <= state.get("batch", -1):
            return self.state()
        of = changes.columns
        kind = changes.schema["content"].dataType.simpleString()
        gone = F.coalesce(F.col("deleted"), F.lit(False)) | F.col("content").isNull() if "deleted" in of else F.col("content").isNull()
        at = F.col("modified_at").cast("long") if "modified_at" in of else F.lit(state.get("newest", -1) + 1)
        new = changes.where("path is not null").select("path", F.when(~gone, content_hash(F.col("content"))).alias("hash"), F.when(~gone, F.col("content")).alias("content"), F.coalesce(at, F.lit(-(2**63))).alias("at"), (F.col("nth") if "nth" in of else F.lit(0)).cast("long").alias("nth"), gone.alias("deleted"), self._bucket())
        newest = F.max_by(F.struct("hash", "content", "at", "nth", "deleted"), F.struct("at", "nth", "deleted", F.coalesce("hash", F.lit("")))).alias("of")
        new = new.groupBy("path", "bucket").agg(newest).select("path", "of.*", "bucket").persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as the table has at most
            old = self._rows(state, touched)
            merged = new if old is None else old.withColumn("bucket", self._bucket()).unionByName(new).groupBy("path", "bucket").agg(newest).select("path", "of.*", "bucket")
            folder = f"data/{number + 1:010d}-{uuid4().hex}"
            if touched:
                merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        finally:
            new.unpersist()
        after = {"of": self.buckets, "kind": kind, "buckets": state.get("buckets", {}) | {str(k): folder for k in touched}}
        change = self._compared(self._rows(state, touched), self._rows(after, touched), kind)
        counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        counts = {k: counts.get(k, 0) for k in ("added", "changed", "removed")}
        after |= {"batch": batch if batch is not None else state.get("batch", -1), "changes": counts, "before": state.get("buckets", {}), "newest": state.get("newest", -1), "fingerprint": state.get("fingerprint", NOTHING), "files": state.get("files", 0)}
        if touched:
            after["newest"] = max(after["newest"], self._rows(after, touched).agg(F.max("at")).first()[0])
        if any(counts.values()):
            told = ordered_digests(self._rows(after).where("not deleted").select("path", "hash")).first()
            after |= {"fingerprint": told["membership_hash"], "files": told["files"]} if told else {"fingerprint": NOTHING, "files": 0}
        if not self.versions.create(number + 1, after):
            raise Conflict(f"another writer merged into {self.root}")
        return self.state()

    def _compared(self, old: DataFrame | None, new: DataFrame | None, kind: str) -> DataFrame:
        there = lambda rows: self.spark.createDataFrame([], "path string, hash string") if rows is None else rows.where("not deleted").select("path", "hash")
        return snapshot_diff(there(old), there(new), "path", "hash")

    def difference(self) -> DataFrame:
        """(path, change) of the paths that the newest revision added, changed or removed, from the buckets that it touched alone."""
        state = self.versions.read()[1]
        before = {"buckets": state.get("before", {}), "kind": state.get("kind", "string")}
        touched = [int(k) for k, folder in state.get("buckets", {}).items() if before["buckets"].get(k) != folder]
        return self._compared(self._rows(before, touched), self._rows(state, touched), before["kind"]).where("change <> 'unchanged'")

    def reconcile(self, listing: DataFrame) -> Applied:
        """Make the table what a listing (path, content) of the whole tree says: what it lacks is deleted, what is as it was stays."""
        told = listing.where("path is not null").select("path", "content", content_hash(F.col("content")).alias("told"))
        have = self.files().select("path", F.col("hash").alias("had"))
        changes = have.join(told, "path", "full_outer").where(~F.col("had").eqNullSafe(F.col("told")))
        return self.apply(changes.select("path", "content", F.col("told").isNull().alias("deleted")))

    def vacuum(self) -> int:
        """Delete data that no kept revision names; how many folders."""
        named = set()
        for number in self.versions.numbers():
            state = self.versions.read(number)[1]
            named |= {*state["buckets"].values(), *state["before"].values()}
        at = self.versions._path(f"{self.root}/data")
        gone = [s.getPath() for s in self.versions._fs.listStatus(at) if f"data/{s.getPath().getName()}" not in named]
        for path in gone:
            self.versions._fs.delete(path, True)
        return len(gone)
