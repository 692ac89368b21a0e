"""A composed index build: classify, decide, decode, chunk, reuse, embed what is missing, publish."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import decoding
from millrace.functions import identity as I
from millrace.functions.classification import classify_traits, extension, sample_text
from millrace.functions.formatting import embedding_input
from millrace.operators import policy, relations
from millrace.operators.chunking import chunk
from millrace.operators.store import BuildStore
from millrace.syntax.registry import standard

STRATEGIES = {"cast": "syntax", "sliding-window": "sliding-window"}
#: Text that an embedding model takes at once.
BATCH_ROWS, BATCH_CHARACTERS = 32, 64_000


@dataclass(frozen=True)
class Plan:
    """What a build is made by. Overlap is a fifth of the chunk size, 200 at most, unless given."""

    policy: str = "text-and-code"
    strategies: tuple[str, ...] = ("cast", "sliding-window")
    most: int = 1500
    overlap: int | None = None
    on_failure: str = "skip"
    globs: tuple[tuple[str, str], ...] = ()
    fallback: str | None = None
    limit: int = decoding.LIMIT

    def __post_init__(self):
        if self.overlap is None:
            object.__setattr__(self, "overlap", min(200, self.most // 5))
        whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (self.most, self.overlap))
        if self.policy not in ("text-and-code", "code-only") or not self.strategies or len(set(self.strategies)) < len(self.strategies) or not set(self.strategies) <= set(STRATEGIES):
            raise ValueError(f"not a plan: policy {self.policy!r}, strategies {self.strategies}")
        if not whole or self.most < 1 or not 0 <= self.overlap < self.most or self.on_failure not in ("skip", "reject"):
            raise ValueError(f"not a plan: chunks of {self.most} with {self.overlap}, failures {self.on_failure!r}")

    def chunking(self, strategy: str) -> str:
        return f"cast:{self.most}" if strategy == "cast" else f"sliding-window:{self.most}:{self.overlap}"

    def compatibility(self, model: dict) -> str:
        """The hash of all that a document's artifacts depend on beside its bytes."""
        told = {"strategies": sorted(map(self.chunking, self.strategies)), "policy": self.policy, "model": dict(sorted(model.items())), "fallback": self.fallback}
        return "sha256:" + hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


@dataclass
class Report:
    """What a build did: its id, whether it was there already, its counters and the documents that failed or were left out."""

    build: str
    reused: bool = False
    counters: dict[str, int] = field(default_factory=dict)
    diagnostics: DataFrame | None = None


def decided(files: DataFrame, plan: Plan) -> DataFrame:
    """files (path, content) with classified, traits, read, decision and the encodings under which an earlier build may have read them."""
    own = F.col("encoding") if "encoding" in files.columns else None
    rows = files.withColumn("_chosen", decoding.selection(F.col("path"), own, list(plan.globs), plan.fallback))
    # a column of its own, which many read, is made once for each file, while a repeated expression is planned and worked out as often as it is named
    rows = rows.withColumn("_sample", sample_text(F.col("content")))
    rows = decoding.classified(rows, F.col("_chosen")).withColumn("byte_length", F.octet_length("content").cast("long"))
    rows = rows.withColumn("traits", classify_traits(F.col("path"), F.col("byte_length"), F.col("_sample")))
    read_by = sorted({language for language, _ in standard().targets})
    parses = F.coalesce(F.col("classified.language").isin(*read_by), F.lit(False)) if "cast" in plan.strategies else F.lit(False)
    said, size = F.col("classified"), F.col("byte_length")
    rule = policy.code_only(said["kind"], size, said["language"], F.col("traits"), parses, limit=plan.limit) if plan.policy == "code-only" else policy.text_and_code(said["kind"], size, F.col("traits"), parses, limit=plan.limit)
    rows = rows.withColumn("decision", rule).withColumn("read", decoding.read(F.col("content"), F.col("_chosen"), plan.limit))
    return rows.withColumn("encodings", decoding.compatible_encodings(F.col("_chosen"))).drop("_chosen", "_sample")


def chunks_of(documents: DataFrame, plan: Plan) -> DataFrame:
    """Chunks of documents (document_id, text, language, format, strategy), by each one's own strategy; with error where a parser fails."""
    parts = []
    for strategy in plan.strategies:
        mine = documents.where(F.col("strategy") == strategy).select(F.col("document_id").alias("doc_id"), "text", "language", "format")
        made = chunk(mine, STRATEGIES[strategy], plan.most, plan.overlap, failure="report")
        parts.append(made.withColumn("strategy", F.lit(strategy)).withColumn("chunking_identity", F.lit(plan.chunking(strategy))))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    for missing, kind in (("error", "string"), ("kind", "string")):
        if missing not in whole.columns:
            whole = whole.withColumn(missing, F.lit(None).cast(kind))
    return whole.withColumnRenamed("doc_id", "document_id")


def index(store: BuildStore, files: DataFrame, plan: Plan, model: dict, embed: Callable[[DataFrame], DataFrame], snapshot: str, created_at: str, completed_at: str | None = None, repository: str = "") -> Report:
    """Build the snapshot's files (path, content) into the store, and publish it.

    A ready build of the same snapshot, plan and model is returned as it is. Documents that any ready build of the repository has under the same
    plan and model keep their chunks and vectors, each from the build completed last that has it; of the others only inputs without a vector go to `embed`, which adds `vector` to rows (embedding_id, text).
    A document that can't be read or parsed is a diagnostic; with on_failure reject it fails the build. Any error leaves the build `failed`, a
    KeyboardInterrupt `cancelled`.
    """
    compatibility = plan.compatibility(model)
    build = "build_" + hashlib.sha256(f"{repository}\0{snapshot}\0{compatibility}".encode()).hexdigest()
    if not store.begin(build, model, created_at, compatibility, repository, snapshot):
        return Report(build, reused=True)
    try:
        report = _filled(store, build, files, plan, model, embed, snapshot, repository, compatibility)
    except KeyboardInterrupt:
        store.set_status(build, "cancelled")
        raise
    except Exception:
        store.set_status(build, "failed")
        raise
    store.set_status(build, "ready", completed_at or created_at)
    return report


def _filled(store, build, files, plan, model, embed, snapshot, repository, compatibility) -> Report:
    """Fill a build that was begun. Its stages are written beside the store's tables and read again, so that each is planned and made once, also where executors are lost."""
    work = store.workspace()
    rows = decided(files, plan).withColumn("revision", I.file_revision_id(I.content_hash(F.col("content"))))
    rows = rows.withColumn("document_id", I.document_id(F.lit(snapshot), F.col("path"), F.col("revision")))
    kept = None
    try:
        given = [c for c in ("sourceId", "tags") if c in files.columns]
        rows = work.placed("files", rows.select("path", "revision", "document_id", "byte_length", "read", "decision", "classified", "traits", "encodings", *given))
        taken = rows.where((F.col("decision.action") == "index") & F.col("read.error").isNull())
        documents = taken.select("document_id", "path", "revision", "byte_length", F.col("read.encoding").alias("encoding"), "classified.language", "classified.format", "traits", F.col("decision.strategy").alias("strategy"), "encodings", F.coalesce(extension(F.col("path")), F.lit("")).alias("extension"), _given(files, "sourceId", "string"), _given(files, "tags", "array<string>"), F.col("read.text").alias("text"))
        earlier = _earlier(store, model, repository, compatibility)
        if earlier:
            kept = work.placed("kept", _taken_over(store, earlier, documents, plan, compatibility))
        fresh = documents.join(kept.select("document_id"), "document_id", "left_anti") if kept is not None else documents
        made = chunks_of(fresh, plan).join(documents.drop("strategy", "text", "encodings"), "document_id")
        code = I.content_hash(F.col("content"))
        made = made.withColumn("chunk_id", I.chunk_id(F.col("revision"), F.col("chunking_identity"), F.col("start_offset"), F.col("end_offset"), code))
        context = {c: F.col(c) for c in ("scope", "symbols", "imports") if c in made.columns}
        text = embedding_input(F.col("path"), F.coalesce("language", F.lit("text")), F.col("content"), F.col("kind"), **context, prefix=model.get("document_prefix") or "", suffix=model.get("suffix") or "")
        # with their documents and ids, so that no later step joins or hashes contents again
        made = work.placed("made", made.withColumn("embedding_id", I.identity("embedding", *(F.lit(str(v)) for _, v in sorted(model.items())), I.content_hash(text))))
        failed = made.where("error is not null").select("document_id", "path", "error")
        refused = rows.where((F.col("decision.action") == "index") & F.col("read.error").isNotNull()).select("path", F.lit("unreadable").alias("code"), F.col("read.error").alias("detail"))
        left_out = rows.where("decision.action <> 'index'").select("path", F.col("decision.action").alias("code"), F.col("decision.reason").alias("detail"))
        broken = failed.select("path", F.lit("unparsable").alias("code"), F.col("error").alias("detail"))
        if plan.on_failure == "reject" and (refused.unionAll(broken).limit(1).count() or left_out.where("code = 'reject'").limit(1).count()):
            raise ValueError("a document failed, and the plan rejects failures")
        chunks = made.where("error is null")
        members = chunks.select("document_id", "chunk_id", "embedding_id", "chunk_index", "start_offset", "end_offset", "start_line", "end_line", "content", "chunking_identity", *_filterable(chunks))
        if kept is not None:
            # a document's source and tags are those that it has now
            again = _copied(store, kept).drop("sourceId", "tags").join(documents.select("document_id", "sourceId", "tags"), "document_id")
            members = members.unionByName(again.select(*members.columns))
        wanted = chunks.select("embedding_id", text.alias("text"))
        missing = work.placed("missing", store.missing(wanted, model))  # and counted before anything is put: what is missing isn't afterwards
        good_documents = documents.drop("encodings").join(failed.select("document_id"), "document_id", "left_anti")
        # what a later build needs to know to take a document over, so that it needn't read any chunks
        told_of = members.groupBy("document_id").agg(F.count("*").alias("chunks"), F.collect_set("chunking_identity").alias("made_by"))
        source = kept.select("document_id", F.col("build_id").alias("reused_from"), F.col("old_id").alias("reused_id")) if kept is not None else told_of.select("document_id", *(F.lit(None).cast("string").alias(c) for c in ("reused_from", "reused_id"))).where("false")
        good_documents = good_documents.join(told_of, "document_id", "left").join(source, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
        generated = missing.count()
        vectors = embed(missing)
        store.put(build, good_documents, members, vectors.select("embedding_id", "vector", *([I.content_hash(F.col("text")).alias("input_hash")] if "text" in vectors.columns else [])))
        store.put_diagnostics(build, refused.unionAll(broken).unionAll(left_out))
        return Report(build, False, _counted(store, build, missing, generated), store.diagnostics(build))
    finally:
        work.remove()


def _counted(store: BuildStore, build: str, missing: DataFrame, generated: int) -> dict[str, int]:
    """A build's counters, from what was written; an error if a chunk has no vector, or a document that was taken over not all the chunks that it had."""
    members, documents = (store.table(t).where(F.col("build_id") == build) for t in ("memberships", "documents"))
    if members.join(store.table("embeddings").select("embedding_id"), "embedding_id", "left_anti").limit(1).count():
        raise ValueError("a chunk has no vector")
    reused = F.col("reused_from").isNotNull()
    told = documents.agg(F.count("*").alias("indexed_documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("indexed_chunks"), F.count_if(reused).alias("reused_documents"), F.coalesce(F.sum(F.when(reused, F.col("chunks"))), F.lit(0)).alias("reused_chunks")).first().asDict()
    if told["reused_documents"]:
        old = store.table("documents").select(F.col("build_id").alias("reused_from"), F.col("document_id").alias("reused_id"), F.col("chunks").alias("had"))
        lost = documents.where(reused).join(old, ["reused_from", "reused_id"], "left").where("not (chunks <=> had)")
        if lost.limit(1).count():
            raise ValueError("not all chunks of a reused document were taken over")
    new = members.join(missing.select("embedding_id"), "embedding_id", "left_semi").count()
    failed = store.diagnostics(build).where("code in ('unreadable', 'unparsable')").count()
    return told | {"generated_embeddings": generated, "reused_embeddings": told["indexed_chunks"] - new, "failed_documents": failed}


def _given(files: DataFrame, column: str, kind: str):
    return F.col(column) if column in files.columns else F.lit(None).cast(kind).alias(column)


def _filterable(chunks: DataFrame) -> list:
    """The closed set of fields that a search can be filtered by; symbols are those around a chunk, then those in it, each once."""
    named = lambda part: F.array_distinct(F.concat(*(F.transform(F.coalesce(c, F.array().cast(_SYMBOLS)), lambda s: s[part]) for c in ("scope", "symbols")))) if "scope" in chunks.columns else F.array().cast("array<string>")
    own = ["path", "language", "format", "extension", "traits", "sourceId", "tags"]
    return [*own, F.col("strategy").alias("chunkingStrategy"), F.col("kind").alias("chunkKind"), named("name").alias("symbolNames"), named("kind").alias("symbolKinds")]


_SYMBOLS = "array<struct<name:string,kind:string,signature:string>>"


#: What must be equal, beside the encoding, for a document's chunks to be those of an earlier one.
_SAME = ["path", "revision", "language", "format"]


def _earlier(store: BuildStore, model: dict, repository: str, compatibility: str) -> list[dict]:
    """The ready builds of the same repository, compatibility and model."""
    rows = ({"build_id": name, **row} for name, row in store.builds().items())
    return [row for row in rows if row["status"] == "ready" and row["compatibility"] == compatibility and row.get("repository", "") == repository and row["model"] == model]


def _taken_over(store: BuildStore, earlier: list[dict], documents: DataFrame, plan: Plan, compatibility: str) -> DataFrame:
    """(document_id, build_id, old_id): whose chunks each document takes over, by one join with the manifests of all earlier builds."""
    names = [row["build_id"] for row in earlier]
    told = [(row["build_id"], "ready", row["compatibility"], row.get("completed_at"), row["created_at"]) for row in earlier]
    builds = store.spark.createDataFrame(told, "build_id string, status string, compatibility string, completed_at string, created_at string")
    manifest = store.table("documents").where(F.col("build_id").isin(names)).select("build_id", "document_id", *_SAME, "encoding", "chunks", "made_by")
    made_by = F.when(F.col("strategy") == plan.strategies[0], plan.chunking(plan.strategies[0]))
    for strategy in plan.strategies[1:]:
        made_by = made_by.when(F.col("strategy") == strategy, plan.chunking(strategy))
    candidates = documents.select(F.col("document_id").alias("ordinal"), *_SAME, made_by.alias("chunking_identity"), "encodings", F.lit(compatibility).alias("compatibility"))
    found = relations.planned_reuse(candidates, manifest, builds, _SAME)
    return found.select(F.col("ordinal").alias("document_id"), "build_id", F.col("document_id").alias("old_id"))


def _copied(store: BuildStore, kept: DataFrame) -> DataFrame:
    """The memberships of the documents that are taken over, under their new ids; only builds that give any are read."""
    names = [r["build_id"] for r in kept.select("build_id").distinct().collect()]  # at most as many as there are builds
    old = store.table("memberships").where(F.col("build_id").isin(names)).withColumnRenamed("document_id", "old_id")
    return old.join(kept, ["build_id", "old_id"]).drop("old_id", "build_id")
