"""All registered queries of the engine, with DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classification as C
from millrace.functions import identity as I
from millrace.functions import vectors as V
from millrace.functions.formatting import FORMATTER, embedding_input
from millrace.operators import policy, relations, search
from millrace.operators.chunking import chunk
from millrace.operators.filters import Condition
from millrace.session import ship
from millrace.sources.files import memberships, table_documents

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SCORES = {
    "cosine": f"list_dot_product({_Q}, e.embedding::DOUBLE[]) / (sqrt(list_dot_product({_Q}, {_Q})) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))",
    "dot-product": f"list_dot_product({_Q}, e.embedding::DOUBLE[])",
    "euclidean": f"0.0 - list_distance({_Q}, e.embedding::DOUBLE[])",
}


def _top_sql(metric: str, where: str = "true") -> str:
    return f"SELECT vec_id, label, round({_SCORES[metric]}, 6) AS score FROM embeddings e WHERE {where} ORDER BY {_SCORES[metric]} DESC, vec_id LIMIT 10"


def _top(spark: SparkSession, sf_dir: str, metric: str, conditions: list[Condition] = ()) -> DataFrame:
    found = search.top_k(_t(spark, sf_dir, "embeddings"), _first(spark, sf_dir), "embedding", ["vec_id"], 10, metric, list(conditions), ("label",))
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(_top_sql("cosine"))
def vector_topk_cosine(spark, sf_dir):
    return _top(spark, sf_dir, "cosine")


@query(_top_sql("dot-product"))
def vector_topk_dot(spark, sf_dir):
    return _top(spark, sf_dir, "dot-product")


@query(_top_sql("euclidean"))
def vector_topk_euclidean(spark, sf_dir):
    return _top(spark, sf_dir, "euclidean")


@query(_top_sql("cosine", "label = 3"))
def vector_topk_filter_equals(spark, sf_dir):
    return _top(spark, sf_dir, "cosine", [Condition("label", "equals", (3,))])


@query(_top_sql("cosine", "label IN (1, 2, 5)"))
def vector_topk_filter_in(spark, sf_dir):
    return _top(spark, sf_dir, "cosine", [Condition("label", "in", (1, 2, 5))])


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x
    FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0)
    SELECT query_id, vec_id, (row_number() OVER w)::INTEGER AS rank, round(x, 6) AS score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY x DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
)
def vector_topk_batch(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = search.top_k_batch(rows, asked, "embedding", "vec_id", "query_id", 5, "dot-product")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, 'sha256:' || sha256(source || '/' || doc_id || '.md') AS path_hash FROM documents")
def content_hash(spark, sf_dir):
    docs = table_documents(spark, sf_dir)
    return docs.select("doc_id", I.content_hash(F.col("text")).alias("hash"), I.content_hash(F.col("path")).alias("path_hash"))


def _field(x: str) -> str:
    return f"unhex(printf('%08X', octet_length(encode({x})))) || encode({x})"


def _identity_sql(namespace: str, *fields: str) -> str:
    parts = " || ".join(_field(x) for x in (f"'{namespace}'", "'1'", *fields))
    return f"'{namespace}_' || sha256({parts})"


_HASHED = "WITH h AS (SELECT doc_id, 'sha256:' || sha256(text) AS h, source || '/' || doc_id || '.md' AS p FROM documents), r AS (SELECT doc_id, p, h, " + _identity_sql("file-revision", "h") + " AS revision FROM h)"


@query(_HASHED + " SELECT doc_id, revision FROM r")
def identity_file_revision(spark, sf_dir):
    docs = table_documents(spark, sf_dir)
    return docs.select("doc_id", I.file_revision_id(I.content_hash(F.col("text"))).alias("revision"))


@query(_HASHED + " SELECT doc_id, " + _identity_sql("document", "'snapshot-1'", "p", "revision") + " AS document FROM r")
def identity_document(spark, sf_dir):
    docs = table_documents(spark, sf_dir)
    revision = I.file_revision_id(I.content_hash(F.col("text")))
    return docs.select("doc_id", I.document_id(F.lit("snapshot-1"), F.col("path"), revision).alias("document"))


@query(_HASHED + " SELECT doc_id, " + _identity_sql("chunk", "revision", "'whole'", "'0'", "doc_id::VARCHAR", "h") + " AS chunk FROM r")
def identity_chunk(spark, sf_dir):
    docs = table_documents(spark, sf_dir)
    hash_ = I.content_hash(F.col("text"))
    return docs.select("doc_id", I.chunk_id(I.file_revision_id(hash_), F.lit("whole"), F.lit("0"), F.col("doc_id").cast("string"), hash_).alias("chunk"))


@query("SELECT source, 'sha256:' || sha256(string_agg(source || '/' || doc_id || '.md' || chr(0) || 'sha256:' || sha256(text), chr(10) ORDER BY encode(source || '/' || doc_id || '.md'))) AS membership_hash FROM documents GROUP BY source")
def membership_hash(spark, sf_dir):
    docs = table_documents(spark, sf_dir)
    return memberships(docs.select("source", "path", F.col("text").alias("content")), "source").select("source", "membership_hash")


_PATHS = [".py", ".min.js", ".test.ts", ".md", ".yaml", ".txt", "/dist/x.js", "/package-lock.json", ".d.ts", "/Dockerfile", ".pyi"]


def _named(spark, sf_dir) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % len(_PATHS) + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("pkg/file"), F.col("doc_id"), ends).alias("path"))


_NAMED = "n AS (SELECT doc_id, text, 'pkg/file' || doc_id || [" + ", ".join(f"'{p}'" for p in _PATHS) + f"][doc_id % {len(_PATHS)} + 1] AS path FROM documents), f AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name, regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^.+\\.([^.]+)$', 1) AS e FROM n)"
_CONTENT = "CASE WHEN length(text) = 0 THEN 'text' WHEN r <= 0.02 THEN 'text' WHEN r >= 0.3 THEN 'binary' ELSE 'unknown' END"
_RATIO = "(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g'))) / length(text)"
_LANGUAGE = "CASE WHEN regexp_matches(text, '^#![^\\r\\n]*python') THEN 'python' WHEN name = 'dockerfile' THEN 'dockerfile' WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'js' THEN 'javascript' WHEN e = 'ts' THEN 'typescript' WHEN e = 'md' THEN 'markdown' WHEN e = 'yaml' THEN 'yaml' WHEN e = 'json' THEN 'json' END"
_MINIFIED = "(length(text) >= 500 AND list_max([length(x) for x in string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))]) >= 500 AND (length(text) - length(regexp_replace(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]', '', 'g'))) / length(text) < 0.1)"
_TRAITS = f"""list_filter_nulls([
    CASE WHEN path LIKE '%/dist/%' OR regexp_matches(text, '(?i)@generated|generated code|do not edit') THEN 'generated' END,
    CASE WHEN name LIKE '%.min.js' OR {_MINIFIED} THEN 'minified' END,
    CASE WHEN name = 'package-lock.json' THEN 'lockfile' END,
    CASE WHEN name = 'package-lock.json' OR e = 'yaml' THEN 'configuration' END,
    CASE WHEN e = 'md' THEN 'documentation' END,
    CASE WHEN name LIKE '%.test.ts' THEN 'test' END,
    CASE WHEN name LIKE '%.d.ts' OR e = 'pyi' THEN 'declaration' END,
    CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' END])""".replace("list_filter_nulls(", "list_filter(").replace("END])", "END], lambda x: x IS NOT NULL)")


@query(f"WITH {_NAMED}, g AS (SELECT *, {_RATIO} AS r FROM f) SELECT doc_id, {_CONTENT} AS kind, CASE WHEN length(text) = 0 THEN 1.0 WHEN r <= 0.02 THEN 0.98 WHEN r >= 0.3 THEN 0.9 ELSE 0.55 END::DOUBLE AS confidence FROM g")
def classify_content(spark, sf_dir):
    found = C.classify_content(F.col("text").cast("binary"))
    return _named(spark, sf_dir).select("doc_id", found.alias("c")).select("doc_id", "c.kind", "c.confidence")


@query(f"WITH {_NAMED} SELECT doc_id, {_LANGUAGE} AS language, nullif(e, '') AS extension FROM f")
def classify_language(spark, sf_dir):
    found = C.classify_language(F.col("path"), F.col("text"))["language"]
    return _named(spark, sf_dir).select("doc_id", found.alias("language"), C.extension(F.col("path")).alias("extension"))


@query(f"WITH {_NAMED} SELECT doc_id, array_to_string({_TRAITS}, ',') AS traits FROM f")
def classify_traits(spark, sf_dir):
    found = C.classify_traits(F.col("path"), F.octet_length("text"), F.col("text"))
    return _named(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("traits"))


def _policy_input(spark, sf_dir) -> DataFrame:
    data, text, path = F.col("text").cast("binary"), F.col("text"), F.col("path")
    told = _named(spark, sf_dir).select("doc_id", C.classify_content(data)["kind"].alias("kind"), F.octet_length("text").alias("size"), C.classify_language(path, text)["language"].alias("language"), C.classify_traits(path, F.octet_length("text"), text).alias("traits"))
    return told.withColumn("parses", F.coalesce(F.col("language").isin("python", "javascript", "typescript", "markdown", "json"), F.lit(False)))


_POLICY = f"WITH {_NAMED}, g AS (SELECT *, {_RATIO} AS r FROM f), h AS (SELECT doc_id, {_CONTENT} AS kind, octet_length(encode(text)) AS size, {_LANGUAGE} AS language, {_TRAITS} AS traits FROM g)"


@query(
    _POLICY
    + """ SELECT doc_id, CASE WHEN kind <> 'text' OR size = 0 OR language IS NULL OR len(list_intersect(traits, ['generated', 'minified', 'lockfile', 'configuration'])) > 0 OR size > 20000 OR language NOT IN ('python', 'javascript', 'typescript', 'markdown', 'json') THEN 'skip' ELSE 'index' END AS action,
    CASE WHEN kind = 'binary' THEN 'binary-content' WHEN kind = 'unknown' THEN 'unknown-content' WHEN size = 0 THEN 'empty-file' WHEN language IS NULL THEN 'plain-text'
    WHEN len(list_intersect(traits, ['generated', 'minified', 'lockfile', 'configuration'])) > 0 THEN 'excluded-trait' WHEN size > 20000 THEN 'file-too-large'
    WHEN language NOT IN ('python', 'javascript', 'typescript', 'markdown', 'json') THEN 'cast-parser-unavailable' END AS reason FROM h"""
)
def policy_code_only(spark, sf_dir):
    c = policy.code_only(F.col("kind"), F.col("size"), F.col("language"), F.col("traits"), F.col("parses"), limit=20_000)
    return _policy_input(spark, sf_dir).select("doc_id", c.alias("d")).select("doc_id", "d.action", "d.reason")


@query(
    _POLICY
    + """ SELECT doc_id, CASE WHEN kind <> 'text' OR size = 0 OR size > 20000 THEN 'skip' ELSE 'index' END AS action,
    CASE WHEN kind <> 'text' OR size = 0 OR size > 20000 THEN NULL WHEN language IN ('python', 'javascript', 'typescript', 'markdown', 'json') THEN 'cast' ELSE 'sliding-window' END AS strategy FROM h"""
)
def policy_text_and_code(spark, sf_dir):
    c = policy.text_and_code(F.col("kind"), F.col("size"), F.col("traits"), F.col("parses"), limit=20_000)
    return _policy_input(spark, sf_dir).select("doc_id", c.alias("d")).select("doc_id", "d.action", "d.strategy")


# Windows of 1500 characters, 200 overlapping: a step finds the last mark in a window's second half.
_LAST = "CASE WHEN instr(reverse(substr(text, s + 1, {w})), '{r}') > 0 THEN s + {w} - instr(reverse(substr(text, s + 1, {w})), '{r}') + 1 - {l} ELSE -1 END"
_WINDOWS = f"""WITH RECURSIVE w AS (
    SELECT doc_id, 0 AS start_offset, CASE WHEN n <= 1500 THEN n ELSE e END AS end_offset FROM (
        SELECT doc_id, length(text) AS n, CASE WHEN b >= 750 THEN b + 2 WHEN l >= 750 THEN l + 1 WHEN c >= 750 THEN c + 1 ELSE 1500 END AS e FROM (
            SELECT doc_id, text, {_LAST.format(w=1501, r=chr(10) * 2, l=2)} AS b, {_LAST.format(w=1500, r=chr(10), l=1)} AS l, {_LAST.format(w=1500, r=" ", l=1)} AS c FROM (SELECT *, 0 AS s FROM documents)))
    UNION ALL
    SELECT doc_id, s, CASE WHEN n <= s + 1500 THEN n WHEN b >= s + 750 THEN b + 2 WHEN l >= s + 750 THEN l + 1 WHEN c >= s + 750 THEN c + 1 ELSE s + 1500 END FROM (
        SELECT doc_id, s, length(text) AS n, {_LAST.format(w=1501, r=chr(10) * 2, l=2)} AS b, {_LAST.format(w=1500, r=chr(10), l=1)} AS l, {_LAST.format(w=1500, r=" ", l=1)} AS c FROM (
            SELECT d.doc_id, d.text, greatest(w.start_offset + 1, w.end_offset - 200) AS s FROM w JOIN documents d USING (doc_id) WHERE w.end_offset < length(d.text)))
)"""


@query(
    _WINDOWS
    + """ SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) - 1)::INTEGER AS chunk_index, start_offset::INTEGER AS start_offset, end_offset::INTEGER AS end_offset,
    (length(left(text, start_offset)) - length(replace(left(text, start_offset), chr(10), '')) + 1)::INTEGER AS start_line,
    (length(left(text, end_offset - 1)) - length(replace(left(text, end_offset - 1), chr(10), '')) + 1)::INTEGER AS end_line, sha256(substr(text, start_offset + 1, end_offset - start_offset)) AS content_sha256
    FROM w JOIN documents USING (doc_id) WHERE length(text) > 0"""
)
def sliding_window_chunks(spark, sf_dir):
    return chunk(_t(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "start_offset", "end_offset", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


@query(_WINDOWS + " SELECT source, count(*) AS chunks, sum(end_offset - start_offset)::BIGINT AS units, max(end_offset - start_offset)::INTEGER AS longest FROM w JOIN documents USING (doc_id) WHERE length(text) > 0 GROUP BY source")
def chunk_coverage_stats(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    size = F.col("end_offset") - F.col("start_offset")
    return chunk(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("chunks"), F.sum(size).alias("units"), F.max(size).alias("longest"))


@query()
def syntax_chunks_markdown(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.lit("markdown").alias("language"))
    return chunk(docs, "syntax", 1500).drop("content")


@query()
def syntax_chunks_html(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("html").alias("language"))
    return chunk(pages, "syntax", 1500).drop("content")


_INPUT = f"'formatter: {FORMATTER}' || chr(10) || 'path: ' || source || '/' || doc_id || '.md' || chr(10) || 'language: markdown' || chr(10) || 'kind: whole' || chr(10) || chr(10) || text"


@query(f"SELECT doc_id, sha256({_INPUT}) AS input_sha256, length({_INPUT}) AS input_chars FROM documents")
def embedding_input_text(spark, sf_dir):
    text = embedding_input(F.col("path"), F.lit("markdown"), F.col("text"), kind=F.lit("whole"))
    return table_documents(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("input_sha256"), F.length(text).cast("long").alias("input_chars"))


@query(
    """WITH p AS (SELECT item_id, i, ('0x' || substr(sha256('query' || chr(0) || text || chr(0) || i), 1, 8))::BIGINT AS w FROM benchmark, range(8) r(i)),
    s AS (SELECT item_id, i, ((CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END) / 2147483648.0)::FLOAT::DOUBLE AS x FROM p)
    SELECT item_id, i::INTEGER AS i, round((x / sqrt(sum(x * x) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 5) AS value FROM s"""
)
def fake_embedding(spark, sf_dir):
    vector = V.fake_embedding(F.col("text"), "query", 8)
    return _t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vector).alias("i", "x")).select("item_id", "i", F.round(F.col("x").cast("double"), 5).alias("value"))


@query("SELECT sha256(text) AS input, count(*) AS uses FROM documents GROUP BY 1")
def embed_dedup(spark, sf_dir):
    inputs = _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("input"), "text")
    return relations.deduplicated(inputs, "input", "text").select("input", "uses")


@query(
    """WITH RECURSIVE n AS (SELECT conv_id, turn, least(length(text), 1200) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    b AS (SELECT conv_id, k, turn, size AS total, 1 AS rows_, 0 AS batch FROM n WHERE k = 1
    UNION ALL SELECT n.conv_id, n.k, n.turn, CASE WHEN b.rows_ >= 3 OR b.total + n.size > 1200 THEN n.size ELSE b.total + n.size END,
    CASE WHEN b.rows_ >= 3 OR b.total + n.size > 1200 THEN 1 ELSE b.rows_ + 1 END, CASE WHEN b.rows_ >= 3 OR b.total + n.size > 1200 THEN b.batch + 1 ELSE b.batch END
    FROM b JOIN n ON n.conv_id = b.conv_id AND n.k = b.k + 1) SELECT conv_id, turn, batch FROM b"""
)
def greedy_batches(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.least(F.length("text"), F.lit(1200)).alias("size"))
    return relations.greedy_batches(rows, "conv_id", ["turn"], "size", 3, 1200).select("conv_id", "turn", "batch")


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 10 <> 3").withColumn("hash", F.when(F.col("doc_id") % 10 == 5, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))
    return docs.where("doc_id % 10 <> 7"), new


@query(
    """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 7), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN sha256(sha256(text) || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3)
    SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)"""
)
def snapshot_diff(spark, sf_dir):
    return relations.snapshot_diff(*_snapshots(spark, sf_dir), "doc_id", "hash")


@query(
    """WITH b AS (SELECT 'b' || k AS build_id, CASE k WHEN 3 THEN 'building' ELSE 'ready' END AS status, k AS done FROM range(5) r(k)),
    d AS (SELECT 'b' || (doc_id % 5) AS build_id, doc_id, sha256(text) AS h, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS parser FROM documents WHERE doc_id % 11 <> 0),
    m AS (SELECT c.doc_id AS ordinal, d.build_id, d.doc_id AS document_id, b.done FROM documents c JOIN d ON sha256(c.text) = d.h AND (CASE WHEN c.doc_id % 7 = 0 THEN NULL ELSE c.lang END) IS NOT DISTINCT FROM d.parser JOIN b USING (build_id) WHERE b.status = 'ready' AND d.doc_id % 13 <> 0)
    SELECT ordinal, build_id FROM m QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY done DESC, build_id, document_id) = 1"""
)
def reuse_best_source(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("revision"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("parser"))
    build = F.concat(F.lit("b"), F.col("doc_id") % 5)
    have = docs.where("doc_id % 11 <> 0").select(build.alias("build_id"), F.col("doc_id").alias("document_id"), "revision", "parser", F.lit("utf-8").alias("encoding"))
    builds = spark.range(5).select(F.concat(F.lit("b"), "id").alias("build_id"), F.lit("x").alias("compatibility"), F.when(F.col("id") == 3, "building").otherwise("ready").alias("status"), F.col("id").alias("completed_at"), F.lit(0).alias("created_at"))
    # documents divisible by 13 have a chunk that was made under another identity
    chunks = have.select("build_id", "document_id", F.when(F.col("document_id") % 13 == 0, "old").otherwise("new").alias("chunking_identity"))
    wanted = docs.select(F.col("doc_id").alias("ordinal"), "revision", "parser", F.lit("x").alias("compatibility"), F.lit("new").alias("chunking_identity"), F.array(F.lit("utf-8")).alias("encodings"))
    return relations.reusable(wanted, have, builds, chunks, ["revision", "parser"]).select("ordinal", "build_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gc_unreferenced(spark, sf_dir):
    return relations.unreferenced(_t(spark, sf_dir, "embeddings").select("vec_id"), _t(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


@query(
    """SELECT (SELECT count(*) FROM documents WHERE source = 'src3') AS memberships, (SELECT count(*) FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src3') WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE source <> 'src3')) AS embeddings"""
)
def delete_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("embedding"))
    mine = rows.where("source = 'src3'")
    gone = relations.unreferenced(mine.select("embedding").distinct(), rows.where("source <> 'src3'"), ["embedding"])
    return mine.agg(F.count("*").alias("memberships")).join(gone.agg(F.count("*").alias("embeddings")), F.lit(True))


@query(
    """SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
    coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), ','), '') AS after FROM conversations"""
)
def neighborhood(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    found = relations.neighbourhood(rows, "conv_id", ["turn"], F.col("turn").cast("string"), 2, 1)
    return found.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(
    f"""WITH h AS (SELECT vec_id, label, {_SCORES["cosine"]} AS x FROM embeddings e ORDER BY x DESC, vec_id LIMIT 50),
    k AS (SELECT *, row_number() OVER (ORDER BY x DESC, vec_id) AS semantic_rank FROM h)
    SELECT vec_id, (semantic_rank)::INTEGER AS semantic_rank, round(x, 6) AS semantic_score, label::DOUBLE AS score FROM k ORDER BY label DESC, semantic_rank LIMIT 10"""
)
def rerank_order(spark, sf_dir):
    limit, candidates = search.limits(10)
    hits = search.top_k(_t(spark, sf_dir, "embeddings"), _first(spark, sf_dir), "embedding", ["vec_id"], candidates)
    found = search.rerank(hits, F.col("label").cast("double"), limit, ["vec_id"])
    return found.select("vec_id", "semantic_rank", F.round("semantic_score", 6).alias("semantic_score"), "score")


_RANGES = "r AS (SELECT conv_id, turn * 3 AS a, turn * 3 + length(text) % 5 AS b FROM conversations)"


@query(
    f"""WITH {_RANGES}, m AS (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY a, b) AS island FROM m)
    SELECT conv_id, min(a) AS start_line, max(b) AS end_line, count(*) AS merged FROM i GROUP BY conv_id, island"""
)
def merge_ranges(spark, sf_dir):
    turn = F.col("turn") * 3
    ranges = _t(spark, sf_dir, "conversations").select("conv_id", turn.alias("start_line"), (turn + F.length("text") % 5).alias("end_line"))
    return relations.merge_ranges(ranges, "conv_id", "start_line", "end_line")


@query(
    f"""WITH h AS (SELECT vec_id, label, {_SCORES["cosine"]} AS x FROM embeddings e ORDER BY x DESC, vec_id LIMIT 40), k AS (SELECT *, row_number() OVER (ORDER BY x DESC, vec_id) AS n FROM h)
    SELECT label::VARCHAR AS document_id, min(n)::INTEGER AS first_rank, string_agg(vec_id::VARCHAR, ',' ORDER BY n) AS chunks FROM k GROUP BY label"""
)
def group_results(spark, sf_dir):
    hits = search.top_k(_t(spark, sf_dir, "embeddings"), _first(spark, sf_dir), "embedding", ["vec_id"], 40)
    from pyspark.sql.window import Window as W

    ranked = hits.select(F.col("label").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"), "score", F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    found = search.group_by_document(ranked)
    return found.select("document_id", "first_rank", F.array_join(F.transform("matched_chunks", lambda m: m["chunk_id"]), ",").alias("chunks"))


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.source IN ('src1', 'src2') AND l.toxic = 0")
def scope_sources_tags(spark, sf_dir):
    from millrace.operators.retrieval import scoped

    tagged = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_set(F.when(F.col("toxic") == 0, "clean").otherwise("toxic")).alias("tags"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("sourceId")).join(tagged, "doc_id")
    return scoped(docs, docs, ["src1", "src2"], ["clean"]).select("doc_id")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, event_id % 17 = 0 AS protected FROM events)
    SELECT event_id, protected OR row_number() OVER (PARTITION BY user_id, protected ORDER BY ts DESC, event_id) <= 3 AS retained FROM e"""
)
def retention_lru(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return relations.retained(rows, "user_id", "ts", "event_id", F.col("event_id") % 17 == 0, 3).select("event_id", "retained")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_ready_build(spark, sf_dir):
    return relations.latest(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS builds FROM orders GROUP BY 1")
def builds_by_status(spark, sf_dir):
    return relations.status_counts(_t(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "o_custkey", ["O", "F", "P"])


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, n > 5 AS has_more FROM r WHERE p >= 2 AND p < 5")
def page_slice(spark, sf_dir):
    return relations.page(_t(spark, sf_dir, "conversations"), "conv_id", ["turn"], 2, 3).select("conv_id", "turn", "has_more")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def semi_join(spark, sf_dir):
    returned = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return relations.referenced(_t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def anti_join(spark, sf_dir):
    tenth = _t(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return relations.unreferenced(_t(spark, sf_dir, "customer").select("c_custkey"), tenth, ["c_custkey"])


@query(
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), b AS (SELECT DISTINCT p FROM a WHERE o_orderkey % 3 = 0)
    SELECT coalesce(a.p, 'none') AS priority, count(*) AS n FROM a JOIN b ON a.p IS NOT DISTINCT FROM b.p GROUP BY 1"""
)
def null_safe_join(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    b = a.where("o_orderkey % 3 = 0").select(F.col("p").alias("q")).distinct()
    return a.join(b, I.all_equal([F.col("p")], [F.col("q")])).groupBy(F.coalesce("p", F.lit("none")).alias("priority")).agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
    b AS (SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n, (floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 7200) + 1)::BIGINT AS firings FROM b GROUP BY user_id, burst"""
)
def live_debounce(spark, sf_dir):
    found = relations.sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600, 7200)
    return found.select("user_id", F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_us"), "n", "firings")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from millrace.plans import composed  # noqa: F401 - registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from millrace.plans import composed  # noqa: F401 - registers its queries here

    return dict(_SQL)
