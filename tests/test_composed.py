"""Builds and retrieval composed, catalogues, decoding, discovery, version control, live indexing."""

import subprocess

import duckdb
import pytest

from millrace.functions import decoding, names, positions
from millrace.operators import build, documentation, relations, retrieval
from millrace.operators.filters import Condition
from millrace.operators.store import BuildStore
from millrace.plans import catalogue
from millrace.sources import files, git
from millrace.streaming import live
from pyspark.sql import functions as F

MODEL = {"provider": "fake", "model": "m", "dimensions": 4, "metric": "cosine"}
FILES = [
    ("src/a.py", b"import os\n\n\ndef f(x):\n    return os.path.join(x, 'a')\n\n\nclass C:\n    def m(self):\n        return f(self)\n"),
    ("src/b.ts", b"import {q} from 'q'\nexport class B {\n  m() { return q }\n}\n"),
    ("docs/c.md", "# Title\n\nWords of a text.\n".encode()),
    ("bad/d.json", b"{"),
    ("bin/e.png", b"\x89PNG\r\n\x1a\n\x00"),
    ("old/f.txt", "Привет".encode("cp1251")),
    ("empty.py", b""),
]


def one(text):
    return [float(len(text) % 7 + 1), float(text.count("e") + 1), 1.0, 0.5]


def embed(rows):
    return retrieval.embedded(rows, lambda texts: [[float(len(t) % 7 + 1), float(t.count("e") + 1), 1.0, 0.5] for t in texts], 4)  # as one, known to workers


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_build_reuse_and_retrieval(spark, tmp_path):
    store, plan = BuildStore(spark, f"file://{tmp_path}/store"), build.Plan(most=80)
    first = build.index(store, table(spark, FILES), plan, MODEL, embed, "snapshot-1", "2026-01-01", "2026-01-01T01", "repo")
    told = {(r["path"], r["code"]): r["detail"] for r in first.diagnostics.collect()}
    assert told["bin/e.png", "skip"] == "binary-content" and told["empty.py", "skip"] == "empty-file" and "json" in told["bad/d.json", "unparsable"]
    assert first.counters["indexed_documents"] == 3 and first.counters["reused_documents"] == 0 and first.counters["generated_embeddings"] > 3 and first.counters["failed_documents"] == 1
    assert ("old/f.txt", "skip") in told
    again = build.index(store, table(spark, FILES), plan, MODEL, embed, "snapshot-1", "2026-01-02", None, "repo")
    assert again.reused and again.build == first.build
    changed = [FILES[0], ("src/b.ts", FILES[1][1] + b"export function n() {}\n"), *FILES[2:]]
    second = build.index(store, table(spark, changed), plan, MODEL, embed, "snapshot-2", "2026-01-03", "2026-01-03T01", "repo")
    assert second.counters["reused_documents"] == 2 and second.counters["reused_chunks"] > 0 and second.counters["indexed_documents"] == 3
    assert 0 < second.counters["generated_embeddings"] <= 2 and second.counters["reused_embeddings"] >= second.counters["reused_chunks"]
    other = build.index(store, table(spark, changed), plan, MODEL, embed, "snapshot-2", "2026-01-04", "2026-01-04T01", "another")
    assert other.counters["reused_documents"] == 0 and other.counters["generated_embeddings"] == 0
    members = store.table("memberships").where(F.col("build_id") == second.build)
    whole = "".join(r["content"] for r in members.where("path = 'src/a.py'").orderBy("chunk_index").collect())
    assert whole == FILES[0][1].decode()

    found = retrieval.retrieve(store, second.build, one("query"), MODEL, 3).orderBy("rank").collect()
    best = sorted(members.join(store.table("embeddings"), "embedding_id").collect(), key=lambda r: (-cosine(one("query"), r["vector"]), r["document_id"], r["chunk_id"]))[:3]
    assert [r["chunk_id"] for r in found] == [r["chunk_id"] for r in best] and all(r["content"] for r in found)
    only = retrieval.retrieve(store, second.build, one("query"), MODEL, 5, [Condition("language", "equals", ("python",))])
    assert {r["path"] for r in only.collect()} == {"src/a.py"}
    named = retrieval.retrieve(store, second.build, one("query"), MODEL, 5, [Condition("symbolNames", "in", ("n",)), Condition("chunkingStrategy", "equals", ("cast",)), Condition("extension", "equals", ("ts",))])
    assert {r["path"] for r in named.collect()} == {"src/b.ts"}
    assert {r["path"] for r in retrieval.search_project(store, second.build, one("query"), MODEL, language="markdown").collect()} == {"docs/c.md"}
    scored = retrieval.retrieve(store, second.build, one("query"), MODEL, 2, reranker=lambda hits: hits.withColumn("new_score", F.length("content").cast("double")))
    assert [r["score"] for r in scored.orderBy("rank").collect()] == sorted((float(len(r["content"])) for r in members.collect()), reverse=True)[:2]
    kept = retrieval.retrieve(store, second.build, one("query"), MODEL, 2, reranker=lambda hits: 1 / 0, failure="use-semantic-order")
    assert [r["chunk_id"] for r in kept.orderBy("rank").collect()] == [r["chunk_id"] for r in best[:2]]
    assert retrieval.retrieve(store, "missing", one("q"), MODEL).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(store, second.build, one("q"), MODEL | {"model": "other"})
    assert list(store.builds())[0] == other.build  # the newest first


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)


def test_what_many_columns_read_is_made_once_for_each_file(spark):
    plan = build.decided(table(spark, FILES), build.Plan())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content#") < 200  # an expression that is named again is worked out again


@pytest.mark.parametrize("blank, minified", [("    ", True), (" \t\u00a0\u3000", True), ("     ", False), (" \t \u00a0\u3000", False), ("\t\t\t\t\t", False)])
def test_minified_by_all_white_space(spark, blank, minified):
    """Of 50 characters four or five are white space, of any kind; spaces alone decide where they are a tenth."""
    line = ("x" * (50 - len(blank)) + blank) * 10
    short = "\n".join([line[:499]] * 2)
    rows = [("a.js", line.encode()), ("b.js", short.encode()), ("c.js", line[:499].encode()), ("d.js", b"#! /usr/bin/env node\n\x00"), ("e", b"#! /usr/bin/env node\n\x01"), ("f", b" #! node"), ("g.py", b"\xff")]
    told = {r["path"]: r for r in build.decided(table(spark, rows), build.Plan()).select("path", "traits", "classified.kind", "classified.language", "read.error").collect()}
    assert [p for p in told if "minified" in told[p]["traits"]] == ["a.js"] * minified
    assert told["d.js"]["kind"] == "binary" and told["e"]["language"] == "javascript" and told["f"]["language"] is None and told["g.py"]["error"] == "malformed-content"
    assert [told[p]["kind"] for p in ("a.js", "e", "g.py")] == ["text", "unknown", "unknown"]


def test_failing_builds(spark, tmp_path):
    store = BuildStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="rejects"):
        build.index(store, table(spark, FILES), build.Plan(on_failure="reject"), MODEL, embed, "s", "2026-01-01")
    assert [b["status"] for b in store.builds().values()] == ["failed"]
    with pytest.raises(ValueError, match="failed"):
        build.index(store, table(spark, FILES), build.Plan(on_failure="reject"), MODEL, embed, "s", "2026-01-01")

    def stop(rows):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        build.index(store, table(spark, FILES[:1]), build.Plan(), MODEL, stop, "s2", "2026-01-01")
    assert "cancelled" in {b["status"] for b in store.builds().values()}
    for bad in ({"strategies": ()}, {"strategies": ("cast", "cast")}, {"strategies": ("x",)}, {"most": 0}, {"overlap": 1500}, {"policy": "x"}):
        with pytest.raises(ValueError):
            build.Plan(**bad)
    assert build.Plan(most=100).overlap == 20 and build.Plan().overlap == 200


def test_a_put_that_is_tried_again_doubles_nothing(spark, tmp_path):
    store = BuildStore(spark, f"file://{tmp_path}/store")
    store.begin("b:1", MODEL, "2026-01-01")
    documents, members = spark.createDataFrame([("d", "p")], "document_id string, path string"), spark.createDataFrame([("d", "c", "e", 0)], "document_id string, chunk_id string, embedding_id string, chunk_index int")
    vectors = spark.createDataFrame([("e", [1.0])], "embedding_id string, vector array<float>")
    for _ in range(2):
        store.put("b:1", documents, members, vectors)
    store.set_status("b:1", "ready")
    assert store.searchable("b:1").count() == 1 and store.table("documents").count() == 1
    store.begin("b2", MODEL, "2026-01-02")
    store.put("b2", documents, members.withColumn("embedding_id", F.lit("e2")), vectors.withColumn("embedding_id", F.lit("e2")))
    store.set_status("b2", "ready")
    assert store.delete("b:1")["embeddings"] == 1 and store.searchable("b2").count() == 1 and store.table("embeddings").count() == 1


def test_lost_texts_are_errors(spark):
    hits = spark.createDataFrame([("d", "c", 1)], "document_id string, chunk_id string, rank int")
    texts = spark.createDataFrame([("d", "x", "t")], "document_id string, chunk_id string, content string")
    with pytest.raises(Exception, match="no row"):
        retrieval.hydrated(hits, texts, ["document_id", "chunk_id"]).collect()
    with pytest.raises(Exception, match="no chunk"):
        relations.members(hits, texts, ["content"]).collect()


def test_compression(spark):
    text = "\n".join(f"line {i}" for i in range(1, 41))
    hits = spark.createDataFrame([(f"d{i}", f"c{i}{j}", 2 * i + j + 1, 1.0, f"p{i}", 3 + 10 * j, 5 + 10 * j, "x") for i in range(7) for j in range(2)], "document_id string, chunk_id string, rank int, score double, path string, start_line int, end_line int, content string")
    documents = spark.createDataFrame([(f"d{i}", text) for i in range(7)], "document_id string, text string")

    def select(query, path, source):
        if path == "p1":
            return []
        if path == "p2":
            raise TimeoutError
        if path == "p3":
            return [(39, 50)]
        if path == "p4":
            raise ConnectionError
        return [(3, 4), (5, 6), (20, 20)]

    found = retrieval.compress(hits, documents, "q", select)
    told = {r["document_id"]: (r["status"], r["reason"]) for r in found.collect()}
    assert told == {"d0": ("selected", None), "d2": ("fallback", "timeout"), "d3": ("fallback", "invalid-selection"), "d4": ("fallback", "unavailable"), "d5": ("fallback", "file-limit"), "d6": ("fallback", "file-limit")}
    shown = retrieval.presented(found).collect()
    assert shown[0]["excerpts"] == '[[3, 6, "line 3\\nline 4\\nline 5\\nline 6\\n"], [20, 20, "line 20\\n"]]' and len(shown[0]["matched_chunks"]) == 2 and len(shown) == 11
    source, ranges = retrieval.shown(text, [(3, 5), (30, 31)], [(1, 2), (6, 9), (39, 40)], 10, 1034 + 100)
    assert ranges[0][0] <= 3 and any(a <= 30 <= b for a, b in ranges) and len(source.encode()) <= 100 and "[omitted source]" in source
    assert retrieval.shown(text, [(3, 5)], [], 10, 16_384)[1] == [(1, 40)]
    for bad in ([(0, 1)], [(1, 99)], [(2, 1)], [(1, 1)] * 13, "x", [(1, 2.0)]):
        with pytest.raises(ValueError):
            retrieval.selected(text, bad, [(1, 40)])
    with pytest.raises(ValueError):
        retrieval.selected(text, [(1, 40)], [(1, 40)], 10)


def test_documentations(spark, tmp_path):
    docs = documentation.Documentations(spark, f"file://{tmp_path}/docs")
    made = docs.create(" Guide ", "t0")
    assert made["name"] == "Guide" and docs.resolve("guide")["id"] == made["id"]
    with pytest.raises(ValueError):
        docs.create("GUIDE", "t0")
    one_ = docs.upsert("guide", [{"external_id": "x/a.md", "content": "text", "tags": ["b", "a"]}], "t1")
    source = next(iter(one_["sources"]))
    assert one_["revision"] == 2 and one_["sources"][source]["title"] == "a.md" and one_["sources"][source]["tags"] == ["a", "b"]
    assert docs.upsert("guide", [{"external_id": "x/a.md", "content": "text"}], "t2")["revision"] == 2
    two = docs.upsert("guide", [{"external_id": "x/a.md", "content": "other", "title": "T"}], "t3")
    assert two["revision"] == 3 and two["sources"][source]["tags"] == ["a", "b"] and two["sources"][source]["created_at"] == "t1"
    with pytest.raises(ValueError, match="belongs"):
        docs.upsert("guide", [{"external_id": "y", "content": "", "path": two["sources"][source]["path"]}], "t4")
    assert docs.tag("guide", source, "add", ("a",), "t5")["revision"] == 3 and docs.tag("guide", source, "remove", ("a",), "t5")["sources"][source]["tags"] == ["b"]
    assert docs.tag("guide", source, "set", ("z", "z"), "t5")["sources"][source]["tags"] == ["z"] and docs.tag("guide", source, "clear", (), "t5")["sources"][source]["tags"] == []
    now = docs.resolve("guide")["revision"]
    with pytest.raises(RuntimeError):
        docs.activate("guide", "b", now - 1, "t6")
    docs.activate("guide", "b", now, "t6")
    assert docs.active("guide") == "b"
    docs.add_directory("guide", "/root", "t7")
    assert docs.active("guide") is None and len(docs.resolve("guide")["sources"]) == 2
    docs.remove_source("guide", source, "t8")
    docs.rename("guide", "Manual", "t9")
    docs.delete("manual")
    assert docs.all() == []
    old = spark.createDataFrame([("a", "t", "x"), ("b", "u", "y")], "k string, title string, media string")
    new = spark.createDataFrame([("a", None, "z"), ("b", None, None), ("c", "v", None)], old.schema)
    assert sorted(map(tuple, documentation.merge_documents(old, new, "k", ["title", "media"]).collect()), key=str) == [("a", "t", "z", "updated"), ("b", "u", "y", "kept"), ("c", "v", None, "added")]


def test_targets(spark, tmp_path):
    targets = documentation.Targets(documentation.Manifests(spark, f"file://{tmp_path}/t"), "project")
    ready = {"b1", "b2", "b3"}
    assert targets.resolve() is None and targets.resolve("b9") == ("latest-ready", "b9")
    targets.assign("main", "b1", ready)
    targets.switch(target="main", ready=ready)
    assert targets.resolve() == ("target", "b1")
    targets.assign("main", "b2", ready)
    assert targets.resolve() == ("target", "b2") and targets.read()[1]["targets"]["main"]["retained"] == ["b1"]
    targets.rename("main", "prod")
    assert targets.resolve() == ("target", "b2") and targets.protected() == {"b2"}
    with pytest.raises(ValueError):
        targets.delete_build(None, "b2")
    for call in (lambda: targets.assign("../x", "b1", ready), lambda: targets.assign("x", "no", ready), lambda: targets.switch(), lambda: targets.rename("prod", "prod")):
        with pytest.raises(ValueError):
            call()
    targets.lease("s1", 100.0)
    with pytest.raises(RuntimeError):
        targets.lease("s2", 105.0)
    with pytest.raises(RuntimeError):
        targets.fresh("b2", 105.0)
    targets.publish("s1", "live/main", "b3", ready, 106.0)
    assert targets.resolve() == ("target", "b3") and targets.fresh("b3", 107.0) == "b3" and targets.fresh("b2", 200.0) == "b2"
    targets.lease("s2", 200.0)  # s1 is stale: what was selected before comes back
    assert targets.resolve() == ("target", "b2")
    targets.stop("s2", 201.0)
    assert targets.read()[1]["session"] is None
    targets.remove("prod")
    assert targets.resolve("b9") is None
    targets.switch(build="b1", ready=ready)
    assert targets.resolve() == ("build", "b1") and "b1" in targets.protected()
    targets.deactivate()
    assert targets.resolve("b9") is None
    roots = spark.createDataFrame([("p", "/a"), ("q", "/a/b")], "project string, root string")
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",), ("/a",)], "path string")
    assert dict(map(tuple, documentation.nearest_project(roots, paths).collect())) == {"/a/b/c": "q", "/a/bc": "p", "/x": None, "/a": "p"}
    presets = documentation.Configurations(spark, f"file://{tmp_path}/c", "preset", {"most": int})
    presets.put("small", {"most": 100})
    presets.put("small", {"most": 200})
    assert presets.all() == [{"most": 200, "name": "small"}]
    for bad in ({"x": 1}, {"most": "1"}):
        with pytest.raises(ValueError):
            presets.put("bad", bad)
    presets.remove("small")
    assert presets.all() == []


def test_decoding(spark):
    rows = [("a", b"\xef\xbb\xbfx", None), ("b", "é".encode(), None), ("c", "Привет".encode("cp1251") + b"\x98", None), ("d", b"\xcf", " CP1251 "), ("e", b"\xff\xfe", "utf8"), ("f", b"x" * 50, None), ("g", b"x", "koi8"), ("h", b"", None), ("glob/i", b"\xcf", None)]
    df = spark.createDataFrame(rows, "path string, content binary, encoding string")
    for fallback, third in ((None, (None, "malformed-content", None)), ("Windows1251", ("Привет\x98", None, "fallback"))):
        chosen = decoding.selection(F.col("path"), F.col("encoding"), [("glob/*", "win1251"), ("**", "utf-8")][:1], fallback)
        got = {r["path"]: r["r"] for r in df.select("path", decoding.read(F.col("content"), chosen, 40).alias("r")).collect()}
        assert (got["a"]["text"], got["a"]["source"]) == ("x", "byte-order-mark") and got["b"]["text"] == "é" and (got["c"]["text"], got["c"]["error"], got["c"]["source"]) == third
        assert got["d"]["text"] == "П" and got["e"]["error"] == "malformed-content" and got["f"]["error"] == "file-too-large" and got["g"]["error"] == "unsupported-encoding"
        assert got["h"]["text"] == "" and got["f"]["byte_length"] == 50 and got["glob/i"]["text"] == "П"
        encodings = {r["path"]: r["e"] for r in df.select("path", decoding.compatible_encodings(chosen).alias("e")).collect()}
        assert encodings["d"] == ["windows-1251"] and encodings["a"] == (["utf-8"] if fallback is None else ["utf-8", "windows-1251"])
    with pytest.raises(ValueError):
        decoding.selection(F.col("path"), fallback="utf-8")
    chosen = decoding.selection(F.col("path"), F.col("encoding"), fallback="cp1251")
    files_ = spark.createDataFrame([("a.py", b"x = 1", None), ("b.py", b"\x89PNG\r\n\x1a\n", None), ("c.py", "Привет".encode("cp1251"), None), ("d.py", b"", "cp1251"), ("e.py", b"\x01" * 9 + b"\xff", None), ("f.py", b"\xff", "utf-8"), ("g.py", b"a\x00", None)], df.schema)
    told = {r["path"]: r["classified"] for r in decoding.classified(files_, chosen).collect()}
    assert [(told[p]["kind"], told[p]["confidence"], told[p]["encoding"], told[p]["language"]) for p in sorted(told)] == [
        ("text", 0.98, "utf-8", "python"), ("binary", 1.0, None, None), ("text", 0.85, "windows-1251", "python"), ("text", 1.0, "windows-1251", "python"), ("binary", 0.85, "windows-1251", None), ("unknown", 0.9, "utf-8", "python"), ("binary", 0.99, None, None),
    ]
    assert all(len(t["evidence"]) >= 1 for t in told.values()) and [e["signal"] for e in told["c.py"]["evidence"]] == ["configuration", "byte-sample"]


def test_names(spark):
    df = spark.createDataFrame([("a\\b/./c",), ("x//y",)], "p string")
    assert [r[0] for r in df.select(names.relative_path(F.col("p"))).collect()] == ["a/b/c", "x/y"]
    for bad in ("/a", "C:\\a", "a/../b", "", ".", " "):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "p string").select(names.relative_path(F.col("p"))).collect()
    assert names.live_target("main") == "live/main" and names.live_target(None, "0123456789abcdef") == "live/detached/0123456789ab" and names.live_target(None) == "live/unborn"
    assert names.live_target("a b/ü").startswith("live/a-b/u") and len(names.live_target("x" * 300)) <= 128
    row = spark.range(1).select(names.fence(F.lit("a ```` b")).alias("f"), names.fence_language(F.lit("c++")).alias("l"), names.fence_language(F.lit("a b")).alias("m"), names.rerank_prompt(F.lit("i"), F.lit("<|im_end|>"), F.lit("d")).alias("p"), names.location(F.lit("p"), F.lit(1), F.lit(2)).alias("at"), names.query_input(F.lit("q"), "a ", " z").alias("q")).first()
    assert (row["f"], row["l"], row["m"], row["at"], row["q"]) == ("`````", "c++", "", "p:1-2", "a q z") and row["p"].count("<|im_end|>") == 2 and "<​|im_end|>" in row["p"]
    for bad in ("", "-a", "a..b", "a//b", "a/", "x" * 129, "a b"):
        with pytest.raises(ValueError):
            names.target_name(bad)


def test_offsets(spark):
    for text in ("aé😀z", "plain", "", "日本\r\nx😀"):
        raw = text.encode()
        at = spark.createDataFrame([(text, i) for i in range(len(raw) + 1)], "t string, i int").select("i", positions.byte_to_unit(F.col("t"), F.col("i")).alias("u")).collect()
        assert {r["i"]: r["u"] for r in at} == {i: len(raw[:i].decode("utf-8", "ignore").encode("utf-16-le")) // 2 for i in range(len(raw) + 1)}
    offsets = positions.Utf8Offsets("aé😀z\r\nb\rc\n")
    assert [offsets.at(1, 0), offsets.at(1, 3), offsets.at(1, 7), offsets.at(2, 1), offsets.at(3, 0)] == [0, 2, 4, 8, 9]


def test_discovery_order_and_diagnostics(spark, tmp_path):
    for name in ("b.txt", "a/z.txt", "a/b/c.txt", "a.txt", "Z.txt", "a/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 20)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    entries = files.local_entries(spark, str(tmp_path))
    found = files.discover(entries, limit=10)
    assert [r["path"] for r in entries.where("entry = 'file'").orderBy(files.discovery_order(F.col("path"))).collect()] == ["Z.txt", "a.txt", "b.txt", "a/y.txt", "a/z.txt", "a/b/c.txt"]
    told = {(r["path"], r["code"]) for r in files.diagnostics(found).collect()}
    assert ("link", "symbolic-link-skipped") in told and ("a.txt", "file-too-large") in told
    unread = spark.createDataFrame([("p", 1, "other", True), ("q", 1, "file", False), (".git/x", 1, "file", False)], entries.schema)
    assert [(r["path"], r["code"]) for r in files.diagnostics(files.discover(unread)).collect()] == [("p", "unsupported-entry"), ("q", "entry-unreadable")]
    assert files.selection_hash(["a", "b"]) == files.selection_hash(["b", "a"]) != files.selection_hash(["a"])


def test_version_control(spark, tmp_path):
    assert [(c.path, c.kind, c.staged, c.unstaged, c.previous) for c in git.parse_status("R  new\0old\0?? u\0 M m\0AA x\0D  d\0A  a\0C  c\0b\0")] == [
        ("a", "added", True, False, None), ("c", "copied", True, False, "b"), ("d", "deleted", True, False, None), ("m", "modified", False, True, None), ("new", "renamed", True, False, "old"), ("u", "untracked", False, True, None), ("x", "conflicted", True, True, None),
    ]
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("a")
    run = lambda *words: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *words], check=True, capture_output=True)
    assert git.project_source(spark, f"{root}")[1]["kind"] == "directory"
    run("init", "-q", "-b", "main")
    found, source = git.project_source(spark, str(root))
    assert source["identity"].startswith("git-working-tree:unborn:") and source["dirty"]
    run("add", ".")
    run("commit", "-q", "-m", "x")
    (root / "sub").mkdir()
    (root / "sub/.gitignore").write_text("*.log\n")
    (root / "sub/b.log").write_text("b")
    found, source = git.project_source(spark, str(root))
    assert source["head"] == git.resolve_ref(str(root), "HEAD") and source["branch"] == "main" and [r["path"] for r in found.collect()] == ["a.txt"]
    with pytest.raises(ValueError):
        git.project_source(spark, str(root), allow_dirty=False)
    with pytest.raises(ValueError):
        git.resolve_ref(str(root), "nowhere")


def test_live_batches_know_what_was_published(spark, tmp_path):
    schema, seen = "path string, content string, modified_at long", []
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    watch = lambda **more: live.watch(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/check", lambda f, n: seen.append(sorted(r["content"] for r in f.collect())), **more).awaitTermination()
    put("one", [("p", "a", 1), ("p", "b", 2)])
    watch()
    put("two", [("p", "b", 3)])
    watch()  # as it was: not built, although the stream is another
    assert seen == [["b"]]
    put("three", [("p", "c", 4)])
    later = [spark.createDataFrame([("p", "d")], "path string, content string")] * 2
    watch(current=lambda: later.pop() if later else spark.createDataFrame([("p", "d")], "path string, content string"))
    assert seen == [["b"], ["c"], ["d"]]


def test_relations(spark):
    parts = spark.createDataFrame([("d", 1, 10, 20, "use foo here"), ("d", 2, 50, 60, "nothing"), ("e", 1, 10, 20, "foo")], "doc string, n int, start int, end int, text string")
    symbols = spark.createDataFrame([("d", "outer", 0, 100), ("d", "inner", 5, 25), ("d", "later", 55, 58)], "doc string, name string, start int, end int")
    got = {(r["doc"], r["n"]): r["container"] for r in relations.smallest_container(parts, symbols, "doc", ["n"]).collect()}
    assert got == {("d", 1): "inner", ("d", 2): "outer", ("e", 1): None}
    imports = spark.createDataFrame([("d", "m", ["foo"], 0, 5), ("d", "k", ["bar"], 55, 70)], "doc string, source string, bindings array<string>, start int, end int")
    assert {(r["doc"], r["n"]): r["imports"] for r in relations.relevant_imports(parts, imports, "doc", ["n"]).collect()} == {("d", 1): ["m"], ("d", 2): ["k"], ("e", 1): []}
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0)], "g string, i int")
    near = relations.around_anchor(rows, "g", "i", spark.createDataFrame([("a", 4), ("b", 3)], rows.schema), 2, 1).orderBy("i").collect()
    assert [(r["i"], r["distance"]) for r in near] == [(2, -2), (3, -1), (4, 0), (5, 1)]
    assert [tuple(r) for r in relations.counted(spark.createDataFrame([("a",), ("z",)], "g string"), rows, ["g"], "n").orderBy("g").collect()] == [("a", 10), ("z", 0)]
    texts = spark.createDataFrame([("k", "ccc"), ("l", "a"), ("m", "bb")], "key string, text string")
    assert [r["key"] for r in relations.by_length(texts, "text", "key", 1).collect()] == ["l", "m", "k"]
    assert spark.range(1).select(relations.page_text(F.lit("abcdef"), 2, 3).alias("p")).first()["p"].asDict() == {"text": "cde", "next_start": 5}
    assert spark.range(1).select(relations.page_text(F.lit("abc"), 2, 3).alias("p")).first()["p"].asDict() == {"text": "c", "next_start": None}


def test_classified_bytes_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Texts that are null, empty, marked, full of control characters, like a binary file or longer than a sample, in each of the four forms."""
    odd = [None, "", "a\x00b", "\x01", "\x01" * 3 + "a" * 97, "\x85\x9f" * 9, "﻿", "﻿a", "%PDF-1", "GIF89a", "PK\x03\x04", "é" * 40_000, "a" + "€" * 30_000, "\x7f" * 70_000, "\t\n\x0c\r"]
    rows = [(4 * i + turn, text) for i, text in enumerate(odd) for turn in range(4)] + [(None, "a"), (-3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["classify_bytes"]).fetchall()
    got = [(r["doc_id"], r["kind"], r["confidence"]) for r in catalogue.queries()["classify_bytes"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_symbol_containers_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """A null text has a part without a container, an empty one a part with one."""
    rows = [(i, text) for i, text in enumerate([None, "", None, "a", "", "b" * 99, "c" * 100, "é" * 4001, None, "", "d" * 250])] + [(None, "a" * 99)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["symbol_container"]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["symbol_container"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
