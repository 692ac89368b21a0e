"""Literal cases of the engine's operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import classification as C
from millrace.functions import identity, vectors
from millrace.functions.positions import Lines, line_of, utf16_length
from millrace.operators import policy, relations, search
from millrace.operators.chunking import Units, check_window, chunk, leaf_cuts, syntax_chunks, windows
from millrace.operators.filters import Condition, matches
from millrace.operators.store import BuildStore
from millrace.sources.files import discover, glob_regex, read_folder, snapshot, union_sources
from millrace.streaming.live import watch


def test_windows_literals():
    assert [Units("😀x").slice(a, b) for a, b in windows(Units("😀x"), 1, 0)] == ["😀", "x"]
    with pytest.raises(ValueError):
        check_window(10, 10)
    assert windows(Units(""), 10, 1) == []
    text = "a" * 9 + "\n\n" + "b" * 5
    assert windows(Units(text), 10, 0)[0] == (0, 11)  # one beyond the maximum: the blank line begins at the last unit


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n😀Ж", max_size=120), st.integers(2, 20), st.integers(0, 10))
def test_windows_cover(text, most, overlap):
    overlap = min(overlap, most - 1)
    units = Units(text)
    found = windows(units, most, overlap)
    if units.text:
        assert found[0][0] == 0 and found[-1][1] == len(units.text)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(found, found[1:]))
        assert all(b - a <= most + 1 for a, b in found)


def test_leaf_cuts():
    assert [("indivisible!")[a:b] for a, b in leaf_cuts(Units("indivisible!"), 0, 12, 4)] == ["indi", "visi", "ble!"]
    text = "alpha;beta;gamma;"
    assert [text[a:b] for a, b in leaf_cuts(Units(text), 0, len(text), 7)] == ["alpha;", "beta;", "gamma;"]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="#ab \n;", max_size=150), st.sampled_from(["markdown", "python", "html", "json", None]))
def test_syntax_chunks_cover(text, language):
    found = syntax_chunks(Units(text), 20, language or "")
    assert "".join(text[a:b] for a, b in found) == text
    assert all(b - a <= 20 for a, b in found)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "  \n "), (2, None), (3, "one\r\ntwo\rthree")], "doc_id long, text string")
    rows = chunk(docs, most=6, overlap=0).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {3}
    assert [r["start_line"] for r in rows][0] == 1 and rows[-1]["end_line"] == 3


def test_positions(spark):
    assert Lines("a\r\nb\rc\n").starts == [0, 3, 5, 7]
    row = spark.createDataFrame([("a\r\nb\rc😀",)], "t string").select(utf16_length(F.col("t")), *(line_of(F.col("t"), F.lit(i)) for i in (0, 1, 2, 3, 5))).first()
    assert list(row) == [8, 1, 1, 1, 2, 3]


def test_identity(spark):
    import hashlib

    parts = ["document", "1", "s", "päth", "r"]
    expected = "document_" + hashlib.sha256(b"".join(len(p.encode()).to_bytes(4, "big") + p.encode() for p in parts)).hexdigest()
    assert spark.range(1).select(identity.document_id(F.lit("s"), F.lit("päth"), F.lit("r"))).first()[0] == expected
    with pytest.raises(ValueError):
        identity.identity("Bad", F.lit(""))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vectors.score(F.col("a"), F.col("b"), "cosine"), vectors.score(F.col("a"), F.col("a"), "euclidean")).first()[:] == (0.0, 0.0)
    assert df.select(vectors.valid(F.col("a"), 2), vectors.valid(F.col("a"), 3)).first()[:] == (True, False)
    with pytest.raises(ValueError):
        vectors.score(F.col("a"), F.col("b"), "manhattan")


@pytest.mark.parametrize("data, kind", [(b"\x89PNG\r\n\x1a\n", "binary"), (b"a\x00b", "binary"), (b"", "text"), (b"\xff\xfe", "unknown"), ("Привет".encode(), "text"), (b"\x01" * 5 + b"abc", "binary"), (b"\x01" + b"a" * 9, "unknown"), (b"a" * 65535 + "é".encode(), "text")])
def test_content(spark, data, kind):
    assert spark.createDataFrame([(bytearray(data),)], "d binary").select(C.classify_content(F.col("d"))["kind"]).first()[0] == kind


def test_language_traits_and_decoding(spark):
    rows = [("bin/run", "#!/usr/bin/env python3\nx"), ("a/Makefile", ""), ("x.d.ts", "x"), ("src/a.test.js", "y"), (".env", "z"), ("noext", "q"), ("README.md", "do not edit")]
    got = spark.createDataFrame(rows, "p string, t string").select(C.classify_language(F.col("p"), F.col("t"))["language"], F.array_join(C.classify_traits(F.col("p"), F.octet_length("t"), F.col("t")), ",")).collect()
    assert [tuple(r) for r in got] == [("python", ""), ("make", "empty"), ("typescript", "declaration"), ("javascript", "test"), (None, "configuration"), (None, ""), ("markdown", "generated,documentation")]
    bad = spark.createDataFrame([(bytearray(b"\xcf\xf0\xe8\xe2\xe5\xf2\x98"),), (bytearray(b"\xef\xbb\xbfok"),)], "d binary")
    assert [r[0] for r in bad.select(C.decode(F.col("d"), "cp1251")["text"]).collect()] == ["Привет\x98", "ok"]
    assert [r[0] for r in bad.select(C.decode(F.col("d"))["text"]).collect()] == [None, "ok"]
    assert spark.range(1).select(C.media_type(F.lit("a/b.PY")), C.media_type(F.lit("a"))).first()[:] == ("text/x-python", "application/octet-stream")


def test_policies(spark):
    rows = [("binary", 5, "python", [], True), ("text", 0, "python", [], True), ("text", 5, None, [], True), ("text", 5, "python", ["test", "minified", "generated"], True), ("text", 99, "python", [], True), ("text", 5, "go", [], False), ("text", 5, "python", ["test"], True)]
    df = spark.createDataFrame(rows, "kind string, size int, language string, traits array<string>, parses boolean")
    c = policy.code_only(*(F.col(x) for x in df.columns), limit=50)
    assert [(r[0]["action"], r[0]["reason"], r[0]["trait"]) for r in df.select(c).collect()] == [("skip", "binary-content", None), ("skip", "empty-file", None), ("skip", "plain-text", None), ("skip", "excluded-trait", "generated"), ("skip", "file-too-large", None), ("skip", "cast-parser-unavailable", None), ("index", None, None)]
    t = policy.text_and_code(F.col("kind"), F.col("size"), F.col("traits"), F.col("parses"))
    assert [r[0]["strategy"] for r in df.select(t).collect()] == [None, None, "cast", "cast", "cast", "sliding-window", "cast"]


def test_filters(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), (None, None)], "path string, tags array<string>")
    ask = lambda *c: [r[0] for r in df.select(matches(df.schema, list(c))).collect()]
    assert ask() == [True, True] and ask(Condition("tags", "equals", ("y",))) == [True, False]
    assert ask(Condition("path", "equals", ("a", "b"))) == [False, False] and ask(Condition("path", "in", ("a", 1))) == [True, False]
    assert ask(Condition("language", "equals", ("x",))) == [False, False] and ask(Condition("path", "equals", (1,))) == [False, False]
    for bad in (Condition("nope", "in", ("a",)), Condition("path", "like", ("a",)), Condition("path", "in", ()), Condition("path", "in", (float("nan"),))):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(ValueError):
        search.limits(0)
    assert search.limits(30) == (30, 100)


def test_rerank(spark):
    hits = spark.createDataFrame([("first", 0.9, 0.1), ("second", 0.8, 0.8), ("third", 0.7, 0.9)], "path string, score double, s double")
    good = search.rerank_or_keep(hits, lambda h: h.withColumn("new_score", F.col("s")), 2, ["path"])
    assert [(r["path"], r["score"], r["semantic_score"]) for r in good.collect()] == [("third", 0.9, 0.7), ("second", 0.8, 0.8)]
    broken = lambda h: h.withColumn("new_score", F.lit(float("nan")))
    assert [r["path"] for r in search.rerank_or_keep(hits, broken, 2, ["path"], "use-semantic-order").collect()] == ["first", "second"]
    with pytest.raises(ValueError):
        search.rerank_or_keep(hits, broken, 2, ["path"])


def test_ranges_and_batches(spark):
    r = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 6, 7), (1, 2, 9), (2, 5, 5)], "g int, a int, b int")
    assert sorted(tuple(x) for x in relations.merge_ranges(r, "g", "a", "b").collect()) == [(1, 1, 9, 4), (2, 5, 5, 1)]
    rows = spark.createDataFrame([(1, i, 4) for i in range(5)], "g int, i int, size int")
    assert [x["batch"] for x in relations.greedy_batches(rows, "g", ["i"], "size", 2, 100).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(Exception, match="larger than a batch"):
        relations.greedy_batches(rows, "g", ["i"], "size", 2, 3).collect()
    sizes = [(g, i, (i * 7919) % 50 if i % 11 else None, "x") for g in (1, 2, None) for i in range(3000)]
    want = {}
    for g in (1, 2, None):
        batch, n, total = 0, 0, 0
        for _, i, s, _ in (x for x in sizes if x[0] == g):
            if n >= 16 or total + (s or 0) > 128:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + (s or 0)
            want[g, i] = batch
    long = relations.greedy_batches(spark.createDataFrame(sizes, "g int, i int, size int, given string"), "g", ["i"], "size", 16, 128)
    assert {(x["g"], x["i"]): x["batch"] for x in long.collect()} == want and long.columns == ["g", "i", "size", "given", "batch"]


def test_scope_of_a_request(spark):
    from millrace.operators.retrieval import scoped

    rows = spark.createDataFrame([(1, "s", ["a", "b"]), (2, "s", None), (3, "t", ["b"]), (4, None, ["a"])], "n int, sourceId string, tags array<string>")
    sources = spark.createDataFrame([("s",), ("t",), ("empty",), (None,)], "sourceId string")
    found = lambda *scope: sorted(r["n"] for r in scoped(rows, sources, *scope).collect())
    assert found() == [1, 2, 3, 4] and found([]) == [] and found(["s"], []) == [] and found(None, ["a", "a"]) == [1, 4]
    assert found(["s", "s"]) == [1, 2] and found(["s", "t"], ["b"]) == [1, 3] and found(["empty"]) == [] and found(None, ["z"]) == []
    with pytest.raises(LookupError, match="unknown sources: u, v"):
        found(["v", "s", "u"])


def test_discovery(spark, tmp_path):
    for name in ("a.py", ".hidden/x.py", "build/y.py", "keep/build.py", "big.txt", ".git/config"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * (50 if name == "big.txt" else 3))
    files = read_folder(spark, str(tmp_path))
    found = {r["path"]: r["reason"] for r in discover(files, gitignore=["build/", "!keep"], limit=20).collect()}
    assert found["a.py"] is None and found["build/y.py"] == "ignored" and found["keep/build.py"] is None and found["big.txt"] == "file-too-large"
    assert snapshot(files.where("path = 'a.py'")).first()["bytes"] == 3
    import re

    assert re.fullmatch(glob_regex("**/*.{ts,js}"), "a/b/c.js") and not re.fullmatch(glob_regex("*.js"), "a/c.js")
    one = files.where("path = 'a.py'").select("path", "content")
    with pytest.raises(Exception, match="two sources have"):
        union_sources([one, one]).collect()


def test_store(spark, tmp_path):
    store = BuildStore(spark, f"file://{tmp_path}/store")
    model = {"provider": "fixture", "dimensions": 3}
    docs = spark.createDataFrame([("d1", "src/example.ts"), ("d2", "src/duplicate.ts")], "document_id string, path string")
    chunks = spark.createDataFrame([("d1", "c", 0, "e"), ("d2", "c", 0, "e")], "document_id string, chunk_id string, chunk_index int, embedding_id string")
    vectors_ = spark.createDataFrame([("e", [1.0, 0.0, 0.0])], "embedding_id string, vector array<float>")
    for build in ("b1", "b2"):
        assert store.begin(build, model, "2024-01-01")
        store.put(build, docs, chunks, vectors_)
        assert store.searchable(build).count() == 0
        store.set_status(build, "ready", "2024-01-02")
        assert store.searchable(build, model).count() == 2
    assert not store.begin("b1", model, "x")
    with pytest.raises(ValueError):
        store.set_status("b1", "failed")
    with pytest.raises(ValueError):
        store.searchable("b1", {"provider": "other"})
    assert store.missing(spark.createDataFrame([("e", "x"), ("f", "y"), ("f", "y")], "embedding_id string, text string")).count() == 1
    assert [r["chunk_id"] for r in store.document_chunks("b1", "src/example.ts").collect()] == ["c"]
    assert store.delete("b1") == {"documents": 2, "memberships": 2, "chunks": 0, "embeddings": 0}
    assert store.searchable("b2").count() == 2
    assert store.delete("b2") == {"documents": 2, "memberships": 2, "chunks": 2, "embeddings": 1}
    assert store.builds() == {}


def test_watch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "path string, content string, modified_at int")
    built = []
    for _ in range(2):  # the same files again change nothing
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watch(spark, str(tmp_path / "in"), "path string, content string, modified_at int", str(tmp_path / "cp"), lambda f, n: built.append([tuple(r) for r in f.collect()])).awaitTermination()
    assert built[0] == [("a", "2")]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_batches_of_queries_are_served_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<double>")
    asked = rows.select(F.col("id").alias("q"), F.col("v").alias("query"))
    whole, blocks = (sorted(map(tuple, search.top_k_batch(rows, asked, "v", "id", "q", 3, "dot-product", most=n).select("q", "id", "rank", "score").collect())) for n in (4096, 7))
    assert len(whole) == 180 and blocks == whole
    assert search.top_k_batch(rows, asked.where("false"), "v", "id", "q").count() == 0
