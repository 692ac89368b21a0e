"""Live trees, the store under several writers and deletes, reuse over all builds, joins and unions of ranges, and ordered digests."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from millrace.operators import build, documentation, relations, search
from millrace.operators.digest import ordered_digests
from millrace.operators.store import BuildStore
from millrace.operators.versions import Versions
from millrace.streaming.snapshot import NOTHING, LiveSnapshot
from pyspark.sql import functions as F

MODEL = {"model": "m", "metric": "cosine"}
CHANGES = "path string, content string, modified_at long, nth long, deleted boolean"


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def membership(files):
    return sha("\n".join(f"{p}\0{sha(c)}" for p, c in sorted(files.items()))) if files else NOTHING


def test_live_tree(spark, tmp_path):
    tree = LiveSnapshot(spark, f"file://{tmp_path}/live", buckets=4)
    put = lambda batch, *rows: tree.apply(spark.createDataFrame(rows, CHANGES), batch)
    held = lambda: {r["path"]: r["content"] for r in tree.files().collect()}
    assert tree.state().fingerprint == NOTHING and held() == {}
    one = put(0, ("a", "1", 10, 0, False), ("a", "2", 20, 0, False), ("b", "x", 10, 0, False), (None, "y", 1, 0, False))
    assert held() == {"a": "2", "b": "x"} and one.fingerprint == membership(held()) and one.files == 2 and one.changes == {"added": 2, "changed": 0, "removed": 0}
    assert put(0, ("a", "9", 99, 0, False)) == one and held() == {"a": "2", "b": "x"}  # the same batch again
    two = put(1, ("b", None, 30, 0, True), ("a", "old", 15, 0, False), ("c", "z", 5, 0, False))
    assert held() == {"a": "2", "c": "z"} and two.changes == {"added": 1, "changed": 0, "removed": 1}
    assert {tuple(r) for r in tree.difference().collect()} == {("b", "removed"), ("c", "added")}
    three = put(2, ("b", "late", 20, 0, False))  # older than the deletion
    assert held() == {"a": "2", "c": "z"} and not three.changed and three.fingerprint == two.fingerprint
    put(3, ("b", "new", 30, 1, False))  # as old, but a later change
    assert held() == {"a": "2", "b": "new", "c": "z"}
    listing = spark.createDataFrame([("a", "2"), ("d", "w")], "path string, content string")
    now = tree.reconcile(listing)
    assert held() == {"a": "2", "d": "w"} and now.changes == {"added": 1, "changed": 0, "removed": 2} and now.fingerprint == membership(held())
    assert not tree.reconcile(listing).changed
    gone = tree.reconcile(listing.where("false"))
    assert held() == {} and gone.fingerprint == NOTHING and gone.files == 0
    assert tree.files(one.revision).count() == 2  # earlier revisions stay as they were
    assert tree.vacuum() == 0


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    tree = LiveSnapshot(spark, f"file://{tmp_path}/live", buckets=32)
    tree.apply(spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("x"), 50).alias("content")), 0)
    before = tree.versions.read()[1]["buckets"]
    tree.apply(spark.createDataFrame([("p1", "y")], "path string, content string"), 1)
    after = tree.versions.read()[1]["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and tree.state().files == 2000
    assert tree.state().changes == {"added": 0, "changed": 1, "removed": 0}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v")
    add = lambda who: [versions.change(lambda s: s | {"n": s.get("n", 0) + 1, who: s.get(who, 0) + 1}) for _ in range(8)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, "abc"))
    assert versions.read()[1] == {"n": 24, "a": 8, "b": 8, "c": 8}
    assert not versions.create(versions.read()[0], {}) and len(versions.numbers()) <= versions.keep
    stores = [BuildStore(spark, f"file://{tmp_path}/store") for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: [stores[k].begin(f"b{k}-{n}", MODEL, "2026-01-01") for n in range(6)], range(2)))
    assert set(stores[0].builds()) == {f"b{k}-{n}" for k in range(2) for n in range(6)}


def test_deletes_write_tombstones(spark, tmp_path):
    store = BuildStore(spark, f"file://{tmp_path}/store")

    def add(name, ids):
        rows = spark.createDataFrame([(f"d{i}", f"c{i}", f"e{i}", [float(i)]) for i in ids], "document_id string, chunk_id string, embedding_id string, vector array<float>")
        store.begin(name, MODEL, "2026-01-01")
        store.put(name, rows.select("document_id"), rows.drop("vector"), rows.select("embedding_id", "vector"))
        store.set_status(name, "ready")

    size = lambda: sum(p.stat().st_size for p in (tmp_path / "store").glob("embeddings*/**/*.parquet"))
    add("a", range(2000))
    add("b", range(1990, 2010))
    before = size()
    assert store.delete("b") == {"documents": 20, "memberships": 20, "chunks": 10, "embeddings": 10}
    assert size() == before and store.table("embeddings").count() == 2000
    wanted = spark.createDataFrame([("e5", ""), ("e2005", "")], "embedding_id string, text string")
    assert [r["embedding_id"] for r in store.missing(wanted).collect()] == ["e2005"]
    add("c", [2005])  # a hidden vector is written anew, and seen
    assert store.searchable("c").count() == 1 and store.table("embeddings").count() == 2001
    assert store.compact() == 1 and store.table("embeddings").count() == 2001 and store.compact() == 0
    assert store.delete("a")["embeddings"] == 2000 and store.table("embeddings").count() == 1 and store.searchable("c").count() == 1
    with pytest.raises(ValueError):
        store.delete("a")


def put_ids(spark, store, name, ids, model=MODEL, **more):
    rows = spark.createDataFrame([(f"d{i}", f"c{i}", f"e{i}", [float(i)]) for i in ids], "document_id string, chunk_id string, embedding_id string, vector array<float>")
    store.begin(name, model, "2026-01-01")
    store.put(name, rows.select("document_id"), rows.drop("vector"), rows.select("embedding_id", "vector", *(F.lit(v).alias(k) for k, v in more.items())))
    store.set_status(name, "ready")


def test_only_buckets_that_may_hold_an_id_are_read(spark, tmp_path):
    """A put of 1 % new ids, and a lookup of them, read no vector's file: all of those are spoilt, and it goes on; of ids that are there, their buckets' files are read."""
    store = BuildStore(spark, f"file://{tmp_path}/store", buckets=16)
    put_ids(spark, store, "a", range(5000))
    wanted = lambda *names: spark.createDataFrame([(n, "") for n in names], "embedding_id string, text string")
    assert store.possible(wanted(*(f"e{i}" for i in range(5000, 5050)))) == [] and store.possible(wanted("e7", None)) and len(store.possible(wanted("e7", "x"))) == 1
    _, bucket = store.possible(wanted("e7"))[0]
    assert [tuple(r) for r in store.held(wanted("e7", "x")).collect()] == [("e7", "", [7.0])]
    data = {p: p.read_bytes() for p in (tmp_path / "store" / "embeddings").glob("**/*.parquet")}
    filters = sum(p.stat().st_size for p in (tmp_path / "store" / "filters").glob("**/*.parquet"))
    assert filters < 5000 * 5 and {p.parent.name for p in data} == {f"bucket={k}" for k in range(16)}
    for path in data:
        if path.parent.name != f"bucket={bucket}":
            path.write_bytes(b"spoilt")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    put_ids(spark, store, "b", range(5000, 5050))
    assert [r["embedding_id"] for r in store.missing(wanted("e7", "e5001", "new")).collect()] == ["new"]
    for path, held in data.items():
        path.write_bytes(held)
    assert store.table("embeddings").count() == 5050 and store.searchable("b").count() == 50


def test_ids_are_held_once_under_writers_at_the_same_time(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: put_ids(spark, BuildStore(spark, root, buckets=4), f"b{k}", range(10 * k, 10 * k + 40)), range(3)))
    store = BuildStore(spark, root)
    held = [r["embedding_id"] for r in store.table("embeddings").collect()]
    assert sorted(held) == sorted(f"e{i}" for i in range(60)) and all(store.searchable(f"b{k}").count() == 40 for k in range(3))
    put_ids(spark, store, "again", range(60))  # nothing new: no part
    parts = store.manifest.read()[1]["parts"]
    assert len(parts) <= 3 and {p.name for p in (tmp_path / "store" / "embeddings").iterdir()} == {f"part={p}" for p in parts}
    assert store.compact(buckets=8) == 0 and store.table("embeddings").count() == 60 and len(store.manifest.read()[1]["parts"]) == 1
    assert store.missing(store.table("embeddings").select("embedding_id")).count() == 0 and store.compact() == 0


def test_held_vectors_must_be_of_the_input_and_model(spark, tmp_path):
    store = BuildStore(spark, f"file://{tmp_path}/store")
    wanted = spark.createDataFrame([("e1", "text"), ("e9", "other")], "embedding_id string, text string")
    assert store.missing(wanted).count() == 2 and store.held(wanted).count() == 0  # an empty store
    put_ids(spark, store, "a", [1], input_hash=sha("text"))
    assert [r["embedding_id"] for r in store.missing(wanted, MODEL).collect()] == ["e9"]
    for ids, model in ((wanted.withColumn("text", F.lit("changed")), MODEL), (wanted, MODEL | {"model": "n"})):
        with pytest.raises(Exception, match="another input or model"):
            store.missing(ids, model).collect()
        with pytest.raises(Exception, match="another input or model"):
            store.held(ids, model).collect()
    with pytest.raises(ValueError, match="vectors are"):
        store.begin("b", MODEL, "2026-01-01")
        rows = spark.createDataFrame([("d", "c", "e", [1.0])], "document_id string, chunk_id string, embedding_id string, vector array<double>")
        store.put("b", rows.select("document_id"), rows.drop("vector"), rows.select("embedding_id", "vector"))


def test_reuse_looks_at_all_builds(spark, tmp_path):
    store, plan = BuildStore(spark, f"file://{tmp_path}/store"), build.Plan(strategies=("sliding-window",))
    files = {"a": "alpha text", "b": "beta text"}

    def index(name, paths, at, **more):
        rows = spark.createDataFrame([(f"{p}.txt", bytearray(files[p].encode())) for p in paths], "path string, content binary")
        return build.index(store, rows, plan, more.get("model", MODEL), lambda rows: rows.withColumn("vector", F.array(F.lit(1.0).cast("float"))), name, at, at, "repo")

    index("1", "ab", "2026-01-01")
    second = index("2", "a", "2026-01-02")
    third = index("3", "ab", "2026-01-03")
    assert third.counters["reused_documents"] == 2 and third.counters["reused_chunks"] == 2 and third.counters["generated_embeddings"] == 0
    told = {r["path"]: r["reused_from"] for r in store.table("documents").where(F.col("build_id") == third.build).collect()}
    assert told["a.txt"] == second.build and told["b.txt"] not in (second.build, None)


def test_smallest_container_of_any_ranges(spark):
    r = random.Random(2)
    symbols = [(r.choice("de"), f"s{i}", a := r.randrange(0, 3000), a + r.choice([0, 1, 5, 64, 700, 2500])) for i in range(300)]
    parts = [(r.choice("def"), i, a := r.randrange(0, 3500), a + r.randrange(0, 60)) for i in range(400)] + [("d", 401, None, None)]
    got = relations.smallest_container(spark.createDataFrame(parts, "doc string, n int, start int, end int"), spark.createDataFrame(symbols, "doc string, name string, start int, end int"), "doc", ["n"])
    want = {(d, n): min(((e - s, s, name) for x, name, s, e in symbols if a is not None and x == d and s <= a and e >= b), default=(0, 0, None))[2] for d, n, a, b in parts}
    assert {(x["doc"], x["n"]): x["container"] for x in got.collect()} == want


def test_many_ranges_around_each_other_make_no_pairs(spark):
    """30,000 parts in 30,000 symbols that hold each other: the plan has no join by ranges, and its rows are few for each."""
    n = 30_000
    doc = F.when(F.col("id") >= 0, "d").otherwise("e").alias("doc")  # no constant, which would take the equality out of the plan
    symbols = spark.range(n).select(doc, F.col("id").cast("string").alias("name"), F.col("id").alias("start"), (F.lit(3 * n) - F.col("id")).alias("end"))
    parts = spark.range(n).select(doc, F.col("id").alias("n"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    found = relations.smallest_container(parts, symbols, "doc", ["n"])
    assert found.where("cast(n as string) <> container").count() == 0 and found.where("container is null").count() == 0
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_overlapping_pairs_come_once(spark):
    r = random.Random(3)
    rows = lambda k: [(r.choice("de"), i, a := r.randrange(500), a + r.choice([0, 1, 7, 90])) for i in range(k)]
    left, right = rows(120), rows(90)
    kind = "doc string, id int, start int, end int"
    got = [tuple(x) for x in relations.overlapping(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), "doc").collect()]
    assert sorted(got) == sorted((d, i, j) for d, i, a, b in left for e, j, s, t in right if d == e and a < b and s < t and s < b and t > a)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_merged_ranges_of_a_large_group(spark, parts):
    r = random.Random(parts)
    rows = [(g, a := r.randrange(3000), a + r.randrange(0, 9)) for g in ["hot"] * 600 + ["x", None, "y"] * 10] + [("long", 0, 5000)] + [("long", k, k + 1) for k in range(0, 6000, 50)]
    want = {}
    for g in {x[0] for x in rows}:
        out = []
        for a, b in sorted((a, b) for x, a, b in rows if x == g):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + 1)
            else:
                out.append((a, b, 1))
        want[g] = out
    found = relations.merge_ranges(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b", parts=parts)
    assert sorted(((x["g"], x["a"], x["b"], x["merged"]) for x in found.collect()), key=str) == sorted(((g, *x) for g, out in want.items() for x in out), key=str)


def test_digests(spark):
    rows = [("s", "b", "h1"), ("s", "a", "h2"), ("s", "é", "h3"), (None, "a", "h4"), ("t", None, "h5")]
    df = spark.createDataFrame(rows, "source string, path string, hash string")
    line = lambda *x: sha("\n".join(f"{p}\0{d}" for p, d in sorted(x, key=lambda y: y[0].encode())))
    assert {tuple(r) for r in ordered_digests(df, ["source"]).collect()} == {("s", 3, line(("b", "h1"), ("a", "h2"), ("é", "h3"))), (None, 1, line(("a", "h4")))}
    assert ordered_digests(df.where("source = 's'")).first()["membership_hash"] == line(("b", "h1"), ("a", "h2"), ("é", "h3"))
    assert ordered_digests(df.where("false")).count() == 0


def test_nearest_project_joins_by_equality(spark):
    roots = spark.createDataFrame([("p", "/a"), ("q", "/a/b"), ("r", "/a/b"), ("s", "/ab")], "project string, root string")
    paths = spark.createDataFrame([("/a/x",), ("/a/b",), ("/a/b/c/d",), ("/abc",), ("/z",)], "path string")
    found = documentation.nearest_project(roots, paths)
    assert {tuple(r) for r in found.collect()} == {("/a/x", "p"), ("/a/b", "r"), ("/a/b/c/d", "r"), ("/abc", None), ("/z", None)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_batches_of_queries_meet_rows_in_tiles(spark):
    """One block and many give the same; ties go to the lesser key; vectors of other lengths, nulls and numbers that aren't finite take no part; rows are scanned once."""
    r = random.Random(7)
    vectors = [(i, [r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, float("nan"), 0.0]), (62, [1.0, 2.0]), (63, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("v").alias("query"))
    good = [(i, v) for i, v in vectors if v is not None and all(x == x for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    scores = {
        "dot-product": dot,
        "cosine": lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if dot(a, a) * dot(b, b) else 0.0,
        "euclidean": lambda a, b: -(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5),
    }
    for metric, score in scores.items():
        want = []
        for q, a in good:
            if q % 3 == 0:
                found = sorted((-round(score(a, b), 12), i) for i, b in good if len(a) == len(b))[:4]
                want += [(q, i, n + 1) for n, (_, i) in enumerate(found)]
        for most in (4096, 3):
            got = search.top_k_batch(rows, asked, "v", "id", "q", 4, metric, most=most)
            assert sorted((x["q"], x["id"], x["rank"]) for x in got.collect()) == sorted(want)
    plan = search.top_k_batch(rows.where("id >= 0"), asked, "v", "id", "q", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_containers_of_far_places_and_few_blocks(spark):
    """Places beyond 2^32 have containers, and a row has no more blocks than the number of symbols has bits."""
    far = 1 << 33
    parts = spark.createDataFrame([("d", 1, far, far + 40), ("d", 2, far + 90, far + 130), ("d", 3, 2 * far, 2 * far + 40)], "doc string, n int, start long, end long")
    symbols = spark.createDataFrame([("d", "whole", 0, 2 * far), ("d", "near", far, far + 100), ("d", "late", far + 1, far + 40)], "doc string, name string, start long, end long")
    found = relations.smallest_container(parts, symbols, "doc", ["n"])
    assert {r["n"]: r["container"] for r in found.collect()} == {1: "near", 2: "whole", 3: None}
    blocks = spark.range(1000).select(F.size(relations._blocks(F.col("id"), F.lit(10), 0)).alias("n"), F.size(relations._blocks(F.col("id"), F.lit(10), 1)).alias("m"))
    assert blocks.agg(F.max("n"), F.max("m"), F.min(F.col("n") + F.col("m")), F.max(F.col("n") + F.col("m"))).first() == (10, 9, 10, 10)


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_imports_of_few_and_many_bindings_and_far_ranges(spark, few):
    far = 1 << 33
    parts = spark.createDataFrame([("d", 1, 0, 9, "a b, a"), ("d", 2, far, far + 9, "c"), ("e", 1, 0, 9, "b $x"), ("e", 2, 9, 12, ""), (None, 3, 0, 9, "a")], "doc string, n int, start long, end long, text string")
    imports = spark.createDataFrame([("d", "m", ["a", "a", None], far + 20, far + 30), ("d", "k", ["c", "b"], far + 8, far + 20), ("e", "j", [], 0, 2 * far), ("e", "o", ["$x"], far, far + 1), ("f", "p", ["a"], 0, 9)], "doc string, source string, bindings array<string>, start long, end long")
    found = relations.relevant_imports(parts, imports, "doc", ["n"], few).collect()
    assert sorted((r["doc"] or "", r["n"], r["imports"]) for r in found) == [("", 3, []), ("d", 1, ["k", "m"]), ("d", 2, ["k"]), ("e", 1, ["j", "o"]), ("e", 2, ["j"])]
    many = relations.overlapping(spark.createDataFrame([("d", 1, 0, 10**10), ("d", 2, 5, 5)], "doc string, id int, start long, end long"), spark.range(3000).select(F.lit("d").alias("doc"), "id", (F.col("id") * 10**6).alias("start"), (F.col("id") * 10**6 + 1).alias("end")), "doc")
    assert many.count() == many.distinct().count() == 3000


def test_containers_are_found_in_one_pass_over_each_document(spark):
    """Rows are dealt and sorted once and not multiplied; documents go on over batches; nulls, ranges that end before they start and equal parts are as before."""
    r = random.Random(5)
    end = lambda a: r.choice([None, a - 3, a, a + 1, a + 8, a + 90, a + 400])
    symbols = [(r.choice("de"), r.choice([None, "é", "z", f"s{i}"]), a := r.randrange(300), end(a)) for i in range(300)] + [(None, "none", 0, 900), ("d", "none", None, 900)]
    parts = [(r.choice(["d", "e", "f", None]), i % 390, a := r.randrange(400), end(a)) for i in range(400)] + [("d", 401, None, 5), ("d", 402, None, None)]
    ask = lambda: relations.smallest_container(spark.createDataFrame(parts, "doc string, n int, start int, end int"), spark.createDataFrame(symbols, "doc string, name string, start int, end long"), "doc", ["n"])
    around = lambda d, a, b: [(e - s, s, name is not None, name) for x, name, s, e in symbols if None not in (d, a, b, s, e) and x == d and s <= e and s <= a and e >= b]
    want = [(d, n, a, b, min(around(d, a, b), default=(None,))[-1]) for d, n, a, b in parts]
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert sorted(map(tuple, ask().collect()), key=repr) == sorted(want, key=repr)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(f.name, f.dataType.simpleString()) for f in ask().schema] == [("doc", "string"), ("n", "int"), ("start", "int"), ("end", "int"), ("container", "string")]
    plan = ask()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort ") == 1 and not any(x in plan for x in ("Window", "Join", "Generate"))
