"""The Merkle manifest, the Jaccard join and the name join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import merkle, name_join, queries, token_groups
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- op11


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes, arity):
    """The root of nodes and each one's path, (before, after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity : i // arity * arity + arity]
            paths[k].append((run[: i % arity], run[i % arity + 1 :]))
            at[k] = i // arity
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def manifest_of(rows, arity=16):
    trees = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        trees[row[1]].append(row)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: tree_of([leaf_of(r) for r in trees[k]], arity) for k in names}
    root, above = tree_of([built[k][0] for k in names], arity) if names else (None, [])
    out = []
    for name, upper in zip(names, above):
        for row, lower_path in zip(trees[name], built[name][1]):
            leaf, path = leaf_of(row), lower_path + upper
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                folded = leaf_of((*row[:4], lower(row[4])))
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((row[0], leaf, built[name][0], root, h(*(x for a, b in path for x in a + b)), folded, folded == root))
    return sorted(out, key=str)


def docs_of(spark, sf_dir, columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns).collect()]


def test_manifest_is_the_plain_tree(spark):
    got = sorted((tuple(r) for r in queries.op11_merkle(spark, DATA).collect()), key=str)
    assert got == manifest_of(docs_of(spark, DATA, LEAF))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_odd_rows(spark, tmp_path):
    """Null keys and groups, repeated rows, lone leaves, a group of one more than a full tree, a long text, columns called as the new ones are."""
    rows = [(1, None, None, None, None), (None, "s", "en", 3, "Abc"), (None, "s", "en", 3, "Abc"), (7, "", "en", 1, "x"), (8, "é", "fr", 2, "É" * 70_000), (9, "z", None, 0, "")]
    rows += [(i, "big", "en", i, f"Text {i}") for i in range(257)] + [(i, f"t{i}", "en", i, "One") for i in range(20)]
    shaped = [(r[0], r[4], r[2], r[1], r[3]) for r in rows]
    spark.createDataFrame(shaped, DOCS).withColumn("leaf", F.lit("x")).withColumn("ROOT", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("path", F.lit(3)).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()), key=str) == manifest_of(rows)
    whole = merkle.manifest(spark.read.parquet(f"{tmp_path}/documents.parquet"), LEAF, "doc_id", "source")
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "leaf", "ROOT", "tree", "path", "leaf_", "subroot", "root_", "path_"]
    assert {r.leaf for r in whole.collect()} == {"x"} and whole.count() == len(rows)


@pytest.mark.parametrize("arity", [2, 3])
def test_fragments_merge_in_any_order(arity):
    nodes = [h(str(i)) for i in range(23)]
    want = tree_of(nodes, arity)[0]
    r = random.Random(arity)
    for _ in range(20):
        r.shuffle(order := list(range(23)))
        parts = [merkle.Forest(arity) for _ in range(4)]
        for i in order:
            list(parts[i % 4].add("t", 23, 0, i, nodes[i]))
        tops = []
        whole = parts[0]
        for other in parts[1:]:
            for tree, leaves, level, index, own in other.nodes():
                tops += whole.add(tree, leaves, level, index, own)
        assert not whole.open and tops[-1][-1] == want


def test_borders_are_all_that_moves(spark):
    """Of n ordered leaves in p partitions, no more stay unresolved than a few a partition and level."""
    rows = spark.range(20_000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    ranked = merkle.cut(merkle.placed(rows.repartition(8), ["id"]))
    assert [r["index"] for r in ranked.orderBy("id").collect()] == list(range(20_000))
    first = ranked.select(F.col("part").alias("fragment"), "tree", "leaves", F.lit(0).alias("level"), "index", "hash")
    found = first.sortWithinPartitions("fragment", "tree", "index").mapInArrow(merkle._resolving(16), merkle._FOUND)
    assert found.where("children is null").count() <= 8 * 2 * 15 * 4
    assert merkle.resolve(ranked).orderBy(F.desc("level")).first().parent == tree_of([r.hash for r in rows.orderBy("id").collect()], 16)[0]


# --- op12


def components_of(rows, width, percent):
    sets = []
    for i, text in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", lower(text or "").encode()) if w]
        sets.append((i, {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for k, (_, own) in enumerate(sets):
        shared = Counter(j for g in own for j in held[g])
        for g in own:
            held[g].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j][1]) - n):
                up[max(top(k), top(j))] = min(top(k), top(j))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(own), least.get(top(k))) for k, (i, own) in enumerate(sets)), key=str)


def test_jaccard_components_are_the_plain_ones(spark):
    got = sorted((tuple(r) for r in queries.op12_jaccard_join(spark, DATA).collect()), key=str)
    assert got == components_of(docs_of(spark, DATA, ["doc_id", "text"]), 4, 85)


def test_groups_and_buckets_decide_nothing(spark, monkeypatch):
    """Crowds at and around the threshold, chains, shared passages and short texts, with groups, buckets and common tokens of few."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = ["", " ", "one", "one two three", "One  two\tthree", "one two three four", "one two three four five"]
    for size, edits in ((60, 1), (60, 2), (60, 3), (120, 3), (120, 5), (20, 1)):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(14):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(size)] = r.choice(words)
            texts.append(" ".join(own))
    passage = [r.choice(words) for _ in range(60)]
    texts += [" ".join(passage + [r.choice(words) for _ in range(r.randint(0, 40))]) for _ in range(30)]
    chain = [r.choice(words) for _ in range(150)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 80, 2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[10]), (3, texts[20]), (3, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = components_of(rows, 4, 85)
    for group, queries_, bucket, common, local in ((3, 2, 50, 1 << 17, 4), (2, 3, 300, 64, 2), (1, 100, 10_000, 1 << 30, 1)):
        for name, value in (("GROUP", group), ("QUERIES", queries_), ("BUCKET", bucket), ("COMMON", common), ("LOCAL", local)):
            monkeypatch.setattr(token_groups, name, value)
        assert sorted((tuple(x) for x in token_groups.jaccard_components(docs).collect()), key=str) == want


def test_components_without_known_relatives(spark, monkeypatch):
    """With no minima to form groups or links, the matrix alone finds everything."""
    monkeypatch.setattr(token_groups, "MARGIN", -1)
    got = sorted((tuple(r) for r in queries.op12_jaccard_join(spark, DATA).collect()), key=str)
    assert got == components_of(docs_of(spark, DATA, ["doc_id", "text"]), 4, 85)


# --- op13


def apart(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def name_links(clients, vendors):
    out = defaultdict(list)
    spelt = defaultdict(list)
    for c, name in clients:
        if name:
            spelt[lower(name)].append(c)
    for v, name in vendors:
        key = zlib.crc32(str(v).encode()) if v is not None else 1
        if name and key % 2 == 0 and len(name) > 1:
            p = key % (len(name) - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        if name:
            for other, ids in spelt.items():
                if abs(len(other) - len(name)) < 3 and (far := apart(other, lower(name))) <= 2:
                    out[v, far] += ids
    return sorted(((v, far, len(ids), min((i for i in ids if i is not None), default=None), sum(zlib.crc32(str(i).encode()) for i in ids if i is not None)) for (v, far), ids in out.items()), key=str)


def test_name_join_is_the_plain_one(spark):
    clients = [tuple(r) for r in spark.read.parquet(f"{DATA}/clients.parquet").select("client_id", "name").collect()]
    vendors = [tuple(r) for r in spark.read.parquet(f"{DATA}/vendors.parquet").select("vendor_id", "name").collect()]
    got = sorted((tuple(r) for r in queries.op13_name_join(spark, DATA).collect()), key=str)
    assert got == name_links(clients, vendors) and got


def test_name_join_of_odd_rows(spark, tmp_path):
    """Nulls, empty names, repeated rows and ids, very long and very short names, characters beyond the basic plane, clashing columns."""
    long = "ab" * 40_000
    clients = [(1, "Anna"), (1, "Anna"), (2, None), (3, ""), (None, "ANNA"), (4, "annna"), (5, long), (6, "😀é"), (7, "a"), (8, "É" * 14), (9, "é" * 14), (10, "a" * 90), (11, "abcdefghijk"), (None, "zzzzzzzzzzzzzz")]
    vendors = [(20, "Anna"), (20, "Anna"), (21, "naan"), (None, "anna"), (22, None), (23, ""), (24, long[:-1] + "x"), (25, "é😀"), (26, "b"), (27, "É" * 13), (28, "a" * 91), (29, "abcdefghij"), (31, "zzzzzzzzzzzzzx")]
    spark.createDataFrame(clients, "client_id long, name string").withColumn("distance", F.lit(1)).withColumn("left", F.lit("x")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(vendors, "vendor_id long, name string").withColumn("right", F.lit("x")).withColumn("times", F.lit(1)).write.parquet(f"{tmp_path}/vendors.parquet")
    got = sorted((tuple(r) for r in queries.op13_name_join(spark, str(tmp_path)).collect()), key=str)
    small = [(i, n) for i, n in clients if n != long], [(i, n) for i, n in vendors if n != long[:-1] + "x"]
    assert [r for r in got if r[0] != 24] == name_links(*small)
    assert [r[1:3] for r in got if r[0] == 24] == [(1 if zlib.crc32(b"24") % 2 else 2, 1)]


def test_names_of_few_letters_and_small_blocks(spark, monkeypatch):
    r = random.Random(4)
    ours = ["".join(r.choice("abcö") for _ in range(r.choice([1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 16, 20, 30, 90]))) for _ in range(200)] + ["a" * 69, "a" * 72, "a" * 11, "ba" * 20]
    theirs = ["a" * 70, "a" * 71, "ab" * 20]
    for _ in range(200):
        name = list(r.choice(ours))
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(name) + 1)
            kind = r.randrange(4)
            if kind == 0:
                name.insert(p, r.choice("abcö"))
            elif kind == 1:
                del name[p : p + 1]
            elif kind == 2:
                name[p : p + 1] = [r.choice("abcö")]
            elif p + 1 < len(name):
                name[p], name[p + 1] = name[p + 1], name[p]
        theirs.append("".join(name))
    want = {(a, b, apart(a, b)) for a in set(ours) - {""} for b in set(theirs) - {""} if abs(len(a) - len(b)) < 3 and apart(a, b) <= 2}
    left, right = (spark.createDataFrame([(x,) for x in side], "name string") for side in (ours, theirs))
    for block, pairs in ((1024, 1 << 20), (3, 64)):
        monkeypatch.setattr(name_join, "BLOCK", block)
        monkeypatch.setattr(name_join, "PAIRS", pairs)
        assert sorted(map(tuple, name_join.near_names(left, right).collect())) == sorted(want)


# --- all


@pytest.mark.parametrize("name", ["op11_merkle", "op12_jaccard_join", "op13_name_join"])
def test_empty_tables(spark, tmp_path, name):
    for table, columns in (("documents", DOCS), ("clients", "client_id long, name string"), ("vendors", "vendor_id long, name string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []
