"""Values, not only counts, for odd rows, and other columns whose names clash with those that the operators use, on every table."""

from collections import defaultdict

import duckdb
import pytest

from millrace.llm import queries
from pyspark.sql import functions as F

CLASHES = {
    "documents": ["node", "keys", "token", "leaf", "TREE", "group", "length", "sequence_id"],
    "conversations": ["tree", "formatted", "N_TURNS", "loss", "id", "parent", "score"],
    "embeddings": ["query_id", "RANK", "score", "block", "shard", "v"],
    "pages": ["text", "N_CHARS", "host", "subtree", "templates", "key"],
    "clients": ["vendor_id", "distance", "left", "n", "LEAST"],
    "vendors": ["client_id", "right", "times", "crc", "name_"],
}
ROWS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 4), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (6, "word " * 3000, "en", "s", 1), (7, "éàü 日本 😀 <|endoftext|>", "fr", None, 3), (100, "alpha beta gamma delta epsilon", "en", "s", 3)]),
    "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, None, None), (1, 1, "assistant", "x<|im_end|>\\"), (2, 0, "user", ""), (2, 1, "assistant", "a\nb"), (3, 0, "assistant", "long " * 5000)]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(0, [0.5, 0.25], 1), (100, None, 2), (200, [float("nan"), 1.0], 1), (300, [1.0], 1), (1, [0.5, None], 1), (2, [0.5, 0.25], 1), (400, [0.0, -0.3], 1), (5, [0.5, 0.25], 1), (7, [], 1)]),
    "pages": ("page_id long, url string, html string", [(1, None, None), (2, "http://h/x", ""), (2, "http://h/x", "<p>a<p>b"), (None, "u", "<article>x</article>" * 3), (5, "http://h/y", "<p>" + "w " * 50_000)]),
    "clients": ("client_id long, name string", [(1, "Anna Berg"), (1, "Anna Berg"), (2, None), (None, "anna brg"), (3, "")]),
    "vendors": ("vendor_id long, name string", [(1, "Anna Berg"), (2, None), (3, ""), (None, "Anna Berg")]),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    plain, clashing = tmp_path_factory.mktemp("plain"), tmp_path_factory.mktemp("clashing")
    for table, (kind, rows) in ROWS.items():
        df = spark.createDataFrame(rows, kind)
        df.write.parquet(f"{plain}/{table}.parquet")
        df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHES[table]))).write.parquet(f"{clashing}/{table}.parquet")
    return str(plain), str(clashing)


@pytest.mark.parametrize("name", ["op2_chat_format", "op3_main_text", "op4_topk", "op5_packing", "op11_merkle", "op12_jaccard_join", "op13_name_join"])
def test_clashing_columns_change_nothing(spark, folders, name):
    one, other = (sorted(map(repr, map(tuple, queries.queries()[name](spark, d).collect()))) for d in folders)
    assert one == other and one


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_topk"])
def test_odd_rows_as_in_sql(spark, folders, name):
    db = duckdb.connect()
    for table in ("conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folders[1]}/{table}.parquet/*.parquet'")
    found = queries.queries()[name](spark, folders[1])
    columns = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want)) and want


def test_packed_pieces_are_whole(spark, folders):
    rows = queries.op5_packing(spark, folders[1]).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d for d, _ in by} == {1, 2, 3, 4, 6, 7, 100}
    for (doc, tokens), pieces in by.items():
        at = 0
        copies = 2 if doc == 4 else 1
        for start, length in sorted(pieces)[::copies]:
            assert start == at and length > 0
            at += length
        assert at == tokens
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_odd_pages(spark, folders):
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in queries.op3_main_text(spark, folders[1]).collect()), key=str)
    long = " ".join(["w"] * 50_000)
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "a\nb", 3), (None, "x\nx\nx", 5), (5, long, len(long))], key=str)
