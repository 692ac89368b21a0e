"""Spot signatures: chains of content words after common-word anchors, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import cut

# Common words of the languages served; a lone bar stands between the cells of word lists.
ANCHORS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "fr": "le la les de des du un une et est en que qui pour dans par sur au aux pas ne ce se il elle avec son sa ses ou plus nous vous",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch",
    "es": "el la los las de que y en un una es por con no para su se al lo como más o pero sus le ya este del entre",
}
_WORDS = sorted({w for words in ANCHORS.values() for w in words.split()})
CHAIN = 2
#: Up to so many first rows of ranges are broadcast by id; more are joined by a shuffle.
SMALL = 500_000


def _branches(words: list[str]) -> str:
    """A regular expression of the words as a tree of letters, so that a matcher leaves at the first wrong one."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [h + (_branches(rest) if rest != [""] else "") for h, rest in sorted(heads.items()) if h]
    whole = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
    return whole + "?" * ends



def _marked(text: Column) -> Column:
    """Lower-case words, each led by a space; anchors by a space and a tilde."""
    words = F.regexp_replace(F.lower(text), r"[^a-z\p{L}\p{M}|]++", " ")
    spaced = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), r" ?\|[| ]*+", " | ")
    marked = F.regexp_replace(spaced, rf" (?=(?:{_branches(_WORDS)}|\|) )", " ~")
    # words are single-spaced, but for bars; a run of one anchor has the spots of one of them
    return F.regexp_replace(marked, r"( ~[^ ]++)(?:\1(?= ))++", "$1")


def with_signatures(rows: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add `out`, the sorted distinct 64-bit spot signatures of a text: for each anchor, it and the next `chain` content words.

    Anchors between the words of a chain are skipped. A text without a whole chain has
    the chains of any `chain` + 1 words in a row, without as many words those of 4 letters in a row, and if it is shorter
    one signature, of itself. A null text is empty, a text may be as long as memory allows. Each step is a
    column of its own, so that none is worked out twice; columns _marked, _spots and _keys must be free.
    """
    given = F.coalesce(text, F.lit(""))
    skip, word = r"(?: ++~[^ ]++)*+", r" ++[^ ~]++"  # possessive: Java's matcher then keeps no stack
    rows = rows.withColumn("_marked", _marked(given))
    rows = rows.withColumn("_spots", F.regexp_extract_all("_marked", F.lit(rf" (?=(~[^ ]++{(skip + word) * chain}) )"), F.lit(1)))
    content = lambda s: F.when(F.locate(" ~", s) > 0, F.regexp_replace(s, r" ++~[^ ]++", "")).otherwise(s)
    rows = rows.withColumn("_keys", F.transform("_spots", lambda s: F.xxhash64(content(s))))
    # without spots: chains of any words, else of letters, else the text itself
    bare = F.regexp_replace("_marked", "[~ ]++", " ")
    any_words = F.regexp_extract_all(bare, F.lit(r"(?<![^ ])(?=([^ ]++(?: [^ ]++)" + f"{{{chain}}}))"), F.lit(1))
    letters = F.regexp_extract_all(F.regexp_replace("_marked", "[~ |]++", ""), F.lit(r"(?=(.{4}))"), F.lit(1))
    others = F.when(F.size(any_words) > 0, any_words).otherwise(letters)
    rows = rows.withColumn("_spots", F.when(F.size("_keys") > 0, F.array().cast("array<string>")).otherwise(others))
    rest = F.when(F.size("_spots") > 0, F.transform("_spots", lambda s: F.xxhash64(s, F.lit(1)))).otherwise(F.array(F.xxhash64(given, F.lit(2))))
    keys = F.sort_array(F.array_distinct(F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(rest)))
    return rows.withColumn(out, keys).drop("_marked", "_spots", "_keys")


def name(keys: Column) -> Column:
    """The fingerprint as a string: the number of signatures and a 128-bit digest of their set."""
    return F.concat(F.size(keys).cast("string"), F.lit("-"), F.lpad(F.hex(F.xxhash64(keys)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), keys)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _placed(docs: DataFrame, per_range: int) -> DataFrame:
    """Add `range`, a number by which ranges of doc_id are ordered, with about per_range rows each wherever the ids lie.

    Ids are cut into cells of a width that is a power of two, and cells of over 16 * per_range rows into 1024 narrower ones, again
    and again; a row's range is its cell's first id. Null ids have a null range.
    """
    whole = F.col("doc_id").cast("decimal(20,0)")
    low, high, n = docs.agg(F.min(whole), F.max(whole), F.count("doc_id")).first()
    width = 1 << ((int(high - low) + 1) * per_range // n).bit_length() if n else 1
    low = int(low) if n else 0

    def cell(width: int) -> Column:
        at = F.lit(low).cast("decimal(20,0)")
        return (at + F.floor((whole - at) / F.lit(width).cast("decimal(20,0)")).cast("decimal(20,0)") * F.lit(width).cast("decimal(20,0)")).cast("decimal(20,0)")

    rows = docs.withColumn("range", cell(width))
    ids = docs.select("doc_id").where("doc_id is not null")
    heavy = None
    while width > 1:
        cells = (ids if heavy is None else ids.withColumn("range", cell(wider)).join(F.broadcast(heavy), "range", "left_semi").drop("range")).withColumn("range", cell(width))
        heavy = cut(cells.groupBy("range").count().where(F.col("count") > 16 * per_range).select("range"))
        if not heavy.limit(1).count():
            break
        wider, width = width, max(1, width >> 10)
        rows = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), "range", "left").withColumn("range", F.when(F.col("_heavy"), cell(width)).otherwise(F.col("range"))).drop("_heavy")
    return rows


def _following(ranges: DataFrame) -> DataFrame:
    """(of, range): for each of the distinct ranges the one after it by descending number, nulls last; after the last the first.

    They are sorted over many tasks; a range's place is its task's first place and its place there.
    """
    line = cut(ranges.orderBy(F.desc_nulls_last("range")).withColumn("at", F.monotonically_increasing_id()))
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = line.groupBy(task.alias("task")).count().orderBy("task").collect()  # one row a task
    firsts, total = [], 0
    for row in sizes:
        firsts.append((row["task"], total))
        total += row["count"]
    begin = line.sparkSession.createDataFrame(firsts, "task long, first long")
    placed = line.withColumn("task", task).join(F.broadcast(begin), "task").select("range", (F.col("first") + place).alias("n"))
    return placed.select(F.col("range").alias("of"), ((F.col("n") + 1) % max(total, 1)).alias("n")).join(placed, "n").select("of", "range")


def with_next(docs: DataFrame, columns: list[str], signed=lambda rows: rows, per_range: int = 256) -> DataFrame:
    """`signed` rows of docs (doc_id, text), and next_<c> for each of columns: its value in the row after, by descending doc_id (ties by text; after the last: the first).

    Rows are dealt by ranges of ids and a row looks ahead in its range. The first row of the range that follows, found by its id, stands
    behind each range as a guest, so that the last row sees it too; guests, one for each range, are signed and dealt
    with the rows, and nothing is joined to the texts. Null ids come last, as one range. No rows give none.
    """
    rows = _placed(docs, per_range).select("doc_id", "text", "range")
    tops = cut(rows.groupBy("range").agg(F.max("doc_id").alias("doc_id")))
    few = F.broadcast(tops) if tops.count() <= SMALL else tops
    first = rows.withColumnRenamed("doc_id", "id").withColumnRenamed("range", "own").join(few, F.col("own").eqNullSafe(F.col("range")) & F.col("id").eqNullSafe(F.col("doc_id")))
    heads = first.groupBy("range").agg(F.min("text").alias("text")).withColumnRenamed("range", "head")
    then = _following(tops.select("range"))
    then = F.broadcast(then) if few is not tops else then
    guests = heads.join(then, F.col("head").eqNullSafe(F.col("range"))).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("of").alias("range"), F.lit(True).alias("guest"))
    whole = signed(rows.withColumn("guest", F.lit(False)).unionAll(guests))
    order = W.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    seen = whole.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return seen.where(~F.col("guest")).drop("guest", "range")


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(doc_id, text, spots) of every row: the text, null as empty, and its signature set.

    Repeated rows stay; null ids are kept; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    return with_signatures(docs.select("doc_id", text.alias("text")), "text", "spots", chain)


def near_pairs(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, likeness) of classes of equal sets that are at least percent/100 alike; sets has doc_id and spots.

    a and b are the classes' least ids, a < b by set name. Classes are partitioned by set length, so that only
    the same or the next length class can be alike; a class meets others over its rarest
    signatures, as many as a pair that is alike enough can't miss; a pair is dropped by its lengths before
    the sets are compared. Exact; rows with a null id take no part.
    """
    t = percent / 100
    classes = sets.where("doc_id is not null").groupBy("spots").agg(F.min("doc_id").alias("id"))
    length = F.size("spots")
    classes = classes.select("id", "spots", length.alias("n"), F.floor(F.log(length.cast("double")) / math.log(1 / t) + 1e-9).alias("kind"))
    often = classes.select(F.explode("spots").alias("key")).groupBy("key").agg(F.count("*").alias("times"))
    ranked = classes.select("id", "n", "kind", F.explode("spots").alias("key")).join(often, "key")
    nth = F.row_number().over(W.partitionBy("id").orderBy("times", "key"))
    prefix = ranked.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).select("id", "n", "kind", "key")
    left = prefix.select("key", F.explode(F.array(F.col("kind"), F.col("kind") + 1)).alias("kind"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("kind").alias("own"))
    right = prefix.select("key", "kind", F.col("id").alias("b"), "n")
    close = (F.least("m", "n") >= F.lit(t) * F.greatest("m", "n") - 1e-9) & ((F.col("own") < F.col("kind")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["key", "kind"]).where(close).select("a", "b").distinct()
    of = classes.select("id", "spots")
    both = pairs.join(of.select(F.col("id").alias("a"), F.col("spots").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("spots").alias("y")), "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= t - 1e-12)
