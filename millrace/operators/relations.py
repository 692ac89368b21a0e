"""Reuse, differences, garbage, neighbourhoods, ranges, retention and paging as joins and windows."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W


def _micros(when: Column | str) -> Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros((F.col(when) if isinstance(when, str) else when).cast("timestamp"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by one full outer join."""
    a, b = old.select(key, F.col(hash_).alias("old_hash")), new.select(key, F.col(hash_).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def planned_reuse(candidates: DataFrame, manifest: DataFrame, builds: DataFrame, same: list[str]) -> DataFrame:
    """(ordinal, build_id, document_id): for each candidate the build whose document can be taken over, of all builds at once.

    Equal in all columns of `same` (null-safe), under one of the candidate's encodings, from a ready build of the same compatibility, with at
    least one chunk and none made under another chunking identity; of several the
    one completed last, then created last, then of least id. candidates: ordinal, the columns of
    same, chunking_identity, encodings, compatibility; manifest, a row for each document of each build: build_id, document_id, the columns of same, encoding, chunks, made_by.
    """
    ready = builds.where("status = 'ready'").select("build_id", "compatibility", F.coalesce("completed_at", "created_at").alias("done_at"), "created_at")
    d, c = manifest.join(ready, "build_id").alias("d"), candidates.alias("c")
    equal = F.col("d.compatibility") == F.col("c.compatibility")
    for name in same:
        equal = equal & F.col(f"d.{name}").eqNullSafe(F.col(f"c.{name}"))
    fit = F.array_contains("c.encodings", F.col("d.encoding")) & (F.col("d.chunks") > 0) & F.forall("d.made_by", lambda m: m == F.col("c.chunking_identity"))
    met = c.join(d, equal & fit).select("c.ordinal", "d.build_id", "d.document_id", "d.done_at", "d.created_at")
    best = W.partitionBy("ordinal").orderBy(F.desc("done_at"), F.desc("created_at"), "build_id", "document_id")
    return met.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("ordinal", "build_id", "document_id")


def reusable(candidates: DataFrame, documents: DataFrame, builds: DataFrame, chunks: DataFrame, same: list[str]) -> DataFrame:
    """planned_reuse from documents that don't tell of their chunks: these (build_id, document_id, chunking_identity) are counted first."""
    made = chunks.groupBy("build_id", "document_id").agg(F.count("*").alias("chunks"), F.collect_set("chunking_identity").alias("made_by"))
    return planned_reuse(candidates, documents.join(made, ["build_id", "document_id"]), builds, same)


def unreferenced(shared: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of shared that no row of references names: what may be deleted."""
    return shared.join(references.select(*keys), keys, "left_anti")


def referenced(shared: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    return shared.join(references.select(*keys), keys, "left_semi")


def deduplicated(inputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, uses): one row for each distinct input of a model; fails if one key stands for two texts."""
    grouped = inputs.groupBy(key).agg(F.min(text).alias(text), F.max(text).alias("other"), F.count("*").alias("uses"))
    checked = F.when(F.col(text) == F.col("other"), F.col(text)).otherwise(F.raise_error(F.lit("one input id for two texts")).cast("string"))
    return grouped.select(key, checked.alias(text), "uses")


def neighbourhood(rows: DataFrame, group: str, order: list[str], value: Column, before: int, after: int) -> DataFrame:
    """Each row with `before` and `after` values around it, in order within its group."""
    w = W.partitionBy(group).orderBy(*order)
    return rows.select(
        "*", F.collect_list(value).over(w.rowsBetween(-before, -1)).alias("before") if before else F.array().alias("before"),
        F.collect_list(value).over(w.rowsBetween(1, after)).alias("after") if after else F.array().alias("after"),
    )


def merge_ranges(ranges: DataFrame, group: str, start: str, end: str, gap: int = 1, parts: int | None = None) -> DataFrame:
    """(group, start, end, merged): ranges that touch or overlap, or lie `gap` apart at most, as one.

    The ranges of a group are dealt to parts by where they start, so that a group of any size is spread over tasks. How far the ranges of a part reach is carried
    to the parts after it by way of one row for each group and part, as is the range that is still open at its end.
    """
    parts = parts or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = ranges.approxQuantile(start, [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    part = sum(((F.col(start) >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0)).alias("_part")
    rows = ranges.select(group, start, end, F.coalesce(part, F.lit(0)).alias("_part"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    reaches = rows.groupBy(group, "_part").agg(F.max(end).alias("_end")).select(group, "_part", F.max("_end").over(earlier).alias("_before"))
    carried = rows.alias("r").join(reaches.alias("b"), F.col(f"r.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("r._part") == F.col("b._part"))).select("r.*", "_before")
    w = W.partitionBy(group, "_part").orderBy(start, end)
    reach = F.greatest(F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), "_before")
    opens = F.when(F.col(start) > F.coalesce(reach, F.col(start) - gap - 1) + gap, 1).otherwise(0)
    islands = carried.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w))
    local = islands.groupBy(group, "_part", "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"))
    # what goes on from an earlier part, island 0, belongs to the last one that opened there
    last = local.groupBy(group, "_part").agg(F.max("_island").alias("_last")).select(group, "_part", F.last(F.when(F.col("_last") > 0, F.struct("_part", F.col("_last").alias("_island"))), True).over(earlier).alias("_open"))
    owned = local.alias("l").join(last.alias("o"), F.col(f"l.{group}").eqNullSafe(F.col(f"o.{group}")) & (F.col("l._part") == F.col("o._part")))
    of = F.when(F.col("_island") > 0, F.struct(F.col("l._part"), F.col("_island"))).otherwise(F.col("_open"))
    return owned.groupBy(F.col(f"l.{group}").alias(group), of.alias("_of")).agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("merged").alias("merged")).drop("_of")


def retained(rows: DataFrame, group: str, used: str, key: str, protected: Column, limit: int) -> DataFrame:
    """Rows with `retained`: the protected ones, and of the others the `limit` used last in each group."""
    w = W.partitionBy(group, protected).orderBy(F.desc(used), key)
    return rows.withColumn("retained", protected | (F.row_number().over(w) <= limit))


def latest(rows: DataFrame, group: str, when: str, key: str) -> DataFrame:
    """(group, key) of the newest row of each group, ties to the least key; partial results are merged, nothing is sorted."""
    return rows.groupBy(group).agg(F.min_by(key, F.struct((-_micros(when)).alias("w"), F.col(key).alias("k"))).alias(key))


def page(rows: DataFrame, group: str, order: list[str], start: int, limit: int) -> DataFrame:
    """Rows start.. of each group, `limit` at most, with has_more."""
    w = W.partitionBy(group).orderBy(*order)
    seen = rows.withColumn("position", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(W.partitionBy(group)))
    cut = seen.where((F.col("position") >= start) & (F.col("position") < start + limit))
    return cut.withColumn("has_more", F.col("size") > start + limit).drop("size")


def sessions(rows: DataFrame, group: str, when: str, key: str, quiet: float, most: float) -> DataFrame:
    """(group, first_at, last_at, n): bursts of events, ended by `quiet` seconds without one; firings is how many waits of `most` seconds a burst spans."""
    w = W.partitionBy(group).orderBy(when, key)
    gap = (_micros(when) - _micros(F.lag(when).over(w))) / 1e6
    marked = rows.withColumn("burst", F.sum(F.when(gap > quiet, 1).otherwise(0)).over(w))
    out = marked.groupBy(group, "burst").agg(F.min(when).alias("first_at"), F.max(when).alias("last_at"), F.count("*").alias("n"))
    span = (_micros("last_at") - _micros("first_at")) / 1e6
    return out.withColumn("firings", (F.floor(span / most) + 1).cast("long"))


def status_counts(builds: DataFrame, group: str, states: list[str]) -> DataFrame:
    """Builds of each state for each group, 0 where there are none, and all of them."""
    return builds.groupBy(group).agg(*(F.count_if(F.col("status") == s).alias(s) for s in states), F.count("*").alias("builds"))


def greedy_batches(rows: DataFrame, group: str, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows with `batch`, an int from 0: each group filled in order up to most_rows and most_size; a row over most_size is an error.

    A group's rows are sorted on disk and numbered as a stream that holds one batch's counts, so groups may be of any length; a null size counts as 0.
    """

    def numbered(batches):
        at, batch, n, total = object(), -1, 0, 0
        for given in batches:
            told = []
            for key, own in zip(given.column(group).to_pylist(), given.column(size).to_pylist()):
                own = own or 0
                if own > most_size:
                    raise ValueError("an input is larger than a batch")
                if key != at:
                    at, batch, n, total = key, 0, 0, 0
                elif n >= most_rows or total + own > most_size:
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + own
                told.append(batch)
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(told, pa.int32())], names=[*given.schema.names, "batch"])

    dealt = rows.repartition(group).sortWithinPartitions(group, *order, size)
    return dealt.mapInArrow(numbered, StructType([*rows.schema.fields, StructField("batch", IntegerType())]))


def _blocks(ranks: Column, bits: Column, bit: int) -> Column:
    """The blocks (level, block) of 2^level ranks at those levels below `bits` at which the ranks have this bit.

    The ranks before n are made up by the blocks before those in which n's bits are set; a rank is in one of them only where its own bit isn't set.
    """
    levels = F.filter(F.sequence(F.lit(0), F.greatest(bits, F.lit(1)).cast("int") - 1), lambda k: F.call_function("shiftright", ranks, k) % 2 == bit)
    return F.transform(levels, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", ranks, k + 1).alias("block")))


def smallest_container(parts: DataFrame, symbols: DataFrame, document: str, key: list[str]) -> DataFrame:
    """parts (document, key, start, end) with `container`, the name of the least symbol range around each, the earlier on ties; null if none is.

    Parts and symbols (document, name, start, end) are dealt by document and sorted by their starts once, on disk where they are many, and each document is read as a
    stream: of its symbols so far it holds those that are less than all that end as late, so the first of these that ends late enough is a part's container. Starts and ends are whole numbers.
    """
    s = symbols.where(F.col(document).isNotNull() & (F.col("start") <= F.col("end")))
    s = s.select(document, F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.lit(True).alias("_told"), F.col("name").alias("_name"))
    p = parts.select(document, *key, F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.when(F.col("end").isNotNull(), F.lit(False)).alias("_told"))
    both = p.unionByName(s, allowMissingColumns=True)
    # parts without a document, which have no container, may be many
    dealt = both.repartition(document, *(F.when(F.col(document).isNull(), F.col(k)) for k in key)).sortWithinPartitions(document, "_start", F.desc("_told"))
    kept = [document, *key, "_start", "_end"]

    def contained(batches):
        last, ends, least = None, [], []
        for given in batches:
            documents, n = given.column(document), given.num_rows
            if not n:
                continue
            opens = pc.fill_null(pc.not_equal(documents.slice(1), documents.slice(0, n - 1)), True).to_pylist()
            first, told = documents[0].as_py(), given.column("_told")
            starts, reach = (pc.fill_null(given.column(c), 0).to_numpy().tolist() for c in ("_start", "_end"))
            found = []
            for new, symbol, start, end, name in zip([first is None or first != last, *opens], told.to_pylist(), starts, reach, given.column("_name").to_pylist()):
                if new:
                    ends, least = [], []
                at = bisect_left(ends, end)
                if not symbol:
                    found.append(least[at][-1] if symbol is False and at < len(ends) else None)
                    continue
                own = (end - start, start, name is not None, name)  # a null comes first
                if at < len(ends) and least[at] <= own:
                    continue
                after = at + (at < len(ends) and ends[at] == end)
                while at and least[at - 1] >= own:
                    at -= 1
                ends[at:after], least[at:after] = [end], [own]
            last = documents[n - 1].as_py()
            asked = given.filter(pc.invert(pc.fill_null(told, False)))
            yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in kept), pa.array(found, given.column("_name").type)], names=[*kept, "container"])

    out = dealt.mapInArrow(contained, StructType([*(dealt.schema[c] for c in kept), StructField("container", symbols.schema["name"].dataType)]))
    own = {x: F.col(f"_{x}").cast(parts.schema[x].dataType).alias(x) for x in ("start", "end")}
    return out.select(document, *key, own["start"], own["end"], "container")


def overlapping(left: DataFrame, right: DataFrame, document: str) -> DataFrame:
    """(document, left, right) of the rows of left and right (document, id, start, end) whose half-open ranges overlap, each pair once.

    Either the right one starts in the left one, or the left one after the start of the right one and in it. One side's starts are ranked in each document, and
    those in a range of the other side are ranks that follow on each other, so the work follows the number of rows and of pairs that are found.
    """
    there = F.col("start") < F.col("end")
    pairs = []
    for points, ranges, first in ((right, left, F.col("start")), (left, right, F.col("start") + 1)):
        p = points.where(there).select(F.col(document).alias("_document"), F.col("id").alias("_point"), F.lit(None).cast(ranges.schema["id"].dataType).alias("_range"), F.lit(1).alias("_is"), F.col("start").cast("long").alias("_from"), F.col("start").cast("long").alias("_to"))
        r = ranges.where(there & (first < F.col("end"))).select(F.col(document).alias("_document"), F.lit(None).cast(points.schema["id"].dataType).alias("_point"), F.col("id").alias("_range"), F.lit(0).alias("_is"), first.cast("long").alias("_from"), F.col("end").cast("long").alias("_to"))
        # how many starts there are before each end of a range; a start counts itself
        before = lambda place: F.sum("_is").over(W.partitionBy("_document").orderBy(place, "_is").rowsBetween(W.unboundedPreceding, W.currentRow))
        ranked = p.unionAll(r).where("_document is not null").withColumn("_first", before("_from")).withColumn("_last", before("_to"))
        asked = ranked.where("_is = 0 and _last > _first").select("_document", "_range", F.explode(F.sequence(F.col("_first") + 1, F.col("_last"))).alias("_first"))
        met = asked.join(ranked.where("_is = 1").select("_document", "_point", "_first"), ["_document", "_first"])
        names = ("_range", "_point") if points is right else ("_point", "_range")
        pairs.append(met.select(F.col("_document").alias(document), F.col(names[0]).alias("left"), F.col(names[1]).alias("right")))
    return pairs[0].unionAll(pairs[1])


#: So many different bindings of one document are looked for in its parts' words at once; with more, words and bindings are joined.
_FEW = 1000


def relevant_imports(parts: DataFrame, imports: DataFrame, document: str, key: list[str], few: int = _FEW) -> DataFrame:
    """(document, key, imports): sources of the imports that overlap a part or one of whose bindings stands in its text as a word, in order.

    parts: document, key, start, end, text; imports: document, source, bindings, start, end. Ranges meet by `overlapping`, bindings by the words of the texts:
    of a document with `few` bindings at most, only words that are one of them are dealt to the imports, of others all.
    """
    told = F.struct(F.col("start").alias("_start"), "source")
    i = imports.select(F.col(document).alias("_document"), told.alias("_told"), "bindings", "start", "end")
    own = F.struct(*key)
    p = parts.select(document, own.alias("id"), "start", "end")
    # bindings play no part where the ranges meet, nor do ranges where the words do
    by_range = overlapping(p, i.select(F.col("_document").alias(document), F.col("_told").alias("id"), "start", "end"), document).select(document, F.col("left").alias("_key"), F.col("right").alias("_told"))
    bound = i.select(F.col("_document").alias(document), "_told", F.explode(F.array_distinct("bindings")).alias("_word")).where("_word is not null")
    # as many as one more than few: an array of that size stands for too many
    held = bound.select(document, "_word").distinct().withColumn("_nth", F.row_number().over(W.partitionBy(document).orderBy("_word"))).where(F.col("_nth") <= few + 1)
    held = held.groupBy(document).agg(F.collect_list("_word").alias("_few"))
    words = F.split("text", r"[^\p{L}\p{N}_$]+")
    wanted = F.when(F.size("_few") <= few, F.array_intersect(words, F.col("_few"))).otherwise(F.array_distinct(words))
    words = parts.select(document, own.alias("_key"), "text").join(held, document).select(document, "_key", F.explode(wanted).alias("_word"))
    by_word = words.join(bound, [document, "_word"]).select(document, "_key", "_told")
    found = by_range.unionAll(by_word).groupBy(document, "_key").agg(F.array_sort(F.collect_set("_told")).alias("_all"))
    met = parts.select(document, *key, own.alias("_key")).join(found, [document, "_key"], "left")
    return met.select(document, *key, F.coalesce(F.transform("_all", lambda x: x["source"]), F.array().cast("array<string>")).alias("imports"))


def members(memberships: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Memberships with their chunks' columns, by (document_id, chunk_id); a membership without its chunk is an error when it is read."""
    met = memberships.join(chunks.select("document_id", "chunk_id", F.lit(True).alias("_there"), *columns), ["document_id", "chunk_id"], "left")
    sure = F.when(F.col("_there"), F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("no chunk "), F.col("chunk_id"))).cast("string"))
    return met.withColumn("chunk_id", sure).drop("_there")


def around_anchor(rows: DataFrame, group: str, position: str, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """The rows up to `before` places before and `after` after each anchor (group, position), with `anchor` and their `distance` from it.

    Each anchor asks for the places around it, so the join is by equality; any number of rows may be anchors.
    """
    places = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    asked = anchors.select(F.col(group).alias("_group"), F.col(position).alias("anchor"), places.alias("_by")).withColumn("_place", F.col("anchor") + F.col("_by"))
    near = (rows[group] == asked["_group"]) & (rows[position] == asked["_place"])
    return rows.join(asked, near).withColumn("distance", F.col(position) - F.col("anchor")).drop("_group", "_place", "_by")


def counted(parents: DataFrame, children: DataFrame, keys: list[str], name: str) -> DataFrame:
    """parents with the number of their children, 0 where there are none."""
    return parents.join(children.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def newest_first(builds: DataFrame) -> DataFrame:
    return builds.orderBy(F.desc("created_at"), "build_id")


def by_length(inputs: DataFrame, text: str, key: str, partitions: int | None = None) -> DataFrame:
    """Inputs of a model in order of their length, then key, within ranges of it: batches of alike lengths need little padding."""
    sized = inputs.withColumn("_length", F.length(text))
    dealt = sized.repartitionByRange(partitions, "_length", key) if partitions else sized.repartitionByRange("_length", key)
    return dealt.sortWithinPartitions("_length", key).drop("_length")


def page_text(text: Column, start: int, most: int) -> Column:
    """Struct (text, next_start) of `most` characters from a 0-based start; next_start is null at the end."""
    if start < 0 or most < 1:
        raise ValueError("a page starts at 0 or later and holds a character at least")
    part = F.substring(text, start + 1, most)
    return F.struct(part.alias("text"), F.when(F.length(text) > start + most, F.lit(start + most)).alias("next_start"))


def distinct_in_order(values: Column) -> Column:
    """The values of an array, each once, where it stands first."""
    return F.array_distinct(values)
