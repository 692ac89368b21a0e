"""Chat formatting of reply trees with DataFrame operations only.

Root-to-leaf paths are found by self-joins that double their reach each time,
branches are ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Put one backslash into every <|, <\|, <\\|...; so no control string is left, and `unescape` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: % and line feeds are written as %25 and %0A, < as %3C."""
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, above) for every node of every root-to-leaf path of nodes (node, parent).

    `above` counts the steps from the leaf. Each round joins the pairs found so
    far with pointers to the 2**k-th ancestor and the pointers with themselves, so a
    tree of depth d takes log2(d) rounds, each checkpointed. A parent that isn't a node is none. Nodes
    on or below a cycle have no root, and are on no path.
    """
    known = nodes.select(F.col("node").alias("parent"))
    linked = nodes.where("parent is not null").join(known, "parent").select("node", "parent")
    inner = linked.select(F.col("parent").alias("node")).distinct()
    pairs = nodes.select("node").join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    jumps = cut(linked.select("node", F.col("parent").alias("to")))
    pairs, reach, left = cut(pairs), 1, jumps.count()
    most = nodes.count()
    while left and reach <= most:
        further = pairs.join(jumps, "node").select("leaf", F.col("to").alias("node"), (F.col("above") + reach).alias("above"))
        pairs = cut(pairs.unionAll(further))
        jumps = cut(jumps.join(jumps.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        reach, left = reach * 2, jumps.count()
    if left:  # what still has an ancestor so far away runs into a cycle
        lost = pairs.join(jumps.select("node"), "node", "left_semi").select("leaf").distinct()
        pairs = pairs.join(lost, "leaf", "left_anti")
    return pairs


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Format the best-scored root-to-leaf paths of each tree as conversations.

    messages: tree, node (unique strings), parent, role, text, score. Returns for each chosen
    path tree, leaf, branch (1: the greatest mean score, ties to the smaller leaf), n_turns, formatted, and
    loss_spans: array of (start, length), 1-based code points of formatted that hold assistant
    text, with the text as it was written: (start, length, turn). best: paths of each tree that are chosen; None: all. Null role or text: empty;
    null score: 0; a null tree is a tree. No messages give no rows; other columns are ignored; a conversation is one string, however long.
    """
    on_path = paths(messages.select("node", "parent"))
    told = messages.select("node", "tree", _empty("role").alias("role"), _empty("text").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    turn = F.struct((-F.col("above")).alias("at"), "role", "text")
    if best is not None:  # ranked by ids and scores alone, before any text moves
        branches = on_path.join(told.select("node", "tree", "score"), "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("score"))
        ranked = W.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        on_path = on_path.join(branches.withColumn("branch", F.row_number().over(ranked)).where(F.col("branch") <= best).select("leaf", "branch"), "leaf")
    rank = [F.first("branch").alias("branch")] if best is not None else []
    whole = on_path.join(told, "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(turn)).alias("turns"), *rank)
    part = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learned")))
    whole = whole.withColumn("parts", part)
    tail = F.lit(END + "\n")
    formatted = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], tail)))
    zero = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        size = F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(p["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("parts", zero, step, lambda acc: acc["spans"])
    kept = ["tree", "leaf", *(["branch"] if best is not None else []), F.size("turns").cast("long").alias("n_turns")]
    return whole.select(*kept, formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, parsed from its text alone."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)

    def turn(piece: Column) -> Column:
        cut_at = F.instr(piece, "\n")
        body = F.substr(piece, cut_at + 1, F.length(piece) - cut_at - F.lit(len(END) + 1))
        return F.struct(unescape_role(F.substr(piece, F.lit(1), cut_at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))))


def _told() -> Column:
    """A plain score of a message: the share of letters and digits among its code points."""
    return F.length(F.regexp_replace(_empty("text"), r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(_empty("text")), F.lit(1))


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each row answers the row before it.

    Rows of a conversation are ordered by turn, then role and text, nulls first. A message scores the share of
    letters and digits in its text, 0 if it is empty.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", key.alias("key"), F.row_number().over(order).alias("n"))
    node = lambda n: F.concat("key", F.lit("/"), n.cast("string"))
    return rows.select(F.col("conv_id").alias("tree"), node(F.col("n")).alias("node"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"), "role", "text", _told().alias("score"))
