"""Chat formatting as a prefix tree: what conversations share from their start on is emitted once.

Each turn is formatted as ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Control strings inside roles and texts
are broken by a backslash after their first character, and backslashes are doubled, so the formatting
can be undone.  The units ("tokens") of all offsets are the code points of the formatted text.

A node of the tree is a distinct sequence of first turns, identified by a 128-bit hash.  Conversations are
sorted by their path of forks (nodes with siblings), which is a depth-first order of the tree; a node is emitted by the
first conversation that passes through it.  So each distinct conversation emits one *segment*: its turns from where it
leaves all earlier ones.  With a segment go

- ``start``: its place in the depth-first emission,
- ``position``: the position id of its first token (positions run on along the path from the root),
- ``attends``: the emission intervals of its ancestors; a token attends to these and to its own
  segment up to itself,
- ``loss``: the intervals, inside the segment, of assistant texts.

All steps are joins, aggregations and windows over turns or nodes; equal conversations are one leaf of the tree before
anything is sorted or joined by path, and no step gathers a tree.  One conversation (its turns, or its text) must fit into a row.

Defined cases: null roles and texts are empty; turns are ordered by number, then role and text (null first); the rows
of a null conversation id are one conversation; an empty table gives empty results; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.llm.staging import stage

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this template and of other common ones.
CONTROLS = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
BACKSLASH = r"\\"  # as a pattern and as a replacement
_TURN = r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "[]{}()*+?.\\^$|" else c for c in text)


def escape(text: Column) -> Column:
    """The text with no control string in it."""
    inside = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(F.regexp_replace(text, BACKSLASH, BACKSLASH * 2), inside, BACKSLASH)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass
class ChatTree:
    """``segments`` (leaf, tree, start, length, position, attends, loss, text), ``pieces`` (which parts of
    which segments make up a leaf's conversation) and ``conversations`` (conv_id, leaf, n_turns)."""

    segments: DataFrame
    pieces: DataFrame
    conversations: DataFrame


def build(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> ChatTree:
    """The prefix tree of all conversations."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(conv_id).cast("string"), empty).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text"),
    )
    by_conv = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far = by_conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"depth": F.row_number().over(by_conv), "last": F.lead(F.lit(1)).over(by_conv).isNull()})
    rows = rows.withColumns({"own1": F.xxhash64("depth", "role", "text"), "own2": F.xxhash64(F.lit("2"), "text", "depth", "role")})
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))})
    rows = rows.withColumns({"part": F.concat("head", "body", F.lit(END))})
    rows = rows.withColumns(
        {
            "h1": F.expr("bit_xor(own1)").over(so_far),
            "h2": F.expr("bit_xor(own2)").over(so_far),
            "p1": F.coalesce(F.expr("bit_xor(own1)").over(earlier), F.lit(0)),
            "p2": F.coalesce(F.expr("bit_xor(own2)").over(earlier), F.lit(0)),
            "n": F.length("part").cast("bigint"),
            "at": F.coalesce(F.sum(F.length("part")).over(earlier), F.lit(0)).cast("bigint"),
            "loss_from": F.when(F.col("role") == loss_role, F.length("head")).cast("bigint"),
            "loss_size": F.length("body").cast("bigint"),
        }
    )
    kept = ["conv_id", "conv", "depth", "last", "h1", "h2", "p1", "p2", "n", "at", "part", "loss_from", "loss_size"]
    turns = stage(rows.select(*kept), "chat-turns")
    node = ["depth", "h1", "h2"]
    nodes = turns.groupBy(*node, "p1", "p2").agg(F.count("*").alias("times"))
    forks = nodes.join(nodes.groupBy("depth", "p1", "p2").agg(F.count("*").alias("siblings")), ["depth", "p1", "p2"])
    forks = forks.select(*node, ((F.col("siblings") > 1) | (F.col("depth") == 1)).alias("fork"))
    # One conversation stands for all that are equal.
    ends = turns.where("last").select("conv_id", "conv", *node)
    leaves = ends.groupBy(*node).agg(F.min("conv").alias("conv"))
    paths = turns.join(leaves.select("conv"), "conv", "left_semi").drop("conv_id", "last", "p1", "p2")
    marked = paths.select("conv", *node).join(forks, node)
    keys = marked.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.when(F.col("fork"), F.struct(*node)))).alias("key"), F.max("depth").alias("turns")
    )
    ordered = stage(keys.orderBy("key", "turns", "conv").select("conv", "turns", F.monotonically_increasing_id().alias("leaf")), "chat-order")
    ranked = paths.join(ordered.select("conv", "leaf"), "conv")
    owners = ranked.groupBy(*node).agg(F.min("leaf").alias("owner"))
    owned = stage(ranked.join(owners, node).select("leaf", "owner", "depth", "h1", "n", "at", "part", "loss_from", "loss_size"), "chat-paths")
    own = (
        owned.where("leaf = owner")
        .groupBy("leaf")
        .agg(
            F.sum("n").alias("length"),
            F.min("at").alias("position"),
            F.sort_array(F.collect_list(F.struct("depth", "part", "at", "loss_from", "loss_size"))).alias("parts"),
        )
    )
    # Places in the emission: sums per sorted partition, then inside each.
    sizes = own.select("leaf", "length", F.shiftright("leaf", 33).alias("slice"))
    slices = sizes.groupBy("slice").agg(F.sum("length").alias("size"))
    slices = slices.select("slice", (F.sum("size").over(Window.orderBy("slice")) - F.col("size")).alias("before"))
    inside = Window.partitionBy("slice").orderBy("leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.withColumn("upto", F.sum("length").over(inside)).join(slices, "slice").select("leaf", (F.col("before") + F.col("upto") - F.col("length")).alias("start"))
    placed = stage(own.join(starts, "leaf").select("leaf", "start", "position", "length"), "chat-places")
    # A leaf's path, cut where another segment begins.
    cuts = owned.groupBy("leaf", "owner").agg(F.min("at").alias("from"), F.max(F.col("at") + F.col("n")).alias("to"))
    where = placed.select(F.col("leaf").alias("owner"), "start", "position")
    pieces = stage(
        cuts.join(where, "owner").select("leaf", "owner", "from", (F.col("to") - F.col("from")).alias("length"), (F.col("start") + F.col("from") - F.col("position")).alias("start")),
        "chat-pieces",
    )
    ancestors = (
        pieces.where("leaf <> owner")
        .groupBy("leaf")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("from", "start", "length"))), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["length"]).alias("end"))).alias("attends"))
    )
    roots = owned.where("depth = 1").select("leaf", F.lower(F.hex("h1")).alias("tree"))
    losses = F.transform(
        F.filter("parts", lambda x: x["loss_from"].isNotNull()),
        lambda x: F.struct(
            (x["at"] - F.col("position") + x["loss_from"]).alias("start"), (x["at"] - F.col("position") + x["loss_from"] + x["loss_size"]).alias("end")
        ),
    )
    segments = (
        own.select("leaf", "length", "position", losses.alias("loss"), F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))
        .join(starts, "leaf")
        .join(roots, "leaf")
        .join(ancestors, "leaf", "left")
        .select("leaf", "tree", "start", "length", "position", F.coalesce("attends", F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")).alias("attends"), "loss", "text")
    )
    segments = stage(segments, "chat-segments")
    stand = leaves.join(ordered, "conv").select(*node, "leaf", "turns")
    conversations_ = ends.join(stand, node).select("conv_id", "leaf", F.col("turns").cast("bigint").alias("n_turns"))
    return ChatTree(segments, pieces, conversations_)


def formatted(tree: ChatTree) -> DataFrame:
    """``leaf, text, loss``: the whole formatted text of every distinct conversation, put together from the segments."""
    parts = tree.pieces.select("leaf", "owner", "from", F.col("length").alias("take"))
    segments = tree.segments.select(F.col("leaf").alias("owner"), "text", "loss")
    shifted = F.transform(
        F.filter("loss", lambda x: x["end"] <= F.col("take")), lambda x: F.struct((x["start"] + F.col("from")).alias("start"), (x["end"] + F.col("from")).alias("end"))
    )
    cut = parts.join(segments, "owner").select("leaf", "from", F.expr("substring(text, 1, cast(take AS int))").alias("text"), shifted.alias("loss"))
    whole = cut.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("from", "text", "loss"))).alias("parts"))
    return whole.select(
        "leaf", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("parts", lambda x: x["loss"])).alias("loss")
    )


def read_back(tree: ChatTree) -> DataFrame:
    """Per conversation: ``conv_id``, ``turns`` (role and text), ``loss_text`` and ``formatted_chars``, from the output alone."""
    whole = formatted(tree)
    turns = F.transform(
        F.arrays_zip(F.regexp_extract_all("text", F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(_TURN), F.lit(2)).alias("text")),
        lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")),
    )
    loss = F.expr("array_join(transform(loss, x -> regexp_replace(substring(text, cast(x.start + 1 AS int), cast(x.end - x.start AS int)), '\\\\\\\\(\\\\\\\\?)', '$1')), '')")
    read = whole.select("leaf", turns.alias("turns"), loss.alias("loss_text"), F.length("text").cast("bigint").alias("formatted_chars"))
    return tree.conversations.select("conv_id", "leaf").join(read, "leaf").drop("leaf")
