"""Operator 8, chat formatting: reply trees become conversations with a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import staged

HEAD, END = "### ", "</turn>"
"""A turn reads ``### role: text</turn>`` and a line feed."""


def escaped(text: Column) -> Column:
    """No control string is left; every backslash of the result begins one of four codes."""
    text = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit(END), F.lit("\\e")), F.lit(HEAD), F.lit("\\h"))


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped`` (and of the colon's code in roles)."""
    text = F.replace(F.replace(F.replace(text, F.lit("\\e"), F.lit(END)), F.lit("\\h"), F.lit(HEAD)), F.lit("\\c"), F.lit(":"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _key(*columns: Column) -> Column:
    """A text that stands for the values, nulls included."""
    return F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)]))


def _doubled(links: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors at distance 1, 2, 4, ... by self-joins, until none or the distance exceeds ``most``."""
    steps, step, reach = [], links, 1
    while step.take(1):
        if reach > most:
            return steps, step
        steps.append(step)
        far = step.select("tree", F.col("node").alias("above"), F.col("above").alias("far"), F.col("low").alias("low2"))
        step = staged(step.join(far, ["tree", "above"]).select(
            "tree", "node", F.col("far").alias("above"), F.least("low", "low2").alias("low")), "ancestors")
        reach *= 2
    return steps, step


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every root-to-leaf path of nodes (tree, node, above); ``up`` counts from the leaf.

    Links to absent nodes and to oneself make roots. If links form a loop, that of its smallest node is cut.
    """
    known = nodes.select("tree", F.col("node").alias("above"))
    links = nodes.filter(F.col("above") != F.col("node")).join(known, ["tree", "above"], "left_semi").select(
        "tree", "node", "above", F.least("node", "above").alias("low"))
    links = staged(links, "links")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    steps, looping = _doubled(links, largest)
    if looping.take(1):
        on_loop = looping.select("tree", F.col("above").alias("node")).distinct()
        cut = looping.join(on_loop, ["tree", "node"]).filter(F.col("low") == F.col("node")).select("tree", "node")
        links = staged(links.join(cut, ["tree", "node"], "left_anti"), "links")
        steps, _ = _doubled(links, largest)
    leaves = nodes.join(links.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(steps):
        higher = paths.join(step, ["tree", "node"]).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))
        paths = paths.unionByName(higher)
        if k % 2:
            paths = staged(paths, "paths")
    return paths


def format_trees(messages: DataFrame, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Formats the root-to-leaf paths of reply trees, one conversation each.

    ``messages``: tree_id, msg_id, parent_id, role, text and, if present, score. Result: tree_id, leaf_id, score,
    rank, formatted, spans. A path scores the mean of its messages' scores (null or absent: 0); ``rank`` orders a
    tree's paths by it, then by leaf; ``top`` keeps that many of each tree (default: all). ``spans`` lists (start,
    length), in code points, of the texts under the loss mask, in order.

    Null texts and roles are empty. A message without a known parent begins a conversation; a loop of parents is cut
    above its smallest message. Rows that repeat a msg_id are messages of their own, replies go to the first by
    role, text. Null ids are ids like others. Empty input gives no rows; other columns are ignored. A path is one
    row, so it must fit into memory, as its conversation must; trees need not.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    copy = Window.partitionBy("tree", "id").orderBy("role", "text", "parent_id", "score")
    nodes = messages.select(
        "tree_id", "msg_id", "parent_id", "role", "text", score.alias("score"), _key(F.col("tree_id")).alias("tree"),
        _key(F.col("msg_id")).alias("id"))
    nodes = nodes.withColumn("copy", F.row_number().over(copy)).select(
        "*", _key(F.col("msg_id"), F.col("copy")).alias("node"),
        F.when(F.col("parent_id").isNotNull(), _key(F.col("parent_id"), F.lit(1))).alias("above"))
    nodes = staged(nodes, "messages")
    paths = staged(reply_paths(nodes.select("tree", "node", "above")), "paths")

    scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.avg("score").alias("path_score"))
    best = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        best = best.filter(F.col("rank") <= top)
    role = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c"))
    turns = paths.join(best, ["tree", "leaf"]).join(
        nodes.select("tree", "node", "tree_id", "msg_id", "role", escaped(F.col("text")).alias("body"), role.alias("shown")),
        ["tree", "node"])
    head = F.concat(F.lit(HEAD), F.col("shown"), F.lit(": "))
    turns = turns.select(
        "tree", "leaf", "up", "tree_id", "msg_id", "path_score", "rank", F.col("role").eqNullSafe(loss_role).alias("loss"),
        F.concat(head, F.col("body"), F.lit(f"{END}\n")).alias("piece"), F.length(head).alias("lead"),
        F.length("body").alias("chars"))
    in_path = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.length("piece")).over(in_path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + F.col("lead"))
    turn = F.struct((-F.col("up")).alias("at"), "piece", "loss", "start", F.col("chars").cast("long").alias("length"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"), F.max_by("msg_id", -F.col("up")).alias("leaf_id"),
        F.first("path_score").alias("score"), F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(turn)).alias("turns"))
    masked = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select(
        "tree_id", "leaf_id", "score", "rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), masked.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both taken from ``formatted`` and ``spans`` alone."""
    whole = F.col("formatted")
    pieces = F.filter(F.split(whole, f"{END}\n"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substr(F.substring_index(p, ": ", 1), F.lit(len(HEAD) + 1))).alias("role"),
        unescaped(F.substr(p, F.instr(p, ": ") + 2)).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescaped(
        F.substr(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def threads_of(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without branches; equal turns follow by role, text."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").alias("tree_id"), at.cast("long").alias("msg_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
