"""Operator 7, chat formatting of reply trees.

Native: DataFrame functions only. Paths from leaves to roots come from
self-joins with doubling steps: level k joins every path row to the ancestor
2^k steps up, so a tree of depth d takes log2(d) joins, and each level adds
only new path rows. Branches are ranked by the sum of their nodes'
scores, and each chosen path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts
and roles, ``<``, any backslashes and ``|`` in a row get one more backslash,
so no control string remains and the step can be undone; in roles, ``%`` and
line breaks are written as %25 and %0A. ``loss_mask`` lists the assistant
texts as (start, length) in bytes of the UTF-8 output, in order.

Defined results: null texts and roles are empty; rows of one conversation and
turn are ordered by role and text, repeated rows stay; a null conversation id
is a conversation of its own; a parent that does not exist makes a root;
nodes that only lead into a cycle have no path. Node ids are unique within a
conversation. One conversation's output is one string, so its texts meet in
one row; all that goes before moves keys only, spread by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from civicspark.llm.common import materialize, q

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, node, parent, role, text, score): each row replies to the one
    before it in its conversation."""
    body = rows.select(q(conv).alias("conv"), q(turn).alias("turn"), F.coalesce(q(role), F.lit("")).alias("role"), F.coalesce(q(text), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    return body.select("conv", node.alias("node"), "role", "text").select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(keys: DataFrame) -> DataFrame:
    """(conv, leaf, node, up) for every node on the way from each leaf to its
    root, ``up`` steps above the leaf. ``keys``: (conv, node, parent)."""
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    step = materialize(keys.alias("c").join(keys.alias("p"), same("c", "p") & (F.col("c.parent") == F.col("p.node")), "left_semi")
                       .select("conv", "node", F.col("parent").alias("top")), "chat-step")
    out = materialize(keys.alias("k").join(step.alias("s"), same("k", "s") & (F.col("k.node") == F.col("s.top")), "left_anti").select(
        "conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    largest = keys.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < largest and not step.isEmpty():
        more = out.alias("p").join(step.alias("s"), same("p", "s") & (F.col("p.node") == F.col("s.node")))
        out = out.unionByName(materialize(more.select("p.conv", "p.leaf", F.col("s.top").alias("node"), (F.col("p.up") + reach).alias("up")), "chat-paths"))
        step = materialize(step.alias("a").join(step.alias("b"), same("a", "b") & (F.col("a.top") == F.col("b.node")))
                           .select(F.col("a.conv").alias("conv"), F.col("a.node").alias("node"), F.col("b.top").alias("top")), "chat-step")
        reach *= 2
    return out


def format_chats(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv, leaf, rank, score, n_turns, formatted, loss_mask) of the
    ``branches`` best paths of each conversation (None: all of them), from
    (conv, node, parent, role, text, score); ties go to the smaller leaf."""
    nodes = materialize(nodes, "chat-nodes")
    way = paths(nodes.select("conv", "node", "parent"))
    same = F.col("w.conv").eqNullSafe(F.col("n.conv")) & (F.col("w.node") == F.col("n.node"))
    ranked = (way.alias("w").join(nodes.select("conv", "node", "parent", "score").alias("n"), same)
              .groupBy(F.col("w.conv").alias("conv"), "leaf")
              .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("up").alias("last"), F.count(F.lit(1)).alias("n")))
    ranked = ranked.filter(F.col("last") + 1 == F.col("n")).select(
        "conv", "leaf", "score", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")).alias("rank"))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    chosen = way.alias("p").join(ranked.alias("r"), F.col("p.conv").eqNullSafe(F.col("r.conv")) & (F.col("p.leaf") == F.col("r.leaf"))).select(
        F.col("p.conv").alias("conv"), F.col("p.leaf").alias("leaf"), "node", "up", "score", "rank")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = (chosen.alias("w").join(nodes.select("conv", "node", "role", "text").alias("n"), same)
             .select(F.col("w.conv").alias("conv"), "leaf", "rank", F.col("w.score").alias("score"), "up", "role", head.alias("head"), escape(F.col("text")).alias("body")))
    order = Window.partitionBy("conv", "leaf").orderBy(F.desc("up"))
    size = (F.octet_length("head") + F.octet_length("body") + len(END) + 1).cast("long")
    placed = turns.withColumn("start", F.sum(size).over(order) - size + F.octet_length("head"))
    made = placed.groupBy("conv", "leaf").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
                                             (F.col("role") == "assistant").alias("loss"), F.octet_length("body").cast("long").alias("length")))).alias("t"))
    return made.select(
        "conv", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"), F.array_join("t.turn", "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"])).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from an output string."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), lambda t: F.substr(t, F.lit(len(START) + 1)))
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(bodies, lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(F.substr(b, F.length(role(b)) + 2)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    raw = F.encode(formatted, "UTF-8")
    cut = F.transform(mask, lambda m: unescape(F.decode(F.substr(raw, (m["start"] + 1).cast("int"), m["length"].cast("int")), "UTF-8")))
    return F.array_join(cut, "")
