"""Reply trees to conversations, with DataFrame operations only.

Self-joins over (node, ancestor at distance 2^k) enumerate all root-to-leaf paths in a number of
rounds that grows with the logarithm of the depth; branches are ranked by score, and each chosen
path is formatted as one conversation with the spans that a loss may look at.

Template: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n`` per turn. Inside roles and texts ``&``
is written ``&amp;`` and ``<|`` is written ``&lt;|`` (in roles a line end is ``&nl;``), which can be
undone exactly, so no text can forge a turn.

Defined cases: null roles and texts are empty; nodes whose parent is missing or null are roots; cycles
raise an error; rows of a conversation with equal turns
are ordered by role and text; a null conversation id is one conversation; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def paths(nodes: DataFrame) -> DataFrame:
    """Members of all root-to-leaf paths. nodes: tree, node, parent, score (node unique in its tree).

    Returns tree, leaf, node, up (steps from the leaf)."""
    known = nodes.select("tree", F.col("node").alias("_known"))
    jump = nodes.select("tree", "node", F.col("parent").alias("up"))
    jump = jump.alias("j").join(known.alias("k"), F.col("j.tree").eqNullSafe(F.col("k.tree")) & (F.col("j.up") == F.col("k._known")), "left")
    jump = materialize(jump.select("j.tree", "j.node", F.col("_known").alias("up")), "tree-jump")
    replied = jump.select("tree", F.col("up").alias("node")).filter("node is not null").distinct()
    leaves = nodes.alias("n").join(replied.alias("r"), F.col("n.tree").eqNullSafe(F.col("r.tree")) & (F.col("n.node") == F.col("r.node")), "left_anti")
    members = materialize(leaves.select("n.tree", F.col("n.node").alias("leaf"), F.col("n.node").alias("node"), F.lit(0).cast("long").alias("up")), "tree-members")
    step, rounds = 1, 0
    while jump.filter("up is not null").limit(1).count():
        if (rounds := rounds + 1) > 40:
            raise ValueError("replies form a cycle")
        ahead = jump.filter("up is not null")
        more = members.alias("m").join(ahead.alias("j"), F.col("m.tree").eqNullSafe(F.col("j.tree")) & (F.col("m.node") == F.col("j.node")))
        members = materialize(members.unionByName(more.select("m.tree", "m.leaf", F.col("j.up").alias("node"), (F.col("m.up") + step).alias("up"))), "tree-members")
        twice = ahead.alias("a").join(jump.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        jump = materialize(twice.select("a.tree", "a.node", "b.up"), "tree-jump")
        step *= 2
    return members


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, branch (rank from 1), leaf, position (from 0), node of the ``top`` branches of each tree by mean score, ties by leaf."""
    members = paths(nodes)
    scored = members.alias("m").join(nodes.alias("n"), F.col("m.tree").eqNullSafe(F.col("n.tree")) & (F.col("m.node") == F.col("n.node")))
    branches = scored.select("m.tree", "m.leaf", "m.up", "n.score").groupBy("tree", "leaf").agg(F.avg("score").alias("_score"), F.max("up").alias("_last"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("_score"), "leaf"))
    chosen = branches.withColumn("branch", rank).filter(F.col("branch") <= top)
    out = members.alias("m").join(chosen.alias("c"), F.col("m.tree").eqNullSafe(F.col("c.tree")) & (F.col("m.leaf") == F.col("c.leaf")))
    return out.select("m.tree", "c.branch", "m.leaf", (F.col("c._last") - F.col("m.up")).alias("position"), "m.node")


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formatted, loss_spans (start, length in code points of each assistant text in formatted). turns: keys, position, role, text."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    turn = turns.withColumn("_text", escape(F.coalesce("text", F.lit("")))).withColumn("_head", F.concat(F.lit(START), role, F.lit("\n")))
    rows = turn.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("position", "_head", "_text", (F.coalesce("role", F.lit("")) == "assistant").alias("_loss")))).alias("_turns")
    )
    whole = F.array_join(F.transform("_turns", lambda x: F.concat(x["_head"], x["_text"], F.lit(END))), "")
    # running length up to each turn, then where its text begins
    spans = F.aggregate(
        "_turns",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint,loss:boolean>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["_head"]) + F.length(x["_text"]) + len(END)).cast("long").alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["_head"])).cast("long").alias("start"), F.length(x["_text"]).cast("long").alias("length"), x["_loss"].alias("loss")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return rows.select(*keys, whole.alias("formatted"), F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, turns (role, text), loss_text, from formatted and loss_spans alone."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    body = lambda s: F.substr(s, F.lit(1), F.length(s) - len(END))
    head = lambda s: F.substring_index(s, "\n", 1)
    turns = F.transform(
        F.transform(parts, body),
        lambda s: F.struct(unescape(F.replace(head(s), F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(F.substr(s, F.length(head(s)) + 2)).alias("text")),
    )
    loss = F.array_join(F.transform("loss_spans", lambda p: unescape(F.substr(F.col("formatted"), p["start"].cast("int"), p["length"].cast("int")))), "")
    return formatted.select(*keys, turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score: each row replies to the one before it; the score is the text's length."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def chosen_conversations(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, branch, formatted, loss_spans of the best branches. nodes: tree, node, parent, role, text, score."""
    nodes = materialize(nodes, "tree-nodes")
    best = best_paths(nodes.select("tree", "node", "parent", "score"), top)
    turns = best.alias("b").join(nodes.alias("n"), F.col("b.tree").eqNullSafe(F.col("n.tree")) & (F.col("b.node") == F.col("n.node")))
    return format_turns(turns.select("b.tree", "b.branch", "b.position", "n.role", "n.text"), ["tree", "branch"])
