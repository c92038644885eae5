"""Chat formatting of reply trees.

A message names the one it answers. Paths from the root to each leaf come from self-joins with doubling reach: after k
rounds every leaf knows its ancestors at distances below 2**k, so a tree of depth d takes about log2(d) joins and no
list is carried along. The paths of a tree are ranked by the score of their messages, and each chosen one becomes one
conversation: pieces and their offsets are computed row by row, and only the finished pieces of a path meet.

The template marks a turn as ``<s>role newline text</s>``. Inside roles and texts ``<`` and ``[`` (which open every
control string, also ``[INST]``), and the escape sign ``\\`` itself, are written as ``\\1``, ``\\2`` and ``\\0``, and in
roles a newline as ``\\3``; so the marks are never part of a text and all of it can be read back.

Only built-in column functions and joins. Defined results: null texts and roles are empty; turns of equal number are
ordered by role and text, null numbers last; rows with a null conversation form one of their own; a message whose chain
never reaches a root is in no path; of repeated message ids the smallest by parent, role and text counts; repeated
turns are turns of their own; empty tables give none. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timepoint.llm.common import column, written

BEGIN, END = "<s>", "</s>"
#: Sign and its code, in the order of escaping; read back the other way round.
CODES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("\n", "\\3")]
TREE = "tree"


def escape(text: Column, *, line: bool = False) -> Column:
    for sign, code in CODES if line else CODES[:-1]:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    # An escape sign in an escaped text always begins a code, and the sign itself comes back last.
    for sign, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def messages_of_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A chain for each conversation: every turn answers the one before it."""
    plain = turns.select(
        column(turns, conv_id).alias("conv_id"), column(turns, turn).alias("turn"),
        F.coalesce(column(turns, role), F.lit("")).alias("role"), F.coalesce(column(turns, text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    at = F.row_number().over(order).cast("long")
    return plain.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias(TREE), "conv_id", at.alias("message"),
        F.when(at > 1, at - 1).alias("parent"), "role", "text", (F.col("role") == "assistant").cast("double").alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, above) of each root-to-leaf path, ``above`` being the distance from the leaf.

    ``messages`` has tree (text, not null), message and parent; a parent that is null or no message is above a root.
    """
    nodes = messages.select(TREE, "message", "parent").where(F.col("message").isNotNull())
    nodes = written(nodes.groupBy(TREE, "message").agg(F.min("parent").alias("parent")), "nodes")
    known = nodes.select(TREE, F.col("message").alias("parent"))
    jumps = written(nodes.where("parent is not null").join(known, [TREE, "parent"], "left_semi"), "jumps")
    inner = jumps.select(TREE, F.col("parent").alias("message")).distinct()
    leaves = nodes.join(inner, [TREE, "message"], "left_anti")
    reached = written(leaves.select(TREE, F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("above")), "paths")
    roots = nodes.join(jumps.select(TREE, "message"), [TREE, "message"], "left_anti").select(TREE, "message")
    reach, most = 1, nodes.count()
    while reach <= most and not jumps.isEmpty():
        up = jumps.select(TREE, "message", F.col("parent").alias("next"))
        further = reached.join(up, [TREE, "message"]).select(TREE, "leaf", F.col("next").alias("message"), (F.col("above") + reach).alias("above"))
        reached = written(reached.unionByName(further), "paths")
        twice = up.select(TREE, "message", F.col("next").alias("parent")).join(
            up.select(TREE, F.col("message").alias("parent"), F.col("next").alias("beyond")), [TREE, "parent"]
        )
        jumps = written(twice.select(TREE, "message", F.col("beyond").alias("parent")), "jumps")
        reach *= 2
    whole = reached.join(roots, [TREE, "message"]).select(TREE, "leaf")
    return reached.join(whole, [TREE, "leaf"], "left_semi")


def conversations(messages: DataFrame, *, per_tree: int | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The formatted paths: tree, leaf, rank, formatted, and loss (start from 1 and length of each trained text).

    Paths of a tree are ranked by the sum of their messages' scores, then by leaf; ``per_tree`` keeps the best.
    """
    smallest = messages.groupBy(TREE, "message").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    said = smallest.select(TREE, "message", "m.parent", "m.role", "m.text", "m.score")
    on_path = paths(said).join(said.drop("parent"), [TREE, "message"])
    if per_tree is not None:
        best = Window.partitionBy(TREE).orderBy(F.col("score").desc(), "leaf")
        ranked = on_path.groupBy(TREE, "leaf").agg(F.sum("score").alias("score")).withColumn("rank", F.row_number().over(best))
        on_path = on_path.join(ranked.where(F.col("rank") <= per_tree).select(TREE, "leaf"), [TREE, "leaf"], "left_semi")
    head = F.concat(F.lit(BEGIN), escape(F.col("role"), line=True), F.lit("\n"))
    pieces = on_path.select(
        TREE, "leaf", "above", "score", F.col("role").isin(*trained).alias("trained"),
        F.length(head).cast("long").alias("head"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"),
    )
    along = Window.partitionBy(TREE, "leaf").orderBy(F.col("above").desc())
    length = F.length("piece").cast("long")
    before = F.sum(length).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    span = F.struct((before + F.col("head") + 1).alias("start"), (length - F.col("head") - len(END)).alias("length"))
    placed = pieces.select(TREE, "leaf", "score", (-F.col("above")).alias("at"), "piece", F.when(F.col("trained"), span).alias("span"))
    joined = placed.groupBy(TREE, "leaf").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", "span"))).alias("pieces"), F.sum("score").alias("score")
    )
    rank = F.row_number().over(Window.partitionBy(TREE).orderBy(F.col("score").desc(), "leaf"))
    return joined.select(
        TREE, "leaf", rank.alias("rank"), F.array_join("pieces.piece", "").alias("formatted"), F.array_compact("pieces.span").alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """Role and text of each turn, read back."""
    marked = F.split(formatted, F.lit(END))  # the marks cannot occur inside; the last part is empty
    inner = F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), lambda t: F.substring(t, F.lit(len(BEGIN) + 1), F.length(t)))
    return F.transform(
        inner,
        lambda t: F.struct(
            unescape(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, read back."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
