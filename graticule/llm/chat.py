"""Reply trees to formatted conversations, with built-in functions only.

Messages of a tree point to the message they answer.  Iterative self-joins double the
distance of each message's ancestor pointer, which gives its depth and the mean score
of its path from the root in a logarithmic number of rounds.  The root-to-leaf paths of
a tree are ranked by that score (then by length, longer first, then by leaf), the best
``keep`` are chosen (all, if None), and the same pointers, applied from the largest
distance to the smallest, list the messages of the chosen paths.

A message without a parent, or whose parent is not in the tree, is a root.  Rows that
repeat a message id count once: the row that sorts first by parent, role, text and score
stays.  Messages on a cycle reach no root and belong to no path.  A null id of a tree is
a tree of its own; messages with a null id belong to no path.  A null score counts 0,
a null role or text is empty.

Template of a turn: ``<s>[INST] role [/INST]text</s>``.  Inside roles and texts a
backslash is doubled and one is put after the first character of each control string,
so that none is left; dropping one backslash of each pair and each single one restores
the text.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.llm.common import named
from graticule.session import durable

# The control strings of the template.
OPEN, CLOSE, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE, HEAD, TAIL):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pointers(nodes: DataFrame):
    """Tables of pointers at distances 1, 2, 4, ... and the resolved messages.

    A row holds (tree, node, up, hops, total): ``up`` is the ancestor ``hops`` above and
    ``total`` the scores from the node up to, and without, that ancestor.
    """
    state = durable(nodes.select(
        "tree", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("hops"),
        F.col("score").alias("total")))
    levels = [state]
    waiting = state.where(F.col("up").isNotNull()).count()
    while waiting:
        above = state.select(
            F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"),
            F.col("hops").alias("_hops"), F.col("total").alias("_total"))
        moving = state.where(F.col("up").isNotNull()).join(
            above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node")))
        state = durable(moving.select(
            "tree", "node", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"),
            (F.col("total") + F.col("_total")).alias("total"),
        ).union(state.where(F.col("up").isNull())))
        levels.append(state)
        still = state.where(F.col("up").isNotNull()).count()
        if still == waiting:  # a round that reaches no root has only cycles left
            break
        waiting = still
    return levels, state.where(F.col("up").isNull()).select("tree", "node", "hops", "total")


def best_paths(messages: DataFrame, tree="tree", node="node", parent="parent", score=None, keep=1):
    """(tree, leaf, node, step, branch): messages of the chosen paths, in order.

    ``step`` counts from 0 at the root, ``branch`` ranks the tree's paths from 1.
    """
    rows = messages.select(
        named(tree).alias("tree"), named(node).alias("node"), named(parent).alias("parent"),
        F.coalesce(named(score).cast("double"), F.lit(0.0)).alias("score") if score
        else F.lit(0.0).alias("score")).where(F.col("node").isNotNull())
    rows = rows.groupBy("tree", "node").agg(
        F.min(F.struct("parent", "score")).alias("r")).select("tree", "node", "r.*")
    known = rows.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    nodes = durable(rows.join(
        known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")), "left",
    ).select("tree", "node", F.col("_node").alias("parent"), "score"))
    levels, rooted = _pointers(nodes)
    answered = nodes.where(F.col("parent").isNotNull()).select(
        F.col("tree").alias("_tree"), F.col("parent").alias("_node")).distinct()
    leaves = rooted.join(
        answered, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")),
        "left_anti")
    order = Window.partitionBy("tree").orderBy(
        (F.col("total") / F.col("hops")).desc(), F.col("hops").desc(), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("branch") <= keep)
    # hops counts the root's missing parent too, so a path has that many messages
    paths = ranked.select(
        "tree", F.col("node").alias("leaf"), "branch", "node", (F.col("hops") - 1).alias("step"))
    # the last table has no pointer left, or only those of cycles
    for k in range(len(levels) - 2, -1, -1):
        up = levels[k].where(F.col("up").isNotNull()).select(
            F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        higher = paths.join(
            up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node"))
        ).select("tree", "leaf", "branch", F.col("_up").alias("node"),
                 (F.col("step") - (1 << k)).alias("step"))
        # written each time: the plan would double otherwise
        paths = durable(paths.union(higher))
    return paths


def format_paths(paths: DataFrame, messages: DataFrame, tree="tree", node="node", role="role",
                 text="text", parent="parent", score=None, loss_role="assistant") -> DataFrame:
    """(tree, leaf, branch, formatted, spans): one row per path.

    ``spans`` are the code point ranges (start, length) of the texts to learn, those of
    ``loss_role``, in ``formatted``.
    """
    first = [named(parent), F.coalesce(named(score).cast("double"), F.lit(0.0)) if score
             else F.lit(0.0)]
    said = messages.where(named(node).isNotNull()).groupBy(
        named(tree).alias("_tree"), named(node).alias("_node")).agg(
        F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(first)],
                       named(role).alias("role"), named(text).alias("text"))).alias("m"))
    turns = paths.join(
        said, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node"))
    ).select(
        "tree", "leaf", "branch", "step",
        F.concat(F.lit(OPEN + HEAD + " "), escape(F.col("m.role")), F.lit(" " + TAIL)).alias("head"),
        escape(F.col("m.text")).alias("body"),
        (F.coalesce("m.role", F.lit("")) == loss_role).alias("learn"))
    whole = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("tree", "leaf", "branch").orderBy("step").rowsBetween(
        Window.unboundedPreceding, -1)
    turns = turns.withColumn(
        "start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.char_length("head"))
    turn = F.struct(
        "step", F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
        F.when(F.col("learn"), F.struct(
            F.col("start").cast("bigint").alias("start"),
            F.char_length("body").cast("bigint").alias("length"))).alias("span"))
    grouped = turns.groupBy("tree", "leaf", "branch").agg(
        F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select(
        "tree", "leaf", "branch",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("spans"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) read from a formatted conversation."""
    turns = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def parse(turn):
        end = F.locate(TAIL, turn)
        begin = len(OPEN + HEAD) + 2
        return F.struct(
            unescape(F.substring(turn, F.lit(begin), end - 1 - begin)).alias("role"),
            unescape(F.substring(turn, end + len(TAIL), F.char_length(turn))).alias("text"))

    return F.transform(turns, parse)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def turns_as_tree(rows: DataFrame, conversation="conv_id", turn="turn", role="role", text="text"):
    """Rows by turn as trees of one branch: each message answers the one before it.

    Rows of a conversation are numbered by turn (null first), then role and text, so
    repeated turns and null turns have a place each.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return rows.select(
        named(conversation).alias("tree"), named(turn).alias("turn"), named(role).alias("role"),
        named(text).alias("text")).withColumn("node", F.row_number().over(order).cast("bigint")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def format_turns(rows: DataFrame, conversation="conv_id", turn="turn", role="role", text="text"):
    """One formatted conversation per conversation of a table by turns."""
    tree = durable(turns_as_tree(rows, conversation, turn, role, text))
    return format_paths(best_paths(tree), tree)
