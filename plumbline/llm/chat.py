"""Chat formatting over reply trees, in DataFrame functions only.

A *message* has a tree, an id within the tree, the id of the message it replies
to (null for a root), a role, a text and a score. Every root-to-leaf path is one
conversation. Branches are ranked by score at each message; the path that takes
the best branch everywhere has rank key [1, 1, ...], and paths are ordered by
that key.

Paths are found by iterative self-joins that double the distance: after round i
each message knows its ancestor 2^i levels up, and each leaf all its ancestors
less than 2^(i+1) levels up. A chain of n messages takes log2(n) rounds.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts ``<``, any number of backslashes, ``|`` gets one backslash more; inside roles
``%`` and line feed first become ``%25`` and ``%0A``. So the marks of the template
never occur in them and both are read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import durable

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before.

    Turns are put in order of ``turn``, then role and text (nulls first), so
    repeated turn numbers and repeated rows keep their rows. Rows without a
    conversation id form one conversation of their own.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    at = F.row_number().over(order)
    return turns.select(
        F.col(conv_col).alias("tree"), at.cast("bigint").alias("id"), F.when(at > 1, (at - 1).cast("bigint")).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def rooted(messages: DataFrame) -> DataFrame:
    """``messages`` with a null parent where the parent is missing: such a message is a root."""
    known = messages.select(F.col("tree").alias("t2"), F.col("id").alias("i2"))
    here = messages.select("tree", "id", "parent", "role", "text", "score")
    found = here.join(known, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("i2")), "left")
    return found.select("tree", "id", F.col("i2").alias("parent"), "role", "text", "score")


def ranked_branches(messages: DataFrame) -> DataFrame:
    """Adds ``rank``: 1 for the best reply to the same message, and for the best
    root of a tree, by score, then id."""
    order = Window.partitionBy("tree", "parent").orderBy(F.desc_nulls_last("score"), "id")
    return messages.withColumn("rank", F.row_number().over(order))


def _ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every leaf with itself (up 0) and all its ancestors.

    A parent that leads back to the message itself is an error, found when the
    rounds do not end.
    """
    jump = nodes.select("tree", "id", F.col("parent").alias("above"))
    replied = jump.where("above IS NOT NULL").select(F.col("tree").alias("t2"), F.col("above").alias("i2")).distinct()
    reached = jump.join(replied, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("id") == F.col("i2")), "left_anti").select(
        "tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("up")
    )
    jump = jump.where("above IS NOT NULL")
    for i in range(MAX_ROUNDS):
        links = jump.select(F.col("tree").alias("t2"), F.col("id").alias("i2"), "above")
        higher = reached.join(links, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("i2"))).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**i).alias("up")
        )
        reached = durable(reached.unionByName(higher))
        second = links.select("t2", "i2", F.col("above").alias("above2"))
        jump = durable(
            jump.join(second, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("above") == F.col("i2")))
            .select("tree", "id", F.col("above2").alias("above"))
        )
        if jump.isEmpty():
            return reached
    raise ValueError("replies form a cycle")


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, path, turns): one row per root-to-leaf path, turns from the
    root as array<struct<role, text>>; null roles and texts become empty.

    ``path`` numbers the paths of a tree from the best. ``best`` keeps that many
    of each tree. (tree, id) must be unique; see ``chain`` for rows without ids.
    """
    ranked = durable(ranked_branches(rooted(messages)))
    lines = _ancestors(ranked).join(
        ranked.select(F.col("tree").alias("t2"), F.col("id").alias("i2"), "rank", "role", "text"),
        F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("i2")),
    )
    turn = F.struct(
        (-F.col("up")).alias("at"), "rank", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    paths = lines.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    order = Window.partitionBy("tree").orderBy(F.col("turns")["rank"], "leaf")
    out = paths.withColumn("path", F.row_number().over(order))
    if best is not None:
        out = out.where(F.col("path") <= best)
    return out.select("tree", "leaf", "path", F.expr("transform(turns, x -> struct(x.role AS role, x.text AS text))").alias("turns"))


def formatted(paths: DataFrame) -> DataFrame:
    """Adds ``formatted``, the text of the template, and ``loss_spans``: the
    code-point spans [s, e) (from 0) that hold texts of the role ``assistant``."""
    parts = F.transform(
        "turns",
        lambda x: F.struct(
            F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"),
            (x["role"] == LOSS_ROLE).alias("loss"),
        ),
    )
    ends = F.expr(
        f"aggregate(parts, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + length(x.head) + length(x.body) + {len(END)})))"
    )
    spans = F.expr(
        "filter(transform(parts, (x, i) -> struct(x.loss AS loss, ends[i] + length(x.head) AS s, ends[i] + length(x.head) + length(x.body) AS e)), x -> x.loss)"
    )
    return (
        paths.withColumn("parts", parts).withColumn("ends", ends)
        .withColumn("formatted", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
        .withColumn("loss_spans", F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        .drop("parts", "ends")
    )


def parsed(texts: DataFrame) -> DataFrame:
    """Adds, from ``formatted`` and ``loss_spans`` alone, ``turns`` as they were
    before formatting and ``loss_texts``, the unescaped texts under the loss mask."""
    pieces = F.expr(r"filter(split(formatted, '<\\|im_end\\|>\n'), x -> x <> '')")
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substr(F.substring_index(x, "\n", 1), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda x: unescape(F.substr("formatted", (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))
    return texts.withColumn("turns", turns).withColumn("loss_texts", loss)
