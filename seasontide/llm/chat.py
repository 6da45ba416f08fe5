r"""Chat formatting of reply trees.

Messages point to the message they reply to. Self-joins double the distance
that each pointer spans, so that a tree of depth d takes log2(d) rounds; paths
from chosen leaves to the root are then expanded by the same pointers, from the
longest to the shortest. Branches rank by score, and each chosen path becomes
one conversation.

The template of a turn is ``### role:\ntext</turn>\n``. Inside a text a backslash
is put behind each backslash, behind each ``#`` that another follows and behind
the ``<`` of ``</turn>``; so no text holds a control string, and dropping each
escaping backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.llm.common import stored

TURN_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|#(?=#)|<(?=/turn>)", r"$0\\")


def unescape(text: Column) -> Column:
    # every escaped character stands before its backslash
    return F.regexp_replace(text, r"(?s)(.)\\", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(?=\n)", r"$0\\")


def root_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, depth_left, id) for each message on the chosen root-to-leaf paths.

    ``messages`` has tree, id, parent (null or unknown: a root) and score (null: 0).
    Leaves rank by the mean score of their path, ties by the smaller id; the first
    ``branches`` of a tree are chosen (0: all). depth_left is the distance from the
    leaf. A message whose parents form a cycle reaches no root and is left out.
    """
    known = messages.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    steps = stored(
        messages.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left").select(
            "tree", "id", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).alias("len")
        ),
        "replies",
    )
    leaves = messages.select("tree", "id").join(
        messages.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p is not null").distinct(),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")),
        "left_anti",
    )
    # a level holds the messages that had not reached their root before it
    levels, ended, most = [steps], steps.where("up is null"), messages.count()
    while levels[-1].where("up is not null").limit(1).count() and 2 ** (len(levels) - 1) <= most:
        last = levels[-1].where("up is not null")
        above = last.union(ended).select(
            F.col("tree").alias("t"), F.col("id").alias("u"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("len").alias("len2")
        )
        jumped = last.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("u"))).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("len") + F.col("len2")).alias("len")
        )
        levels.append(stored(jumped, "jumps"))
        ended = ended.union(levels[-1].where("up is null"))
    ended = ended.select(F.col("tree").alias("t"), F.col("id").alias("l"), "sum", "len")
    chosen = leaves.join(ended, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("l"))).select(
        "tree", F.col("id").alias("leaf"), (F.col("sum") / F.col("len")).alias("path_score")
    )
    if branches:
        ranked = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
        chosen = chosen.withColumn("branch", F.row_number().over(ranked)).where(F.col("branch") <= branches)
    paths = chosen.select("tree", "leaf", F.lit(0).alias("depth_left"), F.col("leaf").alias("id"))
    for k in range(len(levels) - 2, -1, -1):
        jump = levels[k].where("up is not null").select(F.col("tree").alias("t"), F.col("id").alias("u"), "up")
        far = paths.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("u"))).select(
            "tree", "leaf", (F.col("depth_left") + 2**k).alias("depth_left"), F.col("up").alias("id")
        )
        paths = stored(paths.union(far), "paths")
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_mask): one conversation per chosen path.

    loss_mask lists the (start, length) in code points of each assistant text.
    Null roles and texts are empty. A conversation is one value, as in the output
    format; it is the only thing gathered.
    """
    body = messages.select(
        F.col("tree").alias("t"), F.col("id").alias("i"),
        F.concat(F.lit("### "), escape_role(F.coalesce("role", F.lit(""))), F.lit(":\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
    )
    rows = paths.join(body, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    turns = rows.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth_left")).alias("at"), "head", "body", "learn"))).alias("turns")
    )
    begun = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["head"]) + F.length(t["body"]) + len(TURN_END)).alias("end"),
            F.when(
                t["learn"],
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["end"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))),
                ),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    return turns.select("tree", "leaf", text.alias("formatted"), begun.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array of (role, text)."""
    parts = F.split(formatted, "</turn>\n")
    ended = F.slice(parts, 1, F.size(parts) - 1)
    head = lambda x: F.locate(":\n", x)
    return F.transform(
        ended,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(5), head(x) - 5)).alias("role"),
            unescape(F.substring(x, head(x) + 2, F.length(x))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a reply tree: each turn replies to the one before.

    Equal turns stand in the order of role and text; null turns come first. Rows
    that repeat in full are separate turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order)
    return conversations.select(
        F.col("conv_id").alias("tree"), at.alias("id"), F.when(at > 1, at - 1).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, all derived from the formatted text and its mask."""
    turns = formatted.select("tree", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum([length(x) - 1 FOR x IN regexp_extract_all(text, '#+')]), 0) AS extra
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + extra + 14)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
