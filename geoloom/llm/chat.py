"""Reply trees as conversations, with DataFrame operations only.

A message names the message it replies to. Jump tables, made by joining a table with itself, lead 1, 2, 4, ... replies
up; from each leaf they enumerate its path to the root in as many joins as the depth has binary digits. Paths are
ranked by score, and each chosen one becomes one conversation:

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so control strings occur only as marks; in a
role a newline gets a backslash before it. One backslash less gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

#: The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, leaf, node, up): every message on the path from each leaf to its root, up replies above the leaf.

    messages: conv_id, msg_id (unique within conv_id), parent_id. A parent that is not there counts as none. Messages
    on a cycle of replies, and those below it, have no root; the jumps end when they would be longer than the
    conversation, and what hangs on a cycle is left out."""
    nodes = messages.select("conv_id", "msg_id", "parent_id")
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id"))
    jump = scratch.write(nodes.join(known, ["conv_id", "parent_id"]).select("conv_id", F.col("msg_id").alias("node"), F.col("parent_id").alias("to")), "jump0")
    parents = jump.select("conv_id", F.col("to").alias("msg_id")).distinct()
    found = nodes.join(parents, ["conv_id", "msg_id"], "left_anti").select("conv_id", F.col("msg_id").alias("leaf"), F.col("msg_id").alias("node"), F.lit(0).cast("long").alias("up"))
    most = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while 2 ** len(jumps) < most and not jump.isEmpty():
        jumps.append(jump)
        a, b = jump.alias("a"), jump.alias("b")
        jump = scratch.write(
            a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.to") == F.col("b.node"))).select(
                F.col("a.conv_id").alias("conv_id"), F.col("a.node").alias("node"), F.col("b.to").alias("to")
            ),
            f"jump{len(jumps)}",
        )
    for k in reversed(range(len(jumps))):
        up = found.join(jumps[k], ["conv_id", "node"]).select("conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = found.unionByName(up)
        if k % 4 == 0:
            found = scratch.write(found, f"paths{k}")
    return found


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen branch: conv_id, leaf, rank, score, n_turns, formatted, loss_spans.

    messages: conv_id, msg_id, parent_id, role, text, score. A branch is a path from a root to a leaf; within a
    conversation branches are ranked by the sum of their scores, larger first, ties by the smaller leaf, and the first
    `branches` of them are formatted (None: all). loss_spans lists the assistant texts in order: start and chars in
    code points of formatted, byte_start and bytes in its UTF-8.

    A null text or role is empty and a null score is 0. A null conv_id or msg_id takes no part. Of rows that repeat
    (conv_id, msg_id) the first in the order of role, text, parent and score counts. Other columns are ignored. An
    empty table gives an empty result."""
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("msg_id").cast("long").alias("msg_id"),
        F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).where("conv_id is not null and msg_id is not null")
    rows = rows.groupBy("conv_id", "msg_id").agg(F.min(F.struct("role", "text", "parent_id", "score")).alias("m")).select("conv_id", "msg_id", "m.*")
    rows = scratch.write(rows, "messages")
    found = scratch.write(paths(rows, scratch), "paths")
    scored = found.join(rows.select("conv_id", F.col("msg_id").alias("node"), "score"), ["conv_id", "node"])
    ranked = scored.groupBy("conv_id", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"))
    ranked = ranked.selectExpr("*", "row_number() over (partition by conv_id order by score desc, leaf) as rank")
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, body = F.concat(F.lit(BEGIN), role, F.lit("\n")), escape(F.col("text"))
    parts = rows.select(
        "conv_id", F.col("msg_id").alias("node"), F.concat(head, body, F.lit(END)).alias("turn"),
        (F.col("role") == "assistant").alias("loss"), F.char_length(head).cast("long").alias("hc"), F.octet_length(head).cast("long").alias("hb"),
        F.char_length(body).cast("long").alias("bc"), F.octet_length(body).cast("long").alias("bb"),
    )
    turns = found.join(ranked, ["conv_id", "leaf"]).join(parts, ["conv_id", "node"])
    before = "over (partition by conv_id, leaf order by up desc rows between unbounded preceding and 1 preceding)"
    turns = turns.selectExpr(
        "*", f"coalesce(sum(char_length(turn)) {before}, 0) + hc as start", f"coalesce(sum(octet_length(turn)) {before}, 0) + hb as byte_start"
    )
    span = F.when(F.col("loss"), F.struct("start", F.col("bc").alias("chars"), "byte_start", F.col("bb").alias("bytes")))
    whole = turns.groupBy("conv_id", "leaf", "rank", "score", "n_turns").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn"))).alias("turns"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )
    return whole.select("conv_id", "leaf", "rank", "score", "n_turns", F.array_join("turns.turn", "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, as they were before formatting."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(BEGIN) + 1, 2**31 - 1))

    def turn(p):
        role = F.regexp_extract(p, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        text = F.regexp_replace(p, r"(?s)^(?:[^\\\n]++|\\.)*+\n", "")
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(body, turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The assistant texts under the loss mask, unescaped: array<string>. The bytes are bound once to a lambda's
    variable, so that each span costs its own length only."""
    cut = F.transform(
        F.array(formatted.cast("binary")),
        lambda b: F.transform(spans, lambda s: unescape(F.substring(b, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))),
    )
    return F.get(cut, F.lit(0))
