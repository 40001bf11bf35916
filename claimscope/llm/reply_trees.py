"""Conversations from reply trees, with DataFrame functions only.

Messages name the message they answer. Self-joins that double the distance each time give every
message its root and the length and score of the path from there, so a thread of n replies
needs about log2(n) joins. Leaves are ranked in their tree by the mean score of their path, the
best ones are chosen, and the same doubled pointers list the messages on the chosen paths. Each
path is formatted as one conversation.

Format of a turn: ``<turn>ROLE<says>TEXT</turn>`` and a newline. ``&``, ``<`` and ``>`` in roles and
texts are written ``&amp;``, ``&lt;`` and ``&gt;``, so no control string can come out of a text and the
text can be read back. The loss mask is a list of spans of the formatted text, in characters,
one for each text of an assistant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope.session import materialise

# fixed values: the control strings of the format
TURN, SAYS, END = "<turn>", "<says>", "</turn>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))

#: The role whose texts are learned.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def chained(rows: DataFrame, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Plain conversations as trees without branches: each row answers the one before it.

    Rows go by turn; rows of one turn by role and text. A null turn comes first; a null role and
    a null text are empty. A null conversation is a conversation of its own.
    """
    said = rows.select(
        rows[conversation_column].alias("tree_id"), rows[turn_column].alias("turn"),
        F.coalesce(rows[role_column], F.lit("")).alias("role"), F.coalesce(rows[text_column], F.lit("")).alias("text"),
    )
    place = F.row_number().over(W.partitionBy("tree_id").orderBy("turn", "role", "text")).cast("long")
    numbered = said.withColumn("message_id", place)
    return numbered.select("tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    condition = a["tree_id"].eqNullSafe(b["tree_id"])
    for x, y in pairs:
        condition = condition & (a[x] == b[y])
    return condition


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The messages on the chosen root-to-leaf paths: tree_id, branch, depth, role, text.

    ``messages`` has tree_id, message_id, parent_id, role, text and score; message ids are unique
    in a tree. branch numbers a tree's paths from 1 by falling mean score (null scores count 0);
    equal ones by leaf id. ``branches`` is how many are taken, None for all. depth counts from 0.
    A message whose parent is missing is a root; one in a circle of parents raises an error.
    """
    messages = materialise(messages.select("tree_id", "message_id", "parent_id", "role", "text", "score"))
    nodes = messages.select("tree_id", "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("message_id").alias("known"))
    nodes = nodes.join(known, nodes["tree_id"].eqNullSafe(known["t"]) & (nodes["parent_id"] == known["known"]), "left")
    # up: the ancestor at distance `reach`, null beyond the root; total and count: of the messages on the way, itself included
    now = materialise(nodes.select("tree_id", "message_id", F.col("known").alias("up"), "score", F.lit(1).cast("long").alias("count"), F.col("score").alias("total")))
    parents = now.filter("up IS NOT NULL").select("tree_id", "message_id", "up")
    pointers, size, reach = [parents], None, 1
    # messages that have come to their root need no further step
    active, finished = now.filter("up IS NOT NULL"), [now.filter("up IS NULL")]
    while not active.isEmpty():
        if size is None:
            size = now.count()
        if reach > size:
            raise ValueError("messages that answer each other in a circle")
        known = reduce(DataFrame.unionAll, finished, active)
        further = known.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("up").alias("further"), F.col("count").alias("c"), F.col("total").alias("s"))
        joined = active.join(further, active["tree_id"].eqNullSafe(further["t"]) & (active["up"] == further["m"]))
        stepped = materialise(
            joined.select("tree_id", "message_id", F.col("further").alias("up"), "score", (F.col("count") + F.col("c")).alias("count"), (F.col("total") + F.col("s")).alias("total"))
        )
        active = stepped.filter("up IS NOT NULL")
        finished.append(stepped.filter("up IS NULL"))
        pointers.append(active.select("tree_id", "message_id", "up"))
        reach *= 2
    now = reduce(DataFrame.unionAll, finished)

    answered = parents.select(F.col("tree_id").alias("t"), F.col("up").alias("answered")).distinct()
    leaves = now.join(answered, now["tree_id"].eqNullSafe(answered["t"]) & (now["message_id"] == answered["answered"]), "left_anti")
    best = W.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("count")), "message_id")
    chosen = leaves.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    # every doubled pointer adds the other half of the messages on the path
    on_path = chosen.select("tree_id", "branch", "message_id", (F.col("count") - 1).alias("depth"))
    for k, pointer in reversed(list(enumerate(pointers))):
        step = pointer.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "up")
        joined = on_path.join(step, on_path["tree_id"].eqNullSafe(step["t"]) & (on_path["message_id"] == step["m"]))
        # written each time: the rows go into both sides of the next step
        on_path = materialise(on_path.unionAll(joined.select("tree_id", "branch", F.col("up").alias("message_id"), (F.col("depth") - (1 << k)).alias("depth"))))
    said = messages.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "role", "text")
    return on_path.join(said, on_path["tree_id"].eqNullSafe(said["t"]) & (on_path["message_id"] == said["m"])).select("tree_id", "branch", "depth", "role", "text")


def formatted(path_rows: DataFrame, learned: str = LEARNED) -> DataFrame:
    """tree_id, branch, formatted, loss_spans (start and length, in characters of formatted)."""
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    turns = path_rows.select(
        "tree_id", "branch", "depth", F.concat(F.lit(TURN), role, F.lit(SAYS)).alias("head"), text.alias("said"),
        F.coalesce(F.col("role") == learned, F.lit(False)).alias("learned"),
    )
    length = F.length("head") + F.length("said") + len(END)
    before = W.partitionBy("tree_id", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head"))
    ordered = F.sort_array(F.collect_list(F.struct("depth", "at", "head", "said", "learned")))
    grouped = turns.groupBy("tree_id", "branch").agg(ordered.alias("turns"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["at"].cast("int").alias("start"), F.length(t["said"]).alias("length")))
    return grouped.select("tree_id", "branch", written.alias("formatted"), spans.alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted conversation says."""
    parts = F.filter(F.split(text, END, -1), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2147483647), SAYS, 1)).alias("role"),
            unescape(F.substring_index(p, SAYS, -1)).alias("text"),
        ),
    )


def read_learned(text: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(text.substr(s["start"] + 1, s["length"]))), "")
