"""Chat formatting with budgeted windows, in DataFrame operations only (operator 3).

Turn tokens get prefix sums inside each conversation. The sums cut a conversation on a grid of the window's budget: a span holds
the turns that lie inside one grid cell, and a turn across a cell's edge opens the next cell's span if both fit, else it
stands alone. So spans are turn-aligned and need no walk along the conversation. Each window holds the system turn, the last
turns of the span before (up to ``history`` tokens) and its own turns. The loss mask covers the assistant texts of its own
turns only: what is repeated is masked out.

Tokens are byte tokens, marks and escapes included: what a byte-level vocabulary without merges gives, and an exact upper bound
for every one with merges. So a window's text never has more bytes than its budget, with two stated exceptions: a turn that leaves no room
for the rest stands in a window with the system turn alone, whatever its length; and a system turn beyond a quarter of the
budget is not repeated but stands in the first window only. Real counts can be given as a column instead.

Prefix sums are taken in two levels (blocks of turns, then turns inside a block), so one conversation with a third of all rows
is many small windows. Texts move twice: to their block and to their windows; all that is worked out between are numbers, written
to the shared folder so that no step is planned or run again for the next, and joined to the blocks at the end.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles every control string gets a backslash after its
first character, and one more where it had some, which is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# fixed values: control strings of common chat templates, without their first character
_CONTROL = r"\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def formatted(role: Column, text: Column) -> tuple[Column, Column]:
    """The header of a turn and all of it."""
    header = F.concat(F.lit(OPEN), escape(role), F.lit("\n"))
    return header, F.concat(header, escape(text), F.lit(CLOSE))


def windows(turns: DataFrame, budget: int = 4096, history: int = 1024, block: int = 256, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, text, loss_mask, turns): the formatted text of each window, numbered in ascending order.

    loss_mask: from, until (code points), idx (number of the turn) of each target. turns: idx, fresh (not repeated). ``tokens`` names a
    column of counts to use in place of byte tokens (null: 0; every turn counts one at least). Turns are taken by turn, then
    role and text (ties, repeated rows; those of one turn number are ordered in one task, which spills). Null roles and texts are empty; a null turn comes
    first; null conv_ids form one conversation. Empty texts are turns. An empty table has no windows. Other columns are not
    read. A text of any length stays whole.
    """
    if history + budget // 4 >= budget:
        raise ValueError("history must be less than three quarters of the budget")
    count = [F.col(tokens).cast("long").alias("tokens")] if tokens else []
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *count)
    count = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1)) if tokens else F.octet_length(formatted(F.col("role"), F.col("text"))[1])
    t = t.withColumn("tokens", count.cast("long")).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    t = t.withColumn("blk", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    place = ["key", "blk"]
    w = Window.partitionBy(*place).orderBy("turn", "role", "text")
    t = t.repartition(*place).withColumn("pos", F.row_number().over(w) - 1).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = t.select(*place, "pos", "tokens", "upto", (F.col("role") == "system").alias("system"))
    n = written(n, "turns")
    # the blocks' sums, and the first turn of the conversation
    head = F.max(F.when(F.col("pos") == 0, F.struct("tokens", "system")))
    sums = n.groupBy(*place).agg(F.sum("tokens").alias("all"), F.count("*").alias("many"), head.alias("head"))
    w = Window.partitionBy("key").orderBy("blk")
    first = F.first("head").over(w)
    sums = sums.select(*place, (F.sum("all").over(w) - F.col("all")).alias("base"), (F.sum("many").over(w) - F.col("many")).alias("n_before"), F.when(first["system"] & (first["tokens"] <= budget // 4), first["tokens"]).alias("repeated"))
    n = n.join(sums, place).withColumn("idx", F.col("n_before") + F.col("pos")).withColumn("before", F.col("base") + F.col("upto") - F.col("tokens"))
    # the system turn stands in every window, so its tokens leave the budget
    n = n.withColumn("room", F.lit(budget - history) - F.coalesce("repeated", F.lit(0))).withColumn("cell", F.floor(F.col("before") / F.col("room")))
    n = n.withColumn("across", F.col("before") + F.col("tokens") > (F.col("cell") + 1) * F.col("room"))
    n = n.withColumn("goal", F.when(F.col("across"), F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room"))).otherwise(F.col("cell")))
    n = written(n.select(*place, "pos", "idx", "tokens", "before", "room", "repeated", "cell", "across", "goal"), "cells")
    # sum of the turns inside each cell, and of the turn that enters it
    cells = n.groupBy("key", "cell").agg(F.sum(F.when(~F.col("across"), F.col("tokens")).otherwise(0)).alias("inside")).withColumnRenamed("cell", "goal")
    n = n.join(cells, ["key", "goal"], "left")
    joins = ~F.col("across") | ((F.col("goal") == F.col("cell") + 1) & (F.col("tokens") + F.coalesce("inside", F.lit(0)) <= F.col("room")))
    n = n.withColumn("window", F.when(joins, 2 * F.col("goal")).otherwise(2 * F.col("cell") + 1))  # lone turns have odd numbers
    n = written(n.select(*place, "pos", "idx", "tokens", "before", "room", "repeated", "window"), "windows")
    # the token at which each span ends, and the span that follows
    spans = n.groupBy("key", "window").agg(F.max(F.col("before") + F.col("tokens")).alias("span_end"), F.max(F.col("tokens") > F.col("room")).alias("wide"))
    w = Window.partitionBy("key").orderBy("window")
    spans = spans.withColumn("next", F.lead(F.when(~F.col("wide"), F.col("window"))).over(w))
    n = n.join(spans, ["key", "window"])
    after = F.when(F.col("span_end") - F.col("before") <= history, F.col("next"))
    dealt = n.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("pos", "idx", "window", after.alias("after"), F.col("repeated").isNotNull().alias("leads")))).alias("dealt"))
    t = t.join(dealt, place).withColumn("at", F.element_at("dealt", F.col("pos") + 1))
    cols = ["key", "conv_id", "role", "text", F.col("at")["idx"].alias("idx"), F.col("at")["window"].alias("own")]
    own = t.select(*cols, F.explode(F.filter(F.array(F.col("at")["window"], F.when(~F.col("at")["leads"] | (F.col("at")["idx"] > 0), F.col("at")["after"])), lambda x: x.isNotNull())).alias("window"))
    lead = t.where((F.col("at")["idx"] == 0) & F.col("at")["leads"]).select(*cols).join(spans.select("key", "window"), "key").where("own <> window")
    every = own.unionByName(lead)
    header, said = formatted(F.col("role"), F.col("text"))
    part = F.struct("idx", said.alias("said"), F.length(header).alias("header"), F.col("role"), (F.col("own") == F.col("window")).alias("fresh"))
    g = every.groupBy("key", "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    text = F.concat_ws("", F.transform("parts", lambda p: p["said"]))
    mask = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<from: int, until: int, idx: bigint>>)").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["said"])).alias("at"),
            F.when(
                p["fresh"] & (p["role"] == "assistant"),
                F.concat(acc["mask"], F.array(F.struct((acc["at"] + p["header"]).alias("from"), (acc["at"] + F.length(p["said"]) - len(CLOSE)).alias("until"), p["idx"].alias("idx")))),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    fresh = F.transform("parts", lambda p: F.struct(p["idx"].alias("idx"), p["fresh"].alias("fresh")))
    return g.select("conv_id", "window", text.alias("text"), mask.alias("loss_mask"), fresh.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from the formatted windows: the turns are split at the marks and unescaped, repeated ones
    passed over; the loss text is cut out by the mask.

    A window's part is one string; SHA-256 then needs all of a conversation in one row, as SQL has no running digest: up to 2 GB of text.
    The windows themselves have no such limit.
    """
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), 2, 2**30)
    turn = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE)))
    said = F.transform(turn, lambda p: F.concat(unescape(F.substring_index(p, "\n", 1)), F.lit("\n"), unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))), F.lit("\n")))
    both = F.filter(F.arrays_zip(F.col("turns").alias("t"), said.alias("s")), lambda x: x["t"]["fresh"])
    w = formatted.select(
        "conv_id", "window", F.length("text").alias("chars"), F.size(F.filter("turns", lambda t: t["fresh"])).alias("n"),
        F.concat_ws("", F.transform(both, lambda x: x["s"])).alias("said"),
        F.concat_ws("", F.transform("loss_mask", lambda m: unescape(F.substring(F.col("text"), m["from"] + 1, m["until"] - m["from"])))).alias("loss"),
    )
    parts = F.sort_array(F.collect_list(F.struct("window", "said", "loss")))
    whole = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss")).alias("loss_chars"), parts.alias("parts"))
    digest = lambda c: F.sha2(F.concat_ws("", F.col("parts")[c]), 256)
    return whole.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")
