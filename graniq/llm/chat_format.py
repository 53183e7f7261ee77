"""Chat formatting into budgeted windows, with DataFrame functions alone.

A turn is written ``<|start|>role<|text|>text<|end|>``. Control strings inside roles
and texts get a backslash after their first character, one more where they already have
some, so that a written ``<|`` is always a mark and the texts come back exactly.

Turns are laid end to end by a prefix sum of their tokens; span k has those that end in
the k-th stretch of ``span`` tokens, so spans are turn-aligned. A window is a span's turns
(the targets), preceded by the conversation's first system turn and by the last turns
before the span that fit in ``history`` tokens. Assistant texts of targets are under the
loss mask; repeated turns never are, so each assistant text is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string.
_CONTROL = r"(/?s>|/?INST\]|/?<?/?SYS>>|\|)"
#: Characters that a turn's marks add.
_MARKS = len(START) + len(TEXT) + len(END)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def tokens(text: Column) -> Column:
    """A native estimate of a text's tokens: its words, digits groups and other marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 512, turn_cost: int = 4) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_turns, n_repeated, tokens, loss.

    turns: conv_id, turn, role, text. Rows are taken by turn; ties by role, then text, nulls
    first; repeated rows are turns of their own. A null role or text is empty; rows of a null
    conv_id form one conversation. The first n_repeated of n_turns are the system turn and
    history. loss: array of (start, length) in code points of ``text``, in order.

    The system turn, which every later window repeats, is taken off the budget first; history has
    at most ``history`` tokens and half of what is left, the targets the rest. A window keeps to the
    budget unless a turn has more than half of the targets' tokens: turns are never cut, and such a
    window is longer, as are those of a conversation whose system turn alone exceeds the budget, of
    a turn each. Other columns are ignored. A conversation without rows has no window, and an empty
    table none at all.
    """
    conv = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cost", (tokens(F.col("text")) + turn_cost).cast("long"))
    order = conv.orderBy("turn", "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order), "end": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    system = F.min(F.when(F.col("role") == "system", F.struct("pos", "cost"))).over(conv)
    left = F.greatest(F.lit(budget) - F.coalesce(system["cost"], F.lit(0)), F.lit(2))
    rows = rows.withColumns({"system": F.coalesce(F.col("pos") == system["pos"], F.lit(False)), "kept": F.least(F.lit(history), F.floor(left / 2)), "left": left})
    rows = rows.withColumns({"begin": F.col("end") - F.col("cost"), "stretch": F.floor((F.col("end") - 1) / F.greatest(F.lit(1), F.floor((F.col("left") - F.col("kept")) / 2)))})
    by_pos = conv.orderBy("pos")
    rows = rows.withColumn("first", F.coalesce(F.lag("stretch").over(by_pos) != F.col("stretch"), F.lit(True)))
    rows = rows.withColumn("span", F.sum(F.col("first").cast("int")).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # Spans that begin within the history's tokens after this turn's beginning repeat it.
    ahead = conv.orderBy("begin").rangeBetween(1, history)
    rows = rows.withColumns({"later": F.collect_set(F.when(F.col("first"), F.struct("span", "begin"))).over(ahead), "last": F.max("span").over(conv)})
    near = F.transform(F.filter("later", lambda s: (s["span"] > F.col("span")) & (s["begin"] - F.col("begin") <= F.col("kept"))), lambda s: s["span"])
    later = F.when(F.col("system") & (F.col("last") > F.col("span")), F.sequence(F.col("span") + 1, F.col("last"))).when(F.col("system"), F.array().cast("array<bigint>")).otherwise(near)
    rows = rows.withColumn("window", F.explode(F.concat(F.array("span"), later)))
    rows = rows.withColumns({"target": F.col("window") == F.col("span"), "piece": F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))})
    in_window = Window.partitionBy("conv_id", "window").orderBy("pos")
    size = F.length("piece").cast("long")
    rows = rows.withColumns({"size": size, "at": F.sum(size).over(in_window.rowsBetween(Window.unboundedPreceding, 0)) - size})
    learned = F.col("target") & (F.col("role") == "assistant")
    start = F.col("at") + len(START) + F.length(escape(F.col("role"))) + len(TEXT)
    loss = F.when(learned, F.struct(start.alias("start"), (F.col("size") - _MARKS - F.length(escape(F.col("role")))).alias("length")))
    return rows.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.count("*").alias("n_turns"),
        F.count_if(~F.col("target")).alias("n_repeated"),
        F.sum("cost").alias("tokens"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its windows alone: conv_id, turns (array of role and text, each turn once), losses (array of the texts under the loss mask), chars."""
    pieces = F.slice(F.split("text", r"<\|end\|>", -1), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    parts = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|text\|>", -1))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    losses = F.transform("loss", lambda x: unescape(F.substr("text", (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    each = windows.select("conv_id", F.struct("window", turns.alias("turns"), losses.alias("losses")).alias("w"), F.length("text").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("chars"))
    return whole.select("conv_id", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("ws", lambda w: w["losses"])).alias("losses"), "chars")
