"""Chat formatting: conversations cut into budgeted, turn-aligned training windows.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template of a turn: OPEN role MID text END.
OPEN, MID, END = "<s>[INST]", "[/INST]", "</s>"
#: What begins a control string inside a text: its first character is written as an entity.
_ANGLE, _SQUARE = r"<(?=/?s>|<?/?SYS>)", r"\[(?=/?INST\])"
#: Words and single marks count as tokens; so do a turn's four control strings.
_TOKEN, TURN_TOKENS = r"\w+|[^\w\s]", 4
_TURN = "struct<turn:bigint,role:string,text:string>"


def escaped(text: Column) -> Column:
    """The text without control strings: `&` becomes `&amp;`, then their first characters `&lt;` or `&#91;`."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), _ANGLE, "&lt;"), _SQUARE, "&#91;")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def turn_head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(MID))


def format_conversations(turns: DataFrame, *, budget: int = 512, history: int = 128) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted, loss_spans, turn_from, turn_to, history_from, tokens.

    `turns` has conv_id, turn, role, text. Turns go in order of turn (then role, text).
    Prefix sums of their tokens choose the spans: a window takes turns while they fit
    the budget left beside the system turn and its history; a turn is never cut, so one
    that alone exceeds the budget has a window to itself. Each window starts with the
    conversation's system turn (its first turn, if that is one) and the last turns
    before the span that fit `history` tokens. `loss_spans` (start from 1, length; code
    points of `formatted`) mark the assistant texts of the span, not the repeated ones.
    Null texts and roles are empty; a null conv_id is one conversation; an empty table
    gives no rows; other columns are not read. A conversation is one training document
    and is held in one row; only its own turns are gathered there.
    """
    clean = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    cost = F.transform("turns", lambda t: F.regexp_count(t["text"], F.lit(_TOKEN)) + TURN_TOKENS)
    talks = talks.withColumn("cost", cost)
    # sums[k]: tokens of the first k turns, from 0 on
    sums = F.aggregate("cost", F.array(F.lit(0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c)))
    talks = talks.withColumn("sums", sums).withColumn("system", F.when(F.element_at("turns", 1)["role"] == "system", 1).otherwise(0))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("system") == 1, F.element_at("cost", 1)).otherwise(0))
    at = lambda k: F.element_at("sums", k + 1)
    # A span starts where the turns since the last start no longer fit. Turns are counted from 1; a span's start s has s-1 turns before it.
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size("turns")),
        F.array(F.lit(1)),
        lambda s, k: F.when((k > F.element_at(s, -1)) & (at(k) - at(F.element_at(s, -1) - 1) > F.col("room") + F.when(F.element_at(s, -1) == 1, F.col("first")).otherwise(0)), F.concat(s, F.array(k))).otherwise(s),
    )
    # The first span has the system turn among its own turns, and no history.
    first = F.when(F.col("system") == 1, F.element_at("cost", 1)).otherwise(0) + history
    talks = talks.withColumn("room", room).withColumn("first", first).withColumn("starts", starts)
    # Outer, though no list of starts is empty: for an inner one the optimiser infers a filter, and pushing that down puts the sums into the lambda above.
    spans = talks.select("conv_id", "turns", "sums", "system", "starts", F.posexplode_outer("starts").alias("window", "lo"))
    spans = spans.withColumn("hi", F.coalesce(F.try_element_at("starts", F.col("window") + 2) - 1, F.size("turns")))
    # History: from the first turn after the system turn from which the tokens up to the span fit.
    fits = F.filter(F.sequence(F.lit(1), F.col("lo")), lambda k: (k > F.col("system")) & (at(F.col("lo") - 1) - at(k - 1) <= history))
    spans = spans.withColumn("from", F.when(F.col("lo") == 1, 1).otherwise(F.least(F.coalesce(F.try_element_at(fits, F.lit(1)), F.col("lo")), F.col("lo"))))
    shown = F.concat(
        F.when((F.col("system") == 1) & (F.col("from") > 1), F.slice("turns", 1, 1)).otherwise(F.array().cast(f"array<{_TURN}>")),
        F.slice("turns", F.col("from"), F.col("hi") - F.col("from") + 1),
    )
    n_repeated = F.col("lo") - F.col("from") + F.when((F.col("system") == 1) & (F.col("from") > 1), 1).otherwise(0)
    spans = spans.withColumn("repeated", n_repeated).withColumn(
        "parts",
        F.transform(shown, lambda t, i: F.struct(turn_head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), ((t["role"] == "assistant") & (i >= F.col("repeated"))).alias("loss"))),
    )
    walked = F.aggregate(
        "parts",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    system_tokens = F.when((F.col("system") == 1) & (F.col("from") > 1), at(F.lit(1))).otherwise(0)
    return spans.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        walked["spans"].alias("loss_spans"),
        F.col("lo").alias("turn_from"),
        F.col("hi").alias("turn_to"),
        F.col("from").alias("history_from"),
        "repeated",
        (at(F.col("hi")) - at(F.col("from") - 1) + system_tokens).alias("tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations again from their windows: conv_id, turns array<struct<role, text>>, loss (texts under the mask), formatted_chars.

    Of each window's turns the `repeated` ones at its start are passed over.
    """
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    own = F.transform(
        F.slice(pieces, F.col("repeated") + 1, F.size(pieces)),
        lambda x: F.struct(
            unescaped(F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), MID, 1)).alias("role"),
            unescaped(F.substring(x, F.instr(x, MID) + len(MID), F.length(x))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"], s["length"])))
    each = windows.select("conv_id", F.struct("window", own.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda w: w["loss"])).alias("loss"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + w["chars"]).alias("formatted_chars"),
    )
