"""Chat formatting from event logs.

A log has one row per event: conv_id, seq (any orderable type), message_id, event, role, text. Events of a message:
`open` gives its role, `delta` appends text, `edit` replaces the text so far, `regenerate` discards it. Events are folded
per message (so a long conversation is dealt over many tasks), then messages are ordered by the seq of their first event,
and rendered. Texts and roles are escaped reversibly, so control strings in them cannot end a turn.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; events of equal seq are ordered
by event and text, messages of equal seq by role and text; repeated rows are separate turns; an empty log gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the first event), message_id, role, text."""
    events = F.sort_array(F.collect_list(F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role")))
    messages = log.groupBy("conv_id", "message_id").agg(events.alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i).otherwise(-1))
    last = F.array_max(resets)
    live = F.filter("events", lambda e, i: ((i > last) & (e["event"] == "delta")) | ((i == last) & (e["event"] == "edit")))
    roles = F.filter("events", lambda e: (e["event"] == "open") & e["role"].isNotNull())
    return messages.select(
        "conv_id", F.col("events")[0]["seq"].alias("seq"), "message_id",
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: runs (turn, start, length) in code points of formatted that belong to assistants, counted from the turn's start."""
    role, text = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), escape(F.col("text"))
    turns = messages.select("conv_id", F.struct("seq", "role", "text", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias("turn"), (F.length(role) + len(START) + 1).alias("start"), F.length(text).alias("length")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_texts: what the rendered text and its loss runs say."""
    pieces = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)", -1), lambda p: p != "")
    split = formatted.withColumn("pieces", pieces)
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p) - len(START) - len(END))
    turns = F.transform("pieces", lambda p: F.struct(unescape(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substring(body(p), F.instr(body(p), "\n") + 1, F.length(p))).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.get("pieces", s["turn"]), s["start"] + 1, s["length"])))
    return split.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def chat_format(log: DataFrame) -> DataFrame:
    """Event log to rendered conversations: conv_id, formatted, loss."""
    return render(fold_events(log))


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations as a log: assistants stream a draft, regenerate it and stream the text in two deltas; the others stream a draft and edit it."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"))
    half = (F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda step, name, text: F.struct(F.struct("turn", F.lit(step).alias("step")).alias("seq"), F.lit(name).alias("event"), text.alias("text"))
    none = F.lit("")
    streamed = F.array(event(0, "open", none), event(1, "delta", head), event(2, "regenerate", none), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "open", none), event(1, "delta", head), event(2, "edit", F.col("text")))
    rows = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return rows.select("conv_id", "message_id", "role", "e.seq", "e.event", "e.text")
