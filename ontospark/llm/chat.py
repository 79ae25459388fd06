"""Chat formatting [native]: event-sourced reconstruction of conversations, and their rendering.

Only DataFrame and SQL functions are used; nothing here starts a Python worker.

An event log has one row per event: ``conv_id``, ``seq`` (order within the
conversation), ``message`` (which message it belongs to), ``role``, ``kind`` and
``text``. Kinds: ``open`` starts a message, ``delta`` appends streamed text,
``edit`` replaces the text so far, ``regenerate`` discards it. Unknown kinds and null
texts append nothing. A message counts when it has at least one event.

Defined cases: null text is the empty text, a null role the empty role, a null
conversation is one conversation of its own; events with equal ``seq`` fold in the order of kind
and text; an empty log gives an empty result; other columns are ignored.

A message is gathered before a conversation is, and turns are joined into runs of
``RUN`` turns before runs are joined, so a conversation that holds a large part of all rows
reaches its last task as few long strings. The rendered conversation itself is one
value (its digest is over all of it) and must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns in a run that is joined on its own first.
RUN = 64
#: Marks of the template. Each of them, and the strings that other templates reserve, is escaped in texts.
TURN, SAID, END = "<|turn|>", "<|said|>", "<|end|>"
#: Control string k of this list is written ~k inside texts; ~ itself is written ~0.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\x1e"]


def escape(text: Column) -> Column:
    """Control strings out of a text, reversibly."""
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, mark in enumerate(CONTROL, 1):
        out = F.replace(out, F.lit(mark), F.lit(f"~{k}"))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: ~k can only stem from a control string, as ~ itself became ~0."""
    for k, mark in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(f"~{k}"), F.lit(mark))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def fold(events: DataFrame) -> DataFrame:
    """Event log to final messages: ``conv_id, first_seq, message, role, text``.

    Per message: the last ``edit`` or ``regenerate`` decides where the text starts (the
    edit's own text, or empty), later deltas follow in order of ``seq``.
    """
    e = events.select(
        "conv_id", "seq", "message", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.struct("seq", "kind", "text"))))
    kept = e.groupBy("conv_id", "message").agg(F.min("seq").alias("first_seq"), F.min_by("role", "seq").alias("role"), said.alias("said"))
    resets = F.filter("said", lambda x: x["kind"] != "delta")
    last = F.coalesce(F.array_position(F.transform("said", lambda x: x["kind"] != "delta"), True), F.lit(0))
    # position of the last reset: counted from the end of the reversed log
    back = F.coalesce(F.array_position(F.transform(F.reverse("said"), lambda x: x["kind"] != "delta"), True), F.lit(0))
    start = F.when(last == 0, F.lit(0)).otherwise(F.size("said") - back + 1)
    head = F.when(F.size(resets) == 0, F.lit("")).otherwise(
        F.when(F.element_at(resets, -1)["kind"] == "edit", F.element_at(resets, -1)["text"]).otherwise(F.lit(""))
    )
    tail = F.array_join(F.transform(F.slice("said", start.cast("int") + 1, F.size("said")), lambda x: x["text"]), "")
    # slice() refuses a null or empty array's length only if negative, so an empty log of a message gives ''
    return kept.select("conv_id", "first_seq", "message", "role", F.concat(head, tail).alias("text"))


def render(messages: DataFrame, order: list[str]) -> DataFrame:
    """``conv_id, formatted``: the turns of each conversation in the given order, one string each."""
    turn = F.concat(
        F.lit(TURN), escape(F.col("role")), F.lit(SAID), escape(F.col("text")), F.lit(END)
    )
    rank = F.struct(*order)
    runs = (
        messages.withColumn("run", F.floor(F.col(order[0]) / RUN))
        .groupBy("conv_id", "run")
        .agg(F.array_sort(F.collect_list(F.struct(rank.alias("at"), turn.alias("turn")))).alias("turns"))
        .select("conv_id", "run", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("part"))
    )
    return (
        runs.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("run", "part"))).alias("parts"))
        .select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("formatted"))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns``: role and text of each turn, read back from the rendered string."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.split_part(F.substr(x, F.lit(len(TURN) + 1)), F.lit(SAID), F.lit(1))).alias("role"),
            unescape(F.split_part(F.substr(x, F.lit(len(TURN) + 1)), F.lit(SAID), F.lit(2))).alias("text"),
        ),
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def loss_spans(parsed: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds ``loss_text``: the texts of one role, unescaped, in order, nothing between."""
    texts = F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    return parsed.withColumn("loss_text", F.array_join(texts, ""))


def mask(parsed: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds ``spans``: where the texts of one role lie in ``formatted`` (start and length in code points, escapes included), in order.

    Lengths are added up within runs of ``RUN`` turns, then over the runs.
    """
    whole, head = len(TURN) + len(SAID) + len(END), len(TURN) + len(SAID)
    size = lambda t: F.length(escape(t))
    sizes = F.transform("turns", lambda t: F.struct(
        (head + size(t["role"])).cast("long").alias("head"), size(t["text"]).cast("long").alias("text"),
        (whole + size(t["role"]) + size(t["text"])).cast("long").alias("whole"), (t["role"] == role).alias("counts"),
    ))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / RUN).cast("int")), lambda k: F.slice("sizes", k * RUN + 1, RUN))
    lengths = F.transform("runs", lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x["whole"]))
    starts = F.aggregate("lengths", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)")
    spans = F.transform(F.arrays_zip(F.col("runs").alias("run"), F.slice("starts", F.lit(1), F.size("runs")).alias("begin")), lambda z: F.aggregate(
        z["run"], F.struct(z["begin"].alias("at"), none.alias("spans")),
        lambda a, x: F.struct((a["at"] + x["whole"]).alias("at"), F.when(x["counts"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["head"]).alias("start"), x["text"].alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    ))
    out = parsed.withColumn("sizes", sizes).withColumn("runs", F.when(F.size("sizes") > 0, runs).otherwise(F.expr("CAST(array() AS array<array<struct<head:bigint,text:bigint,whole:bigint,counts:boolean>>>)")))
    out = out.withColumn("lengths", lengths).withColumn("starts", starts)
    return out.withColumn("spans", F.flatten(spans)).drop("sizes", "runs", "lengths", "starts")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log that would have streamed it: each row opens a message, then
    streams a draft, has it regenerated, streams the first half of the text, gets it edited to itself and streams the rest."""
    c = conversations.select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    half = (F.length("text") / 2).cast("int")
    head, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind"), F.lit("").alias("said")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.reverse(head).alias("said")),
        F.struct(F.lit(2).alias("step"), F.lit("regenerate").alias("kind"), F.lit("").alias("said")),
        F.struct(F.lit(3).alias("step"), F.lit("delta").alias("kind"), F.upper(head).alias("said")),
        F.struct(F.lit(4).alias("step"), F.lit("edit").alias("kind"), head.alias("said")),
        F.struct(F.lit(5).alias("step"), F.lit("delta").alias("kind"), rest.alias("said")),
    )
    return c.select("conv_id", "turn", "row", "role", F.explode(steps).alias("e")).select(
        "conv_id", (F.col("turn") * 8 + F.col("e.step")).alias("seq"), F.struct("turn", "row").alias("message"), "role",
        F.col("e.kind").alias("kind"), F.col("e.said").alias("text"),
    )
