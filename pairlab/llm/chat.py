r"""Chat formatting from event logs, in built-in functions only.

``fold_events`` rebuilds messages from a log: its rows are dealt by conversation and ordered by sequence; a ``message``
begins one, a ``delta`` adds to one, an ``edit`` or ``regenerate`` replaces its text so far. These three change the last
message begun before them, or the one whose sequence number ``target`` names, however late they come. Turns are what the
fold finds; a log needs no turn numbers. A long conversation is folded in chunks of its sequence, each of which is
numbered by itself and hands its open message on to the next.
``render`` turns messages into one text per conversation, with the spans that count for the loss; ``read_back`` takes
such a text apart again.

A turn is rendered as `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. Within roles and texts a
backslash is doubled and `<|` becomes `<\|`, in roles also a line break gets a backslash, so no control string can occur
inside and reading back restores every character.

Turns are gathered in chunks of neighbouring turn numbers first and chunks in conversations then, so no task sorts more
than a chunk's turns at once; a conversation's text itself is one value in the end. Defined cases: a null text or role
is an empty one; rows of one conversation and turn number are ordered by role and text; repeated rows are turns of their
own; rows with a null conversation form one of their own; events of one sequence number are ordered by role, kind and
text, those without one come first; a null kind is a message; a delta, edit or regeneration before any message of its
conversation begins one, and one whose target is no message changes the open one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers that are gathered at a time, and the least number of events of a chunk.
CHUNK = 256


def chunk_width(events: DataFrame) -> float | None:
    """Sequence numbers of a chunk, so that the longest log has chunks of a root of its events, or of CHUNK if that is more."""
    s = F.col("seq").cast("double")
    logs = events.groupBy("conv_id").agg(F.count("*").alias("n"), (F.max(s) - F.min(s)).alias("span"))
    longest = logs.agg(F.max(F.struct("n", "span")).alias("m")).select("m.*").first()
    if longest.n is None or longest.n <= CHUNK or not longest.span:
        return None
    return longest.span * max(CHUNK, longest.n**0.5) / longest.n


def fold_events(events: DataFrame, width: float | None = None) -> DataFrame:
    """(conv_id, turn, message_no, role, text) from events (conv_id, seq, role, kind, text and, maybe, target); turns are
    numbered from 0. width is the number of sequence numbers of a chunk; unless it is given it follows from the longest log.
    """
    width = width or chunk_width(events)
    filled = events.select(
        F.struct("conv_id").alias("key"),  # equal also where it is null
        (F.floor(F.col("seq").cast("double") / width) if width else F.lit(0)).cast("long").alias("chunk"),
        "seq",
        (F.col("target") if "target" in events.columns else F.lit(None).cast(events.schema["seq"].dataType)).alias("target"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    filled = filled.withColumn("chunk", F.coalesce("chunk", F.lit(-(1 << 63))))
    order = Window.partitionBy("key", "chunk").orderBy("seq", "role", "kind", "text")
    begins = (F.col("kind") == "message").cast("int")
    # Written once, so that what is found out from numbers alone doesn't read the texts.
    rows = cut(
        filled.withColumns(
            {"at": F.row_number().over(order), "own": F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))},
        ),
    )
    # Each chunk's messages begun before it; what comes before a conversation's first message is one, too.
    chunks = rows.groupBy("key", "chunk").agg(F.max("own").alias("n"), F.min_by("kind", "at").alias("kind"))
    over = Window.partitionBy("key").orderBy("chunk")
    led = (F.first("kind").over(over) != "message").cast("long")
    before = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + led
    chunks = chunks.select("key", "chunk", before.alias("before"))
    aimed = rows.where("target IS NOT NULL AND kind != 'message'").select("key", F.col("target").alias("seq"), "chunk", "at")
    begun = rows.where("kind = 'message'").select("key", "seq", F.col("chunk").alias("in"), "own").join(
        chunks.withColumnRenamed("chunk", "in"),
        ["key", "in"],
    ).groupBy("key", "seq").agg(F.min(F.col("before") + F.col("own")).alias("named"))
    named = aimed.join(begun, ["key", "seq"]).groupBy("key", "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "named"))).alias("named"),
    )
    known = chunks.join(named, ["key", "chunk"], "left")
    number = F.coalesce(F.col("named")[F.col("at")], F.col("before") + F.col("own"))
    numbered = rows.join(known, ["key", "chunk"]).select("key", "role", "kind", "text", number.alias("message_no"), F.struct("chunk", "at").alias("pos"))
    message = numbered.groupBy("key", "message_no").agg(
        F.min_by("role", F.struct(F.col("kind") != "message", "pos")).alias("role"),
        F.max(F.when(F.col("kind") != "delta", F.col("pos"))).alias("reset"),
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p.pos >= F.col("reset")))
    return message.select(
        "key.conv_id",
        (F.col("message_no") - 1).cast("long").alias("turn"),
        F.lit(1).cast("long").alias("message_no"),
        "role",
        F.array_join(F.transform(live, lambda p: p.text), "").alias("text"),
    )


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages (conv_id, turn, message_no, role, text).

    loss_spans has the start and length, in code points, of each text of loss_role in formatted.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    pieces = messages.select(
        "conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), F.struct(F.col("turn"), F.col("message_no"), role.alias("r"), F.col("text").alias("t")).alias("place"),
        F.concat(head, text, F.lit(END + "\n")).alias("piece"), F.length(head).alias("head"), F.length(text).alias("length"), (role == loss_role).alias("loss"),
    )
    before = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start",
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.col("head"),
    )
    row = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("place"))
    chunks = placed.withColumn("row", row).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("row", "piece", "start", "length", "loss"))).alias("p")).select(
        "conv_id", "chunk", F.array_join("p.piece", "").alias("text"),
        F.transform(F.filter("p", lambda p: p.loss), lambda p: F.struct(p.start.alias("start"), p.length.cast("long").alias("length"))).alias("spans"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = chunks.withColumn("offset", F.coalesce(F.sum(F.length("text").cast("long")).over(earlier), F.lit(0)))
    moved = offset.select(
        "conv_id",
        "chunk",
        "text",
        F.transform(
            "spans",
            lambda s: F.struct((s.start + F.col("offset")).alias("start"), s.length.alias("length")),
        ).alias("spans"),
    )
    whole = moved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "spans"))).alias("c"))
    return whole.select(
        "conv_id",
        F.array_join("c.text", "").alias("formatted"),
        F.flatten("c.spans").alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered text, as array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    head = r"^<\|im_start\|>((?:[^\\\n]++|\\[\s\S])*+)\n"
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss spans of a rendered text, restored."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, s.length.cast("int")))),
        "",
    )
