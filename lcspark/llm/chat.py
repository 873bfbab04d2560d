"""Chat formatting from an event log: the events of a conversation are
sorted by sequence and folded into final messages, which are then rendered.

Events have a kind:
  message     starts (or restarts) a message with a role and a text;
  delta       adds its text to the message's current version;
  edit        replaces the message's text, later deltas add to it;
  regenerate  replaces the message's text and drops what the conversation's
              later messages had so far.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per message.  In
roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can occur inside and ``unescape`` gives the original back.

Defined cases: null text and null role are empty; a null conversation id is
a conversation of its own; events of equal sequence are folded in the order
of kind (edit, message, regenerate, then delta) and text; a message with
deltas alone has the text of all of them; messages of equal position fold
into one, so callers give rows that must stay apart a further column in
``message_cols``; an empty log gives no rows.  A conversation is one output
string, so its messages meet in one task at the end, already folded and
rendered; its events are folded per message before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.llm.common import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
# Code points per delta when stored messages are replayed as a stream.
DELTA_CHARS = 512


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame, message_cols: Sequence[str] = ("message",)) -> DataFrame:
    """conv_id, the message columns, role, text: the final messages.  Input:
    conv_id, message columns, seq (any sortable type), kind, role, text."""
    event = F.struct("seq", (F.col("kind") == "delta").alias("adds"), "kind", F.coalesce("text", F.lit("")).alias("text"),
                     "role")
    per_message = events.groupBy("conv_id", *message_cols).agg(
        F.sort_array(F.collect_list(event)).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    earlier = (Window.partitionBy("conv_id").orderBy(*message_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    live = (per_message.withColumn("cut", F.max("again").over(earlier))
            .withColumn("log", F.filter("log", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut"))))
            .where(F.size("log") > 0))
    roles = F.filter(F.col("log"), lambda e: e["role"].isNotNull())
    # position of the last event that sets the text; 1 if all are deltas
    last_set = F.aggregate(
        F.col("log"), F.struct(F.lit(0).alias("at"), F.lit(1).alias("set")),
        lambda s, e: F.struct((s["at"] + 1).alias("at"),
                              F.when(e["adds"], s["set"]).otherwise(s["at"] + 1).alias("set")),
        lambda s: s["set"])
    version = let(last_set, lambda i: F.slice(F.col("log"), i, F.size("log")))
    return live.select("conv_id", *message_cols,
                       F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).otherwise("").alias("role"),
                       F.array_join(F.transform(version, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, message_cols: Sequence[str] = ("message",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: array of (turn, turn_start,
    start, end), code-point offsets in ``formatted``; the spans cover the
    escaped texts of the trained role."""
    order = Window.partitionBy("conv_id").orderBy(*message_cols)
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    parts = (messages.withColumn("head", head).withColumn("body", escape(F.col("text")))
             .select("*", (F.length("head") + F.length("body") + len(END)).cast("bigint").alias("chars")))
    placed = (parts.withColumn("turn", F.row_number().over(order) - 1)
              .withColumn("turn_start", F.coalesce(
                  F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    start = F.col("turn_start") + F.length("head")
    piece = F.struct("turn", F.concat("head", "body", F.lit(END)).alias("segment"), "turn_start", start.alias("start"),
                     (start + F.length("body")).alias("end"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["trained"]), lambda p: F.struct(
        p["turn"].alias("turn"), p["turn_start"].alias("turn_start"), p["start"].alias("start"), p["end"].alias("end")))
    return turns.select("conv_id", F.size("pieces").cast("bigint").alias("n_turns"),
                        F.array_join(F.transform("pieces", lambda p: p["segment"]), "").alias("formatted"),
                        spans.alias("loss_spans"))


def format_chat(events: DataFrame, message_cols: Sequence[str] = ("message",)) -> DataFrame:
    """Fold an event log and render it."""
    return render(fold_events(events, message_cols), message_cols)


def _segments(formatted: Column) -> Column:
    return F.split(formatted, r"<\|im_end\|>")


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    def turn(segment):
        return let(F.split(segment, r"<\|im_sep\|>"), lambda p: F.struct(
            unescape(F.substr(F.get(p, F.lit(0)), F.lit(len(START) + 1))).alias("role"),
            unescape(F.get(p, F.lit(1))).alias("text")))
    return F.transform(F.filter(_segments(formatted), lambda s: s != ""), turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """Unescaped texts under the loss mask, one per span; each is cut from
    its turn's segment, so the work is linear in the string."""
    return let(_segments(formatted), lambda segments: F.transform(spans, lambda s: unescape(F.substr(
        F.get(segments, s["turn"]), (s["start"] - s["turn_start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))


def replay_events(rows: DataFrame, order_cols: Sequence[str], delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Stored messages as the event log that would have made them: a message
    event each, which for the trained role starts empty and is followed by
    deltas of at most ``delta_chars`` code points."""
    streamed = F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))

    def event(kind, body, role):
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), body.alias("text"))
    nobody = F.lit(None).cast("string")
    deltas = F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % delta_chars), F.lit(0)),
                         lambda t: event("delta", t, nobody))
    log = F.when(streamed, F.concat(F.array(event("message", F.lit(""), F.col("role"))), deltas)).otherwise(
        F.array(event("message", text, F.col("role"))))
    return (rows.select("conv_id", *order_cols, F.posexplode(log).alias("at", "e"))
            .select("conv_id", *order_cols, F.struct(*order_cols, "at").alias("seq"),
                    F.col("e.kind").alias("kind"), F.col("e.role").alias("role"), F.col("e.text").alias("text")))
