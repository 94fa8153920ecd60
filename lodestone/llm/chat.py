"""Chat formatting from an event log.

A log has one row for each event of a conversation: `start` opens a turn or replaces it, `delta` appends streamed text, `edit` replaces the
text so far, `regenerate` drops the text so far and starts an answer anew, `delete` removes the turn until something follows. Events are partitioned by conversation
and turn, sorted by sequence number and folded into the final message; the messages of a conversation are then rendered.

In the rendering a turn is `<turn ROLE>TEXT</turn>` and a line end. Roles and texts are escaped: a backslash becomes `\\b`, `<` becomes `\\l`, `>` becomes
`\\g`. So no text can hold a mark, and as every backslash is followed by a letter of its own, undoing `\\g`, `\\l` and then `\\b` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT, END = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, turn, kind, role, text) -> (conv_id, turn, role, text), the final messages.

    The last start, edit, regenerate or delete of a turn and the deltas after it count; the role is the last one given. Null texts
    are empty; a turn of deltas only is their concatenation; ties in seq are taken in the order of kind, role and text, so events that are logged twice with one seq count twice. A turn whose last such event is a
    delete with no delta after it is gone. Null conv_ids form one conversation, null turns one turn of it; other columns are ignored; an empty log gives no rows. A turn may be as long as one of Spark's strings.
    """
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e.kind != "delta", i).otherwise(F.lit(0))))
    kept = F.slice("log", F.col("last") + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r != "")
    log = log.withColumn("last", last).withColumn("kept", kept).where(~((F.size("kept") == 1) & (F.col("kept")[0]["kind"] == "delete")))
    text = F.array_join(F.transform("kept", lambda e: F.when(e.kind == "delete", F.lit("")).otherwise(e.text)), "")
    return log.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> (conv_id, formatted, loss_spans): one row for each conversation.

    loss_spans are the (start, length) in characters of formatted that hold the assistant's texts, from 0. Turns are in the order of turn, then role and text, so
    repeated rows stay and ties are settled; null turns come first; null roles and texts are empty; null conv_ids form one conversation. Other columns are ignored, whatever their names; an empty table gives no rows. A conversation becomes one string of at most 2 GB, Spark's limit.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT)).alias("head"), escape(F.col("text")).alias("body"))
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")).alias("at"))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    folded = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("m"), F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"))
    return folded.select("conv_id", F.array_join(F.transform("m", lambda x: x.turn), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a rendering."""
    turns = F.filter(F.split(formatted, END, -1), lambda t: t != "")
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substring(t, F.lit(len(OPEN) + 1), F.length(t)), SHUT, 1)).alias("role"), unescape(F.substring(t, F.instr(t, SHUT) + 1, F.length(t))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int"))), ""))
