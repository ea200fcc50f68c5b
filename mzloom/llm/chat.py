"""Event-sourced chat reconstruction and rendering, with built-in functions only.

A log has events (conv_id, seq, kind, message_id, role, text). ``message`` opens a message,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` discards its text so that later
deltas build it anew, ``delete`` withdraws it. The log is partitioned by conversation once; events
of one message are sorted and folded, messages are put in order of their opening event, and
running offsets give the loss spans. Every step is linear in the conversation: a span names its turn and
where that turn starts, so its text is cut from the turn and never looked for in the whole.

Template, one per turn: ``<s>[role]`` role ``[/role]`` text ``</s>``. In roles and texts ``&``, ``<``
and ``[`` become ``&amp;``, ``&lt;`` and ``&#91;``, so no control string can occur inside, and
``unescape`` restores every text.

Null text and null role count as empty. A null conv_id is a conversation of its own. A null seq sorts
first. Ties in seq are ordered by kind, role and text; repeated ``message`` events open repeated
messages. An empty log gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, HEAD_END, CLOSE = "<s>[role]", "[/role]", "</s>"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def stream_log(conversations: DataFrame, delta: int = 256, reply_role: str = "assistant") -> DataFrame:
    """The log that live clients would have left of a finished table (conv_id, turn, role, text).

    Replies open empty, stream a discarded first draft, are regenerated and arrive in deltas of ``delta`` code
    points. Other turns open with a first wording and are edited to their text. Folding the log must give the table.
    The result is partitioned by conversation.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first = F.coalesce(F.get(F.col("chunks"), F.lit(0)), F.lit(""))
    reply = F.concat(F.array(event("message", F.lit("")), event("delta", F.concat(first, F.lit(" ..."))), event("regenerate", F.lit(""))), F.transform("chunks", lambda x: event("delta", x)))
    other = F.array(event("message", F.concat(F.lit("draft: "), first)), event("edit", F.col("text")))
    c = c.withColumn("chunks", chunks).withColumn("events", F.when(F.col("role") == reply_role, reply).otherwise(other))
    c = c.select("conv_id", "n", "role", F.posexplode("events").alias("k", "e"))
    return c.select("conv_id", F.struct("n", "k").alias("seq"), "e.kind", F.col("n").cast("string").alias("message_id"), "role", "e.text")


def message_log(conversations: DataFrame) -> DataFrame:
    """The log of a finished table (conv_id, turn, role, text): one ``message`` event per row."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("string").alias("message_id"), "role", "text"
    )


def fold(events: DataFrame, partitioned: bool = False) -> DataFrame:
    """Final messages: conv_id, place (from 0), role, text; partitioned by conv_id, as ``events`` may be already."""
    e = F.struct("seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("late"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.select("conv_id", "message_id", e.alias("e"))
    log = log if partitioned else log.repartition("conv_id")
    log = log.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    n = F.size("e")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(F.col("e"), i - 1)["kind"] == "message"))
    log = log.withColumn("starts", starts).withColumn("n", n)
    parts = F.transform(
        "starts",
        lambda s, k: F.slice(F.col("e"), s, F.coalesce(F.get(F.col("starts"), k + 1), F.col("n") + 1) - s),
    )
    log = log.select("conv_id", "message_id", F.posexplode(parts).alias("k", "p"))
    log = log.where(~F.exists("p", lambda x: x["kind"] == "delete"))
    resets = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.get(F.col("p"), i - 1)["kind"].isin("message", "edit", "regenerate"))
    log = log.withColumn("reset", F.coalesce(F.array_max(resets), F.lit(1)))
    live = F.slice(F.col("p"), F.col("reset"), F.size("p"))
    text = F.array_join(F.transform(live, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    first = F.get(F.col("p"), F.lit(0))
    log = log.select("conv_id", first["seq"].alias("seq"), "k", "message_id", F.coalesce(first["role"], F.lit("")).alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "message_id", "k")
    return log.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (spans of escaped ``loss_role`` text: start and length in code points, turn, turn_start)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    m = messages.select("conv_id", "place", (F.col("role") == loss_role).alias("loss"), role.alias("r"), text.alias("t"))
    m = m.withColumn("piece", F.concat(F.lit(OPEN), "r", F.lit(HEAD_END), "t", F.lit(CLOSE)))
    before = F.sum(F.length("piece").cast("long")).over(W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("r") + len(OPEN) + len(HEAD_END)
    m = m.select("conv_id", F.struct("place", "piece", "loss", start.alias("start"), F.length("t").cast("long").alias("length"), F.coalesce(before, F.lit(0)).alias("turn_start")).alias("m"))
    m = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    spans = F.transform(F.filter("m", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"], x["place"].alias("turn"), x["turn_start"]))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> from a rendered conversation."""
    pieces = F.filter(F.split(formatted, r"<s>\[role\]"), lambda p, i: i > 0)
    parts = F.transform(pieces, lambda p: F.split(p, r"\[/role\]|</s>"))
    return F.transform(parts, lambda p: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")))


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation: counts and digests read back from the rendered text and its loss spans."""
    d = rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.split("formatted", "(?<=</s>)").alias("pieces"), "loss")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    cut = lambda s: F.substring(F.get(F.col("pieces"), s["turn"].cast("int")), (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss", lambda s: unescape(cut(s))), "")
    d = d.withColumn("said", said).withColumn("lost", loss)
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
