"""Chat formatting from an event log, with DataFrame operations only.

A log holds one event a row: ``conv_id``, ``seq`` (its order), ``kind``, ``target``, ``role``, ``text``. A ``message``
opens a message; ``delta`` adds text to the message whose ``seq`` is its ``target``; ``edit`` replaces that message's
text; ``regenerate`` drops what it has and begins anew with its own text. The log is partitioned by conversation and
message, sorted by sequence and folded; then the messages of a conversation are rendered in the order they were opened.

A null text or role is empty, a null ``conv_id`` is a conversation of its own, null sequence numbers come first.
Messages with equal numbers (repeated rows too) stay separate and are ordered by role and text; changes go to the first of
them. Changes without a message are left out. An empty log gives an empty result; other columns are not read.

Rendered, a turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. A backslash in a
role or text is doubled, ``<|`` becomes ``<\\|`` and a line feed in a role gets a backslash, so no text can close its
turn; taking the character behind each backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation_log(rows: DataFrame) -> DataFrame:
    """Rows of finished turns (``conv_id``, ``turn``, ``role``, ``text``) as a log."""
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"),
        F.lit(None).cast("long").alias("target"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def fold_messages(log: DataFrame) -> DataFrame:
    """The final messages: ``conv_id``, ``seq``, ``tie``, ``role``, ``text``."""
    events = log.filter(F.col("kind").isin(*KINDS)).select(
        "conv_id", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("kind") == "message", F.col("seq")).otherwise(F.col("target")).alias("message"),
    )
    # equal numbers: a message keeps its own place, changes join the first
    same = Window.partitionBy("conv_id", "message").orderBy(F.col("kind") != "message", "role", "text")
    placed = events.withColumn("place", F.row_number().over(same)).withColumn(
        "tie", F.when(F.col("kind") == "message", F.col("place")).otherwise(F.lit(1))
    )
    parts = placed.groupBy("conv_id", "message", "tie").agg(
        F.array_sort(F.collect_list(F.struct((F.col("kind") != "message").alias("later"), "seq", "place", "kind", "role", "text"))).alias("events")
    )
    opened = parts.filter(~F.col("events")[0]["later"])
    at = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i + 1)))
    return opened.withColumn("from", at).select(
        "conv_id", F.col("message").alias("seq"), "tie", F.col("events")[0]["role"].alias("role"),
        F.array_join(F.transform(F.slice("events", F.col("from"), F.size("events")), lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask``: of each turn its place and the span of its text that counts for the loss."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    turns = messages.select(
        "conv_id", "seq", "tie", head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("trained")
    )
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    before = Window.partitionBy("conv_id").orderBy("seq", "tie").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn_start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")))
    turn = F.struct(
        "turn_start", (F.col("turn_start") + F.length("head")).alias("start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("length"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
    )
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["turn_start"].alias("turn_start"), t["start"].alias("start"), t["length"].alias("length"))).alias("mask"),
    )


def format_chats(log: DataFrame) -> DataFrame:
    return render(fold_messages(log))


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``loss_texts`` from what ``render`` has written."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"
    parts = chats.select("conv_id", "mask", pieces.alias("pieces"))
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"),
            unescape(F.substr(p, F.length(F.regexp_extract(p, head, 0)) + 1)).alias("text"),
        ),
    )
    under = F.filter(F.arrays_zip("pieces", "mask"), lambda x: x["mask"]["length"] > 0)
    inside = lambda m: (m["start"] - m["turn_start"] - len(OPEN) + 1).cast("int")
    loss = F.transform(under, lambda x: unescape(F.substr(x["pieces"], inside(x["mask"]), x["mask"]["length"])))
    return parts.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"))
