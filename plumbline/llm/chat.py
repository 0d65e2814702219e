"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events: ``message`` opens a message with a role and a text, ``delta``
appends streamed text, ``edit`` replaces the text, ``regenerate`` starts the message again and
discards the messages after it that were written before. ``fold`` sorts the log by sequence and
reduces it to the final messages, ``render`` writes them with a template and marks the text to be
learned, ``read_back`` parses a rendered conversation again.

Template: ``<s>`` role ``[INST]`` text ``[/INST]</s>`` newline, per message. A control string in a
role or text gets a backslash after its first character, one more if it has some already, so the
reverse takes one away and every text comes back unchanged.

All steps after the first shuffle are clustered by conversation: the log moves once. A
conversation becomes one string, so it must fit a row (2 GB); nothing else bounds it.

Defined cases: a null text or role is empty; null identifiers form one conversation; a delta
without a message opens one; events that tie in sequence are ordered by kind, role and text; rows
that repeat in ``message_log`` stay separate turns; an empty log gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LEARNED_ROLE = "assistant"
#: Control strings of the template (fixed values): <s> </s> [INST] [/INST]
_CONTROL = r"((?:/?s>)|(?:/?INST\]))"
_ESCAPE = r"([<\[])(\\*)" + _CONTROL
_UNESCAPE = r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def message_log(rows: DataFrame, streamed_role: str = LEARNED_ROLE) -> DataFrame:
    """Events of stored turns (``conv_id``, ``turn``, ``role``, ``text``).

    Turns of ``streamed_role`` come as an opening event and a delta, as a model writes them.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = rows.select("conv_id", "turn", "role", "text").withColumn(
        "target", F.row_number().over(order).cast("long"))
    streamed = F.coalesce(F.col("role"), F.lit("")) == streamed_role
    opening = F.struct(
        (F.col("target") * 2).alias("seq"), F.lit("message").alias("kind"), F.col("role"),
        F.when(~streamed, F.col("text")).alias("text"))
    delta = F.struct(
        (F.col("target") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"),
        F.lit(None).cast("string").alias("role"), F.col("text"))
    events = F.when(streamed, F.array(opening, delta)).otherwise(F.array(opening))
    return turns.select("conv_id", "target", F.inline(events))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of a log: ``conv_id``, ``target``, ``role``, ``text``."""
    # message before edit before delta where the sequence ties
    rank = F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END")
    events = log.select(
        "conv_id", "target",
        F.struct("seq", rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .alias("e"))
    messages = (
        events.groupBy("conv_id", "target")
        .agg(F.array_sort(F.collect_list("e")).alias("e"),
             F.max("e.seq").alias("last_seq"),
             F.max(F.when(F.col("e.rank") == 1, F.col("e.seq"))).alias("restarted")))
    reset = F.array_max(F.transform("e", lambda x, i: F.when(x["rank"] < 3, i + 1).otherwise(1)))
    messages = messages.withColumn("reset", reset).select(
        "conv_id", "target", "last_seq", "restarted",
        F.coalesce(F.try_element_at(F.filter("e", lambda x: x["role"].isNotNull()), F.lit(-1))["role"],
                   F.lit("")).alias("role"),
        F.array_join(F.transform(F.expr("slice(e, reset, size(e))"), lambda x: x["text"]), "")
        .alias("text"))
    before = (Window.partitionBy("conv_id").orderBy("target")
              .rowsBetween(Window.unboundedPreceding, -1))
    cut = F.max("restarted").over(before)
    return (messages.withColumn("cut", cut)
            .where("cut IS NULL OR cut < last_seq").select("conv_id", "target", "role", "text"))


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans`` (start, length in code points)."""
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))
    parts = messages.select(
        "conv_id", "target", (F.col("role") == learned_role).alias("learned"),
        head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn(
        "piece", F.concat("head", "body", F.lit("[/INST]</s>\n")))
    before = (Window.partitionBy("conv_id").orderBy("target")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    parts = parts.select(
        "conv_id", "target", "piece", "learned", start.alias("start"),
        F.length("body").cast("long").alias("length"))
    ordered = F.array_sort(F.collect_list(F.struct("target", "piece", "learned", "start", "length")))
    return parts.groupBy("conv_id").agg(ordered.alias("m")).select(
        "conv_id", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("m", lambda x: x["learned"]),
                    lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
        .alias("loss_spans"))


def format_chats(log: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Fold a log and render its conversations."""
    return render(fold(log), learned_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` of rendered conversations, from the output alone."""
    pieces = F.expr(r"transform(slice(split(formatted, '</s>\n', -1), 1, "
                    r"size(split(formatted, '</s>\n', -1)) - 1), p -> substr(p, 4))")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "[INST]", 1)
        body = F.substr(piece, F.length(role) + 7, F.length(piece) - F.length(role) - 13)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "*", F.transform(pieces, turn).alias("turns"), F.array_join(learned, "").alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from them."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
