"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events. Sorted by sequence, the events of each message are folded into its final
text (streamed deltas add, edits replace, regenerations start over, retractions remove the message), the
messages are ordered, and a template renders them with a loss mask over the assistants' texts.

Scale: events are folded per message first, so a conversation that holds a third of all rows is spread over as
many keys as it has messages. Rendering joins messages in two steps, runs of ``RUN`` consecutive messages and then the
runs of a conversation, so that the last step handles one row for each run. What the last step holds is the one
row that a rendered conversation is by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, TEXT, SHUT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"
#: A control string inside a text, with any number of backslashes after its first character.
CONTROL = r"(<|\[)(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"(<|\[)\\(\\*)(/?(?:s>|INST\]))"
RUN = 64

#: Event kinds: a whole message; text to add; the new text; start over; take the message out.
KINDS = ("message", "delta", "edit", "regenerate", "retract")


def escape(text: Column) -> Column:
    r"""Every control string in ``text`` gets one more backslash after its first character: ``</s>`` becomes ``<\/s>``."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def messages(events: DataFrame) -> DataFrame:
    """Final messages from ``events`` (conv_id, message_id, seq, kind, role, text, and step if there is one): conv_id, message_id, seq, role, text.

    Events of a message count in the order of (seq, step, kind, text), null text as empty. An event that repeats counts as often, so a repeated delta adds
    twice. No events give no messages; other columns are ignored. ``message`` and ``edit`` set the text,
    ``delta`` adds to it, ``regenerate`` empties it, ``retract`` removes the message until a later event sets or adds text
    again. Its place is its smallest seq and its role that of its first event that has one. Null keys are keys
    like any other; unknown kinds are an error.
    """
    known = F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS)
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null")))))
    step = F.col("step") if "step" in events.columns else F.lit(0)
    event = F.struct(F.col("seq"), step.alias("step"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    log = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # the last event that empties or sets the text decides where the text starts
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1)))
    log = log.withColumn("from", F.array_max(resets))
    live = F.filter(F.col("log"), lambda e, i: (i >= F.col("from")) & ~e["kind"].isin("regenerate", "retract"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    gone = F.col("log")[F.greatest("from", F.lit(0))]["kind"].eqNullSafe("retract") & (F.size("live") == 0)
    return (
        log.withColumn("live", live)
        .where(~gone)
        .select("conv_id", "message_id", F.col("log")[0]["seq"].alias("seq"), F.when(F.size(roles) > 0, roles[0]).alias("role"), _joined(F.transform("live", lambda e: e["text"])).alias("text"))
    )


def render(final: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` are the consecutive parts of ``formatted``, each with ``loss``: whether the training loss covers it. It covers
    the texts of assistants, as escaped, without the marks around them. Messages are in the order of (seq, message_id, role,
    text); null roles and texts are empty. Repeated messages are rendered as often, a null conv_id is a conversation, no messages give no rows; other columns are
    ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    loss = role == LOSS_ROLE
    head = F.concat(F.lit(OPEN), escape(role), F.lit(TEXT))
    parts = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(text).alias("text"), loss.alias("loss")),
        F.struct(F.lit(SHUT + CLOSE).alias("text"), F.lit(False).alias("loss")),
    )
    key = F.struct("seq", "message_id", "role", "text")
    run = F.floor(F.coalesce(F.col("seq"), F.lit(0)) / RUN).cast("long")
    # equal messages are equal parts, so the order among them cannot be seen
    turns = final.select("conv_id", F.col("seq").isNotNull().alias("placed"), run.alias("run"), F.struct(key.alias("key"), parts.alias("parts")).alias("turn"))
    runs = turns.groupBy("conv_id", "placed", "run").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    # rows without a sequence come first, then the runs by number
    runs = runs.select("conv_id", F.struct("placed", "run", F.flatten(F.transform("turns", lambda t: t["parts"])).alias("parts")).alias("run"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    whole = whole.select("conv_id", F.flatten(F.transform("runs", lambda r: r["parts"])).alias("segments"))
    return whole.select("conv_id", _joined(F.transform("segments", lambda p: p["text"])).alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """From rendered conversations: conv_id, turns (array of role and text), loss_texts (array), all unescaped.

    Row by row: repeated rows are read as often, none give none, a null ``formatted`` has null turns; other columns are ignored.
    """
    turn = r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>"
    roles, texts = F.regexp_extract_all("formatted", F.lit(turn), F.lit(1)), F.regexp_extract_all("formatted", F.lit(turn), F.lit(2))
    pairs = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    masked = F.transform(F.filter("segments", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return formatted.select("conv_id", "formatted", pairs.alias("turns"), masked.alias("loss_texts"))


def as_events(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) as the log of how they came to be: conv_id, message_id, seq, step, kind, role, text.

    An assistant's text is a draft that is thrown away by a regeneration and then streamed in three deltas; any other is a delta that is retracted, a new message with
    its first third, and an edit to the whole. Folding gives every row back as it was; null texts come back empty. Rows that repeat a turn are messages of
    their own, numbered within the turn by (role, text). An empty table gives no events; other columns are ignored.
    """
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    ends = [F.floor(F.char_length(text) * n / 3).cast("int") for n in range(4)]
    first, second, third = (F.substring(text, a + 1, b - a) for a, b in zip(ends, ends[1:]))
    streamed = (("message", third), ("regenerate", F.lit("")), ("delta", first), ("delta", second), ("delta", third))
    edited = (("delta", text), ("retract", F.lit("")), ("message", first), ("edit", text))
    logs = [F.array(*(F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), said.alias("text")) for n, (kind, said) in enumerate(log))) for log in (streamed, edited)]
    rows = conversations.select("conv_id", F.struct("turn", number.alias("nth")).alias("message_id"), F.col("turn").alias("seq"), "role", F.when(F.col("role").eqNullSafe(LOSS_ROLE), logs[0]).otherwise(logs[1]).alias("log"))
    return rows.select("conv_id", "message_id", "seq", "role", F.inline("log")).select("conv_id", "message_id", "seq", "step", "kind", "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from rendered conversations."""
    back = read_back(formatted)
    told = _joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(_joined("loss_texts")).cast("long").alias("loss_chars"),
        F.sha2(_joined("loss_texts"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds: control strings inside both texts.
PLANTED = "</s>[INST] ok [/INST]"

ORACLE_SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
told AS (
  SELECT conv_id, turn, role, text,
    '{OPEN}' || regexp_replace(role, '(<|\[)(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || '{TEXT}'
      || regexp_replace(text, '(<|\[)(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || '{SHUT}{CLOSE}' AS shown
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(length(string_agg(shown, '' ORDER BY turn, role, text)) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""
