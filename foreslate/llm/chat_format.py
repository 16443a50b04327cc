"""Chat formatting: messages rebuilt from event logs, then rendered with a loss mask.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.store import materialize
from .common import text_or_empty

# The control strings of the template.
OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Turns in one part of a conversation; a part is the largest group that meets in a task.
PART_TURNS = 64


def escape(text: Column) -> Column:
    r"""Doubles each ``\``, then puts one between ``<`` and ``|``: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def message_events(conversations: DataFrame) -> DataFrame:
    """The log that stored turns stand for: conv_id, part, message, seq, role, op, payload.

    Rows of a conversation are taken by turn, then role, then text, so ties
    have one order and repeated rows stay separate messages; null turns come
    first.  Null text and role are empty.  An assistant's answer is a draft, a
    regeneration and two streamed deltas; other turns are a first version that
    an edit replaces.
    """
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"),
        F.floor(F.coalesce("turn", F.lit(-1)) / PART_TURNS).alias("part"))
    place = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")

    def event(op: str, payload: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), payload.alias("payload"))

    answer = F.array(
        event("delta", F.substring("text", F.lit(1), half)), event("regenerate", F.lit("")),
        event("delta", F.substring("text", F.lit(1), half)),
        event("delta", F.expr("substring(text, half + 1)")))
    given = F.array(event("delta", F.col("role")), event("edit", F.col("text")))
    return (
        rows.withColumn("half", half).withColumn("message", F.row_number().over(place))
        .select("conv_id", "part", "message", "role",
                F.posexplode(F.when(F.col("role") == "assistant", answer).otherwise(given)).alias("seq", "event"))
        .select("conv_id", "part", "message", "seq", "role", "event.*")
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """Final role and text of every message: conv_id, part, message, role, text.

    By ``seq``: a delta appends, an edit replaces all before it, a
    regeneration clears.  What stands after the last edit or regeneration
    counts.  Events that tie in ``seq`` go by op, then payload.
    """
    log = F.sort_array(F.collect_list(F.struct("seq", "op", "payload", "role")))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["op"] != "delta", i).otherwise(0)))
    return (
        events.groupBy("conv_id", "part", "message").agg(log.alias("log")).withColumn("last", last)
        .select("conv_id", "part", "message", F.element_at("log", -1)["role"].alias("role"),
                F.array_join(F.transform(F.expr("slice(log, last + 1, size(log))"), lambda e: e["payload"]), "")
                .alias("text"))
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Parts of formatted conversations: conv_id, part, formatted, loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one for
    each text of ``trained_role``.  The parts of a conversation, in order, are
    its output; a part holds at most PART_TURNS turns, so neither a long
    conversation nor one that owns a third of all rows meets in one task.
    """
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    before = Window.partitionBy("conv_id", "part").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    shown = messages.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn(
        "piece", F.concat("head", "body", F.lit(CLOSE)))
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == trained_role, F.struct(start.alias("start"), F.length("body").alias("length")))
    parts = F.sort_array(F.collect_list(F.struct("message", "piece", "span")))
    return (
        shown.withColumn("span", span).groupBy("conv_id", "part").agg(parts.alias("parts"))
        .select("conv_id", "part", F.array_join("parts.piece", "").alias("formatted"),
                F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_spans"))
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read the output back: conv_id, part, chars, turns (array of role, text), loss (array of text)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)  # the last is what follows the last mark: nothing

    def turn(piece: Column) -> Column:
        line_end = F.locate("\n", piece)
        role = F.substr(piece, F.lit(len(OPEN) + 1), line_end - len(OPEN) - 1)
        return F.struct(
            unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(piece, line_end + 1)).alias("text"))

    return formatted.select(
        "conv_id", "part", F.length("formatted").alias("chars"),
        F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))).alias("loss"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rebuild every conversation from its log and render it, in parts."""
    return render(fold_messages(message_events(conversations)))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the written output.

    The contract wants one digest over a whole conversation; only its parts'
    strings, already joined, meet for that.
    """
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    written = materialize(format_conversations(stored.unionByName(probe)), "chat")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parse(written).select(
        "conv_id", "part", "chars", F.size("turns").alias("n"), told.alias("told"), F.array_join("loss", "").alias("loss"))
    in_order = F.sort_array(F.collect_list(F.struct("part", "told", "loss")))
    return (
        parts.groupBy("conv_id").agg(
            F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), in_order.alias("parts"))
        .withColumn("loss", F.array_join("parts.loss", ""))
        .select("conv_id", F.col("n_turns").cast("long"),
                F.sha2(F.array_join("parts.told", ""), 256).alias("turns_sha256"),
                F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                F.col("formatted_chars").cast("long"))
    )


QUERIES = {"op8_chat_format": op8_chat_format}

ORACLE_SQL = {"op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') AS head
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
""".replace(r"'\\'", "repeat(chr(92), 2)").replace(r"'\'", "chr(92)").replace(r"'<\|'", "'<' || chr(92) || '|'")}
