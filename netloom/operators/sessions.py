"""Conversation log: exchanges and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.ranking import running_rank

# Turns per bucket when numbering the exchanges of one session.
SESSION_BUCKET = 4096
# An exchange id is the conversation above 32 bits of turn; a conversation
# beyond 31 bits ends the job with an overflow instead of a wrong id.
TURNS = 1 << 32


def build_exchanges(turns: DataFrame) -> DataFrame:
    """Pairs each user turn with the assistant turn that follows it.

    The pairing is an equi join on (conversation, turn), so a very long
    conversation spreads over all tasks.  Sequence numbers start at 1.
    """
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_message"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_message"))
    pairs = asked.join(answered, ["conv_id", "turn"])
    ranked = running_rank(
        pairs, ["conv_id"], F.floor(F.col("turn") / SESSION_BUCKET), [F.col("turn")], "sequence")
    return ranked.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.col("conv_id").alias("session_id"), "sequence", "user_message", "assistant_message")


def new_sessions(turns: DataFrame, known: DataFrame) -> DataFrame:
    """Session ids not stored yet (inserted once)."""
    return turns.select(F.col("conv_id").alias("id")).distinct().join(
        known.select("id"), "id", "left_anti")


def list_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def get_session(sessions: DataFrame, exchanges: DataFrame, session_id=None) -> DataFrame:
    """Sessions with their exchanges in order; an unknown id gives no row.

    The result holds a session in one row, as asked for.
    """
    wanted = sessions if session_id is None else sessions.where(F.col("id") == session_id)
    own = exchanges if session_id is None else exchanges.where(F.col("session_id") == session_id)
    packed = own.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(
        "sequence", F.col("id").alias("exchange_id"), "user_message", "assistant_message")))
        .alias("exchanges"))
    none = F.array().cast(packed.schema["exchanges"].dataType)
    return wanted.join(packed, "id", "left").withColumn("exchanges", F.coalesce("exchanges", none))


def with_context(hits: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Adds the exchanges before and after each hit, NULL at the edges."""
    def neighbour(shift: int, name: str) -> DataFrame:
        return exchanges.select(
            "session_id", (F.col("sequence") + shift).alias("sequence"),
            F.struct("id", "user_message", "assistant_message").alias(name))

    keys = ["session_id", "sequence"]
    return hits.join(neighbour(1, "previous"), keys, "left").join(neighbour(-1, "next"), keys, "left")


def pending_batch(exchanges: DataFrame, n: int = 20) -> DataFrame:
    return exchanges.where("extracted_at is null").orderBy("id").limit(n)


def render_transcript(sessions: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Aligned text of each session."""
    def moment(c):
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")

    full = get_session(sessions, exchanges)
    size = F.length(F.size("exchanges").cast("string"))
    lines = F.transform("exchanges", lambda e: F.concat(
        F.lit("["), F.lpad(e["sequence"].cast("string"), size, " "), F.lit("] user:      "),
        F.replace(F.regexp_replace(e["user_message"], r"\s+$", ""), F.lit("\n"),
                  F.concat(F.lit("\n"), F.repeat(F.lit(" "), size + 2 + len("user:     ")))),
        F.lit("\n    assistant: "),
        F.replace(F.regexp_replace(e["assistant_message"], r"\s+$", ""), F.lit("\n"),
                  F.lit("\n" + " " * len("    assistant: ")))))
    head = F.concat(
        F.lit("== Session "), F.col("id").cast("string"), F.lit(" ("),
        F.concat_ws(", ", F.col("source"), F.nullif(F.col("client_name"), F.lit("")),
                    F.concat(F.lit("started "), moment("started_at")),
                    F.concat(F.lit("ended "), moment("ended_at"))), F.lit(") =="))
    body = F.when(F.size("exchanges") == 0, F.lit("(no exchanges)")).otherwise(F.array_join(lines, "\n"))
    return full.select("id", F.concat(head, F.lit("\n"), body).alias("transcript"))
