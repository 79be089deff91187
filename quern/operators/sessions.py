"""Chat sessions: messages, windows of recent turns, idle sessions, and follow-up questions made complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import stripped, words

#: Messages a session keeps, seconds after which it is forgotten, words of a question that needs no
#: history, words of a short follow-up.
KEEP, IDLE_SECONDS, COMPLETE_WORDS, SHORT_WORDS = 20, 6 * 3600, 6, 7
# Word boundaries are spelt out: engines differ in whether \b knows letters beyond ASCII.
_REFERS = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(?:he|him|his|she|her|hers|it|its|they|them|their|these|those|this|that|tell me more|more info|more details|explain more|what else)(?:$|[^\p{L}\p{N}_])"
    r"|^(?:what about|and|how about|what is|tell me)(?:$|[^\p{L}\p{N}_])"
)


def messages_of(chats: DataFrame, key: str, text: str) -> DataFrame:
    """``session_id, turn, role, message`` from transcripts in which a line opens a turn with ``user:``,
    ``assistant:`` or ``system:``; other lines go on with the turn. Lines before the first turn are dropped."""
    lines = chats.where(F.col(text).isNotNull()).select(F.col(key).alias("session_id"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line"))
    opens = F.regexp_extract("line", r"^\s*(user|assistant|system):", 1)
    order = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("role", F.nullif(opens, F.lit(""))).withColumn("turn", F.count("role").over(order)).where("turn > 0")
    part = F.struct("pos", F.regexp_replace("line", r"^\s*(user|assistant|system):\s*", "").alias("line"))
    return rows.groupBy("session_id", "turn").agg(
        F.max("role").alias("role"), stripped(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["line"]), "\n")).alias("message")
    )


def last_messages(messages: DataFrame, keep: int = KEEP, session: str = "session_id", order: list[Column] | None = None) -> DataFrame:
    """The ``keep`` latest messages of each session; the rank filter cuts each task's part before the shuffle."""
    w = Window.partitionBy(session).orderBy(*(order or [F.desc("turn")]))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def sessions(events: DataFrame, user: str, ts: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """``user, session_no, started, ended, n_events``: a gap of more than ``idle_seconds`` begins a new session; a
    gap of exactly that doesn't. Events without user or time are left out."""
    known = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    w = Window.partitionBy(user).orderBy(ts)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double")
    marked = known.withColumn("_new", F.when(gap > idle_seconds, 1).otherwise(0))
    numbered = marked.withColumn("session_no", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(F.col(user).alias("user_id"), "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))


def rewritten(messages: DataFrame) -> DataFrame:
    """User messages as stand-alone questions: ``session_id, turn, message, question``.

    A question of fewer than six words, with two messages or more before it, gets the latest different user message
    in brackets behind it.
    """
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    bare = stripped(F.coalesce("message", F.lit("")))
    rows = messages.withColumn("bare", bare).withColumn("before", F.count("*").over(w))
    # Equal messages in a row collapse, so that the latest user message before a different one is at hand.
    users = rows.where("role = 'user'")
    u = Window.partitionBy("session_id").orderBy("turn")
    users = users.withColumn("prev", F.lag("bare").over(u)).withColumn("same", F.lower("prev") == F.lower("bare"))
    run = F.last(F.when(F.coalesce(~F.col("same"), F.lit(True)), F.col("prev")), ignorenulls=True).over(u.rowsBetween(Window.unboundedPreceding, 0))
    short = (F.size(F.split("bare", r"\s+")) < COMPLETE_WORDS) & (F.col("before") >= 2) & (F.col("bare") != "")
    users = users.withColumn("prior", run)
    question = F.when(short & F.col("prior").isNotNull() & (F.col("prior") != "") & (F.lower("prior") != F.lower("bare")), F.concat(F.col("bare"), F.lit(" ("), F.col("prior"), F.lit(")"))).otherwise(F.col("bare"))
    return users.select("session_id", "turn", "message", question.alias("question"))


def needs_history(question: Column) -> Column:
    """Whether a question refers back or is too short to stand alone."""
    return question.rlike(_REFERS) | (F.size(words(question)) <= SHORT_WORDS)


def formatted_history(messages: DataFrame) -> DataFrame:
    """``session_id, history``: the turns of users and assistants as lines, Markdown links unwrapped."""
    said = F.regexp_replace("message", r"\[([^\]]+)\]\([^\)]+\)", "$1")
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.col("message"))).when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), said))
    rows = messages.withColumn("line", line).where("line is not null")
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("history"))
