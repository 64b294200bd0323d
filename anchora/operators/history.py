"""Conversations: sequence numbers, headers and bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchora.functions.text import conversation_summary


def sequence_numbers(messages: DataFrame, order: str = "turn") -> DataFrame:
    """Messages with their place in the conversation, from 1."""
    return messages.withColumn("sequence", F.row_number().over(W.partitionBy("conv_id").orderBy(order)).cast("int"))


def conversation_headers(messages: DataFrame) -> DataFrame:
    """(conv_id, summary, first_sequence, last_sequence, n_messages): the summary is of the first message if a user wrote it."""
    first = F.min_by(F.struct("role", "text"), F.col("sequence"))
    h = messages.groupBy("conv_id").agg(first.alias("f"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("n_messages"))
    return h.select("conv_id", F.when(F.col("f.role") == "user", conversation_summary(F.col("f.text"))).alias("summary"), "first_sequence", "last_sequence", "n_messages")


def bounded_history(messages: DataFrame, asked: DataFrame, max_turns: int = 6, max_chars: int = 4000) -> DataFrame:
    """What a reader of message ``sequence`` (asked: conv_id, sequence) sees of the messages before it: the newest
    ``max_turns``, as long as their characters fit; the one at the boundary keeps its last ones; oldest first."""
    before = messages.join(asked.select("conv_id", F.col("sequence").alias("asked")), "conv_id").where("sequence < asked")
    newest = W.partitionBy("conv_id", "asked").orderBy(F.desc("sequence"))
    some = before.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max_turns)
    prior = F.coalesce(F.sum(F.length("text")).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("_prior", prior).where((F.col("_prior") < max_chars) | (F.col("_prior") + F.length("text") <= max_chars))
    keep = F.least(F.length("text"), F.lit(max_chars) - F.col("_prior"))
    return some.withColumn("content", F.when(keep <= 0, "").otherwise(F.expr(f"right(text, least(length(text), {max_chars} - cast(_prior as int)))"))).select("conv_id", "asked", "sequence", "role", "content")


def list_conversations(headers: DataFrame, limit: int = 50) -> DataFrame:
    """Headers, the latest update first."""
    return headers.orderBy(F.desc("last_sequence"), "conv_id").limit(limit)


def get_conversation(messages: DataFrame, conv_id) -> DataFrame:
    """The messages of one conversation by their sequence; an unknown one has none."""
    return messages.where(F.col("conv_id") == F.lit(conv_id)).orderBy("sequence")
