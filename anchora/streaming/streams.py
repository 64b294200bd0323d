"""Incremental forms: replies extracted as they come, and messages numbered per conversation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from anchora.operators.anchor import extract_claims

NUMBERED = "conv_id long, sequence long, role string, text string"


def stream_extract(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcomes of a stream of replies (key, reply) against the static source table; stateless, for an append sink."""
    return extract_claims(replies, sources)


def _number(key: tuple, frames, state: GroupState):
    """A micro-batch's messages of one conversation, numbered on from the highest number so far, which is the state."""
    last = state.get[0] if state.exists else 0
    batch = pd.concat(list(frames)).sort_values("arrival", kind="stable")
    batch["sequence"] = range(last + 1, last + 1 + len(batch))
    state.update((last + len(batch),))
    yield batch[["conv_id", "sequence", "role", "text"]]


def stream_append_messages(messages: DataFrame) -> DataFrame:
    """A stream of messages (conv_id, arrival, role, text) with the next sequence number of their conversation.

    A conversation has one owner, so numbers never conflict; within a micro-batch ``arrival`` orders them. The state is one
    number a conversation; a micro-batch's messages of one conversation meet in memory, so its size bounds that."""
    return messages.groupBy("conv_id").applyInPandasWithState(_number, NUMBERED, "last long", "append", "NoTimeout")


def drained(stream: DataFrame, path: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(stream)`` over all that is there now, appended to ``path``/out as Parquet, and what lies there then.

    Offsets and state are kept in ``path``/state: after a stop, or with more input, the next call goes on where the last
    batch was committed. Readers see committed batches only."""
    q = run(stream).writeStream.option("checkpointLocation", f"{path}/state").format("parquet").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.parquet(f"{path}/out")
