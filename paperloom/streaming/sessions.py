"""The memory of sessions as keyed state: turns in their order however late they come, clearing, and expiry.

A session's state holds its last messages by their turn numbers, so a turn that
comes late takes its place, and one that comes again changes nothing. A row with the
role ``clear`` forgets all turns up to its own, those that are still to come too. A
session that is quiet for longer than its time to live is forgotten by the state
store itself.

Defined results: roles other than user and assistant, and null turns or texts, are
left out; of two messages with the same turn number the one that came last counts;
a session without messages (cleared ones too) has an empty memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions import rules as R
from paperloom.sources.buckets import Bucketed

SHOWN = {"user": "User: ", "assistant": "Assistant: "}
MEMORY = "conv_id long, n_messages long, memory string"


class Memory(StatefulProcessor):
    """The last 2 * ``exchanges`` messages of a session; ``ttl``: milliseconds after which an untouched message is forgotten."""

    def __init__(self, exchanges: int, ttl: int | None) -> None:
        self.exchanges, self.ttl = exchanges, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn long", "role string, text string", self.ttl)
        self.cleared = handle.getValueState("cleared", "turn long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        upto = self.cleared.get()[0] if self.cleared.exists() else None
        kept = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        before = dict(kept)
        for frame in rows:
            known = frame[frame["turn"].notna()]
            for turn, role, text in zip(known["turn"].astype("int64").tolist(), known["role"], known["text"], strict=True):
                if role == "clear":
                    upto = turn if upto is None else max(upto, turn)
                elif role in SHOWN and text is not None:
                    kept[turn] = (role, text)
        kept = {t: m for t, m in kept.items() if upto is None or t > upto}
        kept = {t: kept[t] for t in sorted(kept)[-2 * self.exchanges :]}
        for turn in before.keys() - kept.keys():
            self.turns.removeKey((turn,))
        for turn, message in kept.items():
            self.turns.updateValue((turn,), message)
        if upto is not None:
            self.cleared.update((upto,))
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(kept)], "memory": ["\n".join(SHOWN[role] + text for role, text in kept.values())]})

    def close(self) -> None:
        pass


def memory(turns: DataFrame, exchanges: int = R.EXCHANGES, ttl: int | None = None) -> DataFrame:
    """conv_id, n_messages, memory of each session that a batch of turns (conv_id, turn, role, text) touches."""
    known = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return known.groupBy("conv_id").transformWithStateInPandas(Memory(exchanges, ttl), MEMORY, "Update", "ProcessingTime" if ttl else "None")


def stateful(spark: SparkSession) -> SparkSession:
    """A session for streams with such state, which Spark keeps in RocksDB; the caller's settings stay as they are."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if value := spark.conf.get(key, None):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def follow(turns: DataFrame, table: Bucketed, checkpoint: str, exchanges: int = R.EXCHANGES, ttl: int | None = None) -> StreamingQuery:
    """Keeps each session's memory in a bucketed table by conv_id: of the turns that there are, or, with a time to live, until it is stopped, as time alone changes the state then."""

    def step(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)

    writer = memory(turns, exchanges, ttl).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="1 second") if ttl else writer.trigger(availableNow=True)).start()
