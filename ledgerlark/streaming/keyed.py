"""Keyed streaming state: what a stream remembers of a key is looked up and replaced for the keys of a batch only.

The state lives in RocksDB on the executors' disks and in the checkpoint, so it may be larger than memory and
survives a restart; a batch that is run again starts from the state before it. The current state of all
keys is read from the checkpoint, so there is no table beside it that would have to be kept in step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlark.operators.inbox import ORG, PREVIEW_LENGTH

CHAT = [ORG, "chat_id"]
#: stands for a missing time; older than all others
NEVER = -(2**63)


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """key and value of a state variable after the last batch, one task for each partition of the state."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


# ---- chats ---------------------------------------------------------------------------------


class Chat(StatefulProcessor):
    """Summary of a chat: its latest message, and the inbound ones after the last outbound one.

    Messages may come in any order. The times of unread messages are kept with their numbers, so that an
    outbound message takes away those before it and no others, however late it comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "at long, id string, direction string, preview string, outbound long, unread long")
        self.times = handle.getMapState("times", "at long", "n long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        held = self.head.get()
        last, outbound, unread = (tuple(held[:4]), held[4], held[5]) if held is not None else (None, NEVER, 0)
        out = frame["direction"] == "outbound"
        newest = max(outbound, int(frame.loc[out, "at"].max())) if out.any() else outbound
        if newest > outbound:
            read = [(at, n) for (at,), (n,) in self.times.iterator() if at <= newest]
            for at, n in read:
                self.times.removeKey((at,))
                unread -= n
        coming = frame.loc[(frame["direction"] == "inbound") & ((frame["at"] > newest) | (newest == NEVER)), "at"]
        for at, n in coming.value_counts().items():
            before = self.times.getValue((int(at),)) if self.times.containsKey((int(at),)) else None
            self.times.updateValue((int(at),), (int(n) + (before[0] if before is not None else 0),))
            unread += int(n)
        for row in frame[["at", "id", "direction", "preview"]].itertuples(index=False):
            it = (int(row.at), *(None if pd.isna(x) else x for x in row[1:]))
            if last is None or (it[0], it[1] or "") > (last[0], last[1] or ""):
                last = it
        self.head.update((*last, newest, unread))
        yield pd.DataFrame({ORG: [key[0]], "chat_id": [key[1]], "at": [last[0]], "preview": [last[3]], "direction": [last[2]], "outbound": [newest], "unread_count": [unread]})

    def close(self) -> None:
        pass


def _shown(rows: DataFrame) -> DataFrame:
    time = lambda c: F.timestamp_micros(F.when(F.col(c) != NEVER, F.col(c)))
    return rows.select(
        *CHAT, time("at").alias("last_message_at"), F.col("preview").alias("last_message_preview"), F.col("direction").alias("last_direction"),
        time("outbound").alias("last_outbound_at"), "unread_count",
    )


def thread_summary(messages: DataFrame) -> DataFrame:
    """The summaries of the chats that a batch of the message stream touches, in update mode.

    An outbound message resets the unread count to the inbound ones after it, as the batch form does over
    all messages, whatever the order of arrival.
    """
    rows = messages.select(
        *CHAT, F.coalesce(F.unix_micros("sent_at"), F.lit(NEVER)).alias("at"), "id", "direction", F.substring("body", 1, PREVIEW_LENGTH).alias("preview")
    )
    schema = f"{ORG} string, chat_id string, at long, preview string, direction string, outbound long, unread_count long"
    return _shown(rows.groupBy(*CHAT).transformWithStateInPandas(Chat(), schema, "Update", "None"))


def thread_summaries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The summaries of all chats, as the stream with that checkpoint has left them."""
    rows = read_state(spark, checkpoint, "head")
    return _shown(rows.select(*(F.col(f"key.{c}").alias(c) for c in CHAT), "value.at", "value.preview", "value.direction", "value.outbound", F.col("value.unread").alias("unread_count")))
