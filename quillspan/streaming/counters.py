"""Counters of needs as keyed state of a stream: what comes again adds up, what is replayed doesn't."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspan.functions.text import normalised, short_hash

_COUNTER = "need string, occurrences long, first_seen timestamp, last_seen timestamp, context string, context_at timestamp"
COUNTED = "key string, need string, occurrences long, first_seen timestamp, last_seen timestamp, context string"


class NeedCounter(StatefulProcessor):
    """One need: its first wording, how often, the first and last time, and the last context that isn't empty.

    An id counts once: ids that have come are kept in a map of the key's
    state, so a batch that runs again, or a line that is sent twice, changes
    nothing. Rows may come in any order; ties of time go to the greater text.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", _COUNTER)
        self.seen = handle.getMapState("seen", "id string", "one int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.counter.get() if self.counter.exists() else None
        state = list(held) if held is not None else [None, 0, None, None, None, None]
        changed = False
        for df in rows:
            for id_, need, context, at in zip(df["id"], df["need"], df["context"], df["at"]):
                if self.seen.containsKey((id_,)):
                    continue
                self.seen.updateValue((id_,), (1,))
                changed = True
                at = at.to_pydatetime()
                state[1] += 1
                if state[2] is None or (at, need) < (state[2], state[0]):
                    state[0], state[2] = need, at
                state[3] = at if state[3] is None else max(at, state[3])
                text = context.strip() if isinstance(context, str) else ""
                if text and (state[5] is None or (at, text) > (state[5], state[4])):
                    state[4], state[5] = text, at
        if changed:
            self.counter.update(tuple(state))
            yield pd.DataFrame([(key[0], *state[:5])], columns=["key", "need", "occurrences", "first_seen", "last_seen", "context"])

    def close(self) -> None:
        pass


def counted_stream(requests: DataFrame) -> DataFrame:
    """The counters that a batch changed, of a stream of requests (id, need, context, at); in update mode the last row of a key holds.

    The session's state store must be RocksDB's, as keyed state asks for.
    """
    keyed = requests.select(short_hash(normalised(F.col("need"))).alias("key"), F.col("id").cast("string").alias("id"), "need", "context", F.col("at").cast("timestamp").alias("at"))
    return keyed.groupBy("key").transformWithStateInPandas(NeedCounter(), COUNTED, "Update", "None")


def counted(requests: DataFrame) -> DataFrame:
    """The same counters of a table, by partial aggregates."""
    once = requests.select(short_hash(normalised(F.col("need"))).alias("key"), F.col("id").cast("string").alias("id"), "need", F.nullif(F.trim("context"), F.lit("")).alias("context"), F.col("at").cast("timestamp").alias("at"))
    once = once.groupBy("key", "id").agg(F.min(F.struct("at", "need")).alias("f"), F.max(F.when(F.col("context").isNotNull(), F.struct("at", "context"))).alias("c"))
    return once.groupBy("key").agg(F.min("f").alias("f"), F.count("*").alias("occurrences"), F.max("f.at").alias("last_seen"), F.max("c").alias("c")).select("key", F.col("f.need").alias("need"), "occurrences", F.col("f.at").alias("first_seen"), "last_seen", F.col("c.context").alias("context"))


def run(counted_: DataFrame, to: str, checkpoint: str):
    """Runs counted_stream() over what its source holds now. Each batch has a folder of its own under `to`, written anew if the batch runs again."""
    spark = counted_.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return counted_.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(written: DataFrame) -> DataFrame:
    """The last row of each key of what run() wrote."""
    columns = [c for c in written.columns if c not in ("key", "batch")]
    return written.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("key", "r.*")
