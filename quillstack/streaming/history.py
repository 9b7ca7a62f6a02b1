"""The history of snapshots as a stream: what each one has that the one before hadn't."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstack.operators.changes import filled

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State of queries that are started within it is kept in RocksDB, whose changes go to the checkpoint; the session's setting comes back after."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


class Replay(StatefulProcessor):
    """Holds of each key the last snapshot that had it, and which of its watched columns were filled there."""

    def __init__(self, parts: list[str], new_part: str):
        self.parts, self.new_part = parts, new_part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ordinal long, filled string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        some = pd.concat(list(rows)).sort_values(["ordinal", "seq"], kind="stable").drop_duplicates("ordinal", keep="last")
        held = self.last.get() if self.last.exists() else None
        at, had = (int(held[0]), held[1]) if held else (None, "")
        out = []
        for r in some.itertuples():
            if at is not None and r.ordinal <= at:
                continue  # a snapshot that was told already
            was = had if at is not None and at == r.ordinal - 1 else None
            told = [self.new_part] if was is None else []
            told += [p for i, p in enumerate(self.parts) if r.filled[i] == "1" and (was is None or was[i] == "0")]
            if told:
                out.append((key[0], int(r.ordinal), told))
            at, had = int(r.ordinal), r.filled
        if at is not None:
            self.last.update((at, had))
        yield pd.DataFrame(out, columns=["key", "ordinal", "parts"])

    def close(self) -> None:
        pass


def replay_stream(snapshots: DataFrame, key: str, ordinal: str, watched: dict[str, str], new_part: str, kind: str, seq: str | None = None) -> DataFrame:
    """changes.replay() of snapshots that arrive as a stream (INC-06, INC-03): (key, ordinal, parts, fingerprint).

    A row is compared with its key's in the snapshot just before, if it was there; that is all the state there is.
    Of rows of one key in a snapshot the last by seq counts.  The snapshots of a key must arrive in order, any number
    of them in a micro-batch; one that has been told is not told again.  A key may not be null: such rows are left out.
    """
    flags = F.concat(*(F.when(filled(c), "1").otherwise("0") for c in watched.values())) if watched else F.lit("")
    rows = snapshots.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ordinal).cast("long").alias("ordinal"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"), flags.alias("filled"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    told = rows.groupBy("key").transformWithStateInPandas(Replay(list(watched), new_part), f"key {kind_of_key}, ordinal long, parts array<string>", "Append", "None")
    return told.select(F.col("key").alias(key), F.col("ordinal").alias(ordinal), "parts", F.concat_ws(":", F.lit(kind), F.col("key").cast("string"), F.array_join("parts", "+")).alias("fingerprint"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to a table at path, and stop; the next run goes on where this one ended."""
    spark = stream.sparkSession
    with rocksdb_state(spark):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
