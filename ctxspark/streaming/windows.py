"""Structured Streaming forms: tumbling and session windows, deduplication, and the stateful conversation window."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(folder: str, name: str) -> str:
    """The table `name` of a folder, one file or a folder of part files, as a pattern: a stream takes a file only so."""
    return f"{folder}/[{name[0]}]{name[1:]}"


def event_stream(spark, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Events as they arrive in a folder; ts becomes a timestamp, which a watermark needs."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 day", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def conversation_window(turns: DataFrame, max_tokens: int) -> DataFrame:
    """(conv_id, turns, tokens) of the sliding window after each micro-batch; state is the window itself."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, total = (deque(state.get[0]), sum(state.get[0])) if state.exists else (deque(), 0)
        parts = [(f["turn"].to_numpy(), f["tokens"].to_numpy()) for f in frames]  # a key's turns of one micro-batch, which has a bounded size
        turn, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        for t in tokens[np.argsort(turn, kind="stable")].tolist():
            held.append(min(int(t), max_tokens))
            total += held[-1]
            while total > max_tokens:
                total -= held.popleft()
        state.update((list(held),))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [len(held)], "tokens": [total]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return turns.select("conv_id", "turn", "tokens").groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turns long, tokens long", "held array<long>", "update", GroupStateTimeout.NoTimeout)


def expiring(events: DataFrame, key: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, n, last): keys as their last event is `seconds` old by the watermark; until then they are held as state."""
    kind = events.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n, last = n + len(f), max(last, int(f["ts"].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    from pyspark.sql.streaming.state import GroupStateTimeout

    stamped = events.withWatermark("ts", late)
    return stamped.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, last timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def merge_batches(stream: DataFrame, folder: str, checkpoint: str, apply: Callable[[DataFrame, str], None]) -> None:
    """Runs apply(batch, folder) for each micro-batch of what there is now, once each: a batch that is repeated after a
    failure is skipped where its mark is there already."""
    from ..sources.stores import replace_text

    spark = stream.sparkSession

    def once(batch: DataFrame, number: int) -> None:
        mark = f"{folder}/_batches/{number}"
        path = spark._jvm.org.apache.hadoop.fs.Path(mark)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            apply(batch, folder)
            replace_text(spark, mark, "done")

    q = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what there is now and returns what it wrote to `folder`, which all executors share: all rows
    in append mode, the last state of the table in complete mode, the last row of each key in update mode. No rows come
    of a stream that has none."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/_batch_{number}".replace("/_batch_", "/b"))

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    path = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    path.getFileSystem(stream.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # there may have been no batch
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    if mode == "complete":
        return rows.join(rows.agg(F.max("_batch").alias("_batch")), "_batch", "left_semi").drop("_batch")
    if mode == "update" and keys:
        others = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("v")).select(*keys, "v.*")
    return rows.drop("_batch")
