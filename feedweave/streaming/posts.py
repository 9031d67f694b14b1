"""The same steps on streams: sessions, deduplication and progressive state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from feedweave.operators.tables import shared_folder

LEAST_STATES = 32


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark: ``timestamp_ntz`` can't carry one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(key)


def states(spark: SparkSession) -> int:
    """Parts of a stream's state: what is set for shuffles, but no more than keep all cores at work.

    Each costs a task in each trigger, with a store to open and to commit and often a Python worker, about half a second without any row.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_STATES, 4 * spark.sparkContext.defaultParallelism))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a bounded stream gives out, batch by batch in Parquet in the shared folder; of a complete mode, the last batch."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that is repeated writes the same folder

    # keyed state with timers needs this store; it keeps large state off the heap
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(states(spark))}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    running.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    found = found.drop("batch")
    found.state_rows = [sum(o.numRowsTotal for o in p.stateOperators) for p in running.recentProgress]  # held after each trigger
    return found


def progressive(events: DataFrame) -> DataFrame:
    """``post_id, text, author_name, n`` after each batch: the last text and author that aren't empty."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, author, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for t, a in zip(rows["text"], rows["author_name"]):
            text, author, n = t or text, a or author, n + 1
        state.update((text, author, n))
        yield pd.DataFrame({"post_id": [key[0]], "text": [text], "author_name": [author], "n": [n]})

    fields = "text string, author_name string, n long"
    return events.groupBy("post_id").applyInPandasWithState(step, f"post_id long, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
