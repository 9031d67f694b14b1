"""Tables as they would arrive: slice by slice, out of order within a bound, closed by one last event."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from feedweave.operators.tables import shared_folder

CLOSING = "2200-01-01 00:00:00"


def arriving(slices: Iterable[DataFrame], closing: dict, late: str = "10 minutes", files: int = 1) -> DataFrame:
    """A stream of ``slices``, one in each trigger, its column ``ts`` as event time with a watermark of ``late``.

    ``closing`` names the values of the last row, whose time lies beyond all others: it moves the watermark past everything, so that what waits
    for time to pass is given out.  Give it a key of its own, not null: filters on the key are applied before the watermark sees a row.

    The source counts files, so each slice is written in just as many: in ``files``, by as many tasks, or, if one is too small for that, all in one.
    """
    slices = [s.withColumn("ts", F.col("ts").cast("timestamp")) for s in slices]
    spark, schema = slices[0].sparkSession, slices[0].schema
    last = spark.createDataFrame([Row(**{f.name: closing.get(f.name) for f in schema.fields if f.name != "ts"})], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name != "ts"))
    last = last.withColumn("ts", F.lit(CLOSING).cast("timestamp")).select(*(f.name for f in schema.fields))
    folder = _written(slices, files) if files > 1 else None
    if folder is None:
        folder, files = _written(slices, 1), 1
    last.coalesce(1).write.parquet(f"{folder}/slice={len(slices)}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slice=*").withWatermark("ts", late)


def _written(slices: list[DataFrame], files: int) -> str | None:
    """The folder with each slice in ``files`` files; None if one of them fills fewer."""
    spark, folder = slices[0].sparkSession, shared_folder(slices[0].sparkSession)
    for i, rows in enumerate(slices):  # one slice after the other: the source takes files by age
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(f"{folder}/slice={i}")
        if files > 1 and len(spark.read.schema(rows.schema).parquet(f"{folder}/slice={i}").inputFiles()) != files:
            return None
    return folder


def shuffled(events: DataFrame, slices: int, late_seconds: int = 600, most: int | None = None) -> list[DataFrame]:
    """``events(event_id, ts, …)`` by time of arrival, which is up to ``late_seconds`` after their own, in slices of equal time.

    With ``most``, more events than ``slices`` times as many come in more slices, of about ``most`` rows each: what waits of a key is no more.
    """
    came = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late_seconds * 1_000_000))
    bounds = events.agg(F.min(came).alias("a"), F.max(came).alias("b"), F.count("*").alias("n")).first()
    if bounds["a"] is None:
        return [events]
    if most and bounds["n"] > slices * most:
        return _filled(events, came, -(-bounds["n"] // most))
    span = (bounds["b"] - bounds["a"]) // slices + 1
    return [events.where(F.floor((came - bounds["a"]) / span) == i) for i in range(slices)]


def _filled(events: DataFrame, came: Column, slices: int) -> list[DataFrame]:
    """``events`` by ``came`` in ``slices`` of about equal size, written at once so that each is read by itself."""
    cuts = events.agg(F.percentile_approx(came, [i / slices for i in range(1, slices)], 100 * slices)).first()[0]
    part = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(cuts)))), lambda x: x <= came))
    folder = shared_folder(events.sparkSession)
    events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
    found = events.sparkSession.read.schema(StructType([*events.schema.fields, StructField("part", IntegerType())])).parquet(folder)
    return [found.where(F.col("part") == i).drop("part") for i in range(len(set(cuts)) + 1)]


