"""Answers that are computed once per key and kept for a while: look up, compute what is missing, write back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators.tables import VersionedTable, stored


class AnswerCache:
    """A table ``key, answer, written`` (seconds), changed one whole version at a time.

    An answer is kept for ``ttl`` seconds, if ``worth_keeping`` holds for its key and itself; the same test holds when it is read, so that an
    entry spoilt since counts as missing.  With ``most``, only so many of the newest entries stay.
    """

    def __init__(self, spark: SparkSession, folder: str, answer: str, ttl: int, worth_keeping: Callable[[Column, Column], Column] | None = None, most: int | None = None):
        self.table = VersionedTable(spark, folder, f"key string, answer {answer}, written long")
        self.ttl, self.most = ttl, most
        self.worth_keeping = worth_keeping or (lambda key, answer: answer.isNotNull())

    def fresh(self, now: int) -> DataFrame:
        """The entries that may still be given out; an entry of exactly the age ``ttl`` may not."""
        kept = F.coalesce(self.worth_keeping(F.col("key"), F.col("answer")), F.lit(False))
        return self.table.read().where((F.lit(now) - F.col("written") < self.ttl) & kept)

    def write(self, answers: DataFrame, now: int) -> int:
        """Adds ``answers(key, answer)``, which replace older ones of their keys; what has expired goes.  Returns the version's number."""
        kept = F.coalesce(self.worth_keeping(F.col("key"), F.col("answer")), F.lit(False))
        new = answers.where(kept & F.col("key").isNotNull()).select("key", "answer", F.lit(now).cast("long").alias("written"))
        rows = self.fresh(now).join(new.select("key"), "key", "left_anti").select("key", "answer", "written").union(new)
        return self.table.replace(rows.orderBy(F.desc("written"), "key").limit(self.most) if self.most else rows)

    def ask(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
        """``requests`` with ``answer`` and ``hit``.

        ``requests`` holds a ``key`` and whatever ``compute`` needs; of rows that share a key the smallest asks for all.  ``compute`` gets only the
        keys without a fresh entry, each once, and returns ``key, answer``; it isn't called at all if nothing is missing.  Keys that it leaves
        out, and rows without a key, get a null answer.
        """
        found = stored(self.fresh(now).join(requests.select("key").distinct(), "key", "left_semi").select("key", "answer", F.lit(True).alias("hit")))
        names = [c for c in requests.columns if c != "key"]
        missing = requests.where("key is not null").join(found.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct(*names)).alias("first"))
        missing = stored(missing.select("key", "first.*"))
        if not missing.isEmpty():
            computed = stored(compute(missing).select("key", "answer"))
            self.write(computed, now)
            found = found.union(computed.withColumn("hit", F.lit(False)))
        return requests.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
