"""Tables in the shared folder: intermediates that cut lineage, and named tables whose versions are swapped whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``; only a local master does without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="feedweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/feedweave/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, whatever is lost later."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table kept as numbered versions below one folder; the newest whole one counts.

    A version is written beside the others and only then given its final name by one rename, so readers see the old or the new version and
    never a part; a writer that dies leaves a folder that nobody reads.  Two writers can't take the same number: the second one's
    rename fails.  Versions older than the one before are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> int:
        """Makes ``rows``, which may read this table, its next version; returns the version's number."""
        before = self.versions()
        number, draft = (before[-1] if before else 0) + 1, f"{self.folder}/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        target = self.path(f"{self.folder}/v={number}")
        if self.files.exists(target) or not self.files.rename(self.path(draft), target):
            self.files.delete(self.path(draft), True)
            raise RuntimeError(f"version {number} of {self.folder} was written by another")
        for old in before[:-1]:
            self.files.delete(self.path(f"{self.folder}/v={old}"), True)
        return number
