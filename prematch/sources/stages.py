"""Tables that a job writes once and reads many times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``.

    Only where the session has none, on one machine (tests), a temporary
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a folder that the cluster shares in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While a table is written, no step runs in a generated method so long (8,000 bytes) that the JVM only interprets it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class StageTables:
    """The stage tables of one job: :meth:`keep` cuts lineage, :meth:`drop` and :meth:`close` delete what has been read.

    A stage table is computed once, whatever reads it later, and survives lost
    executors. ``with StageTables(spark) as stages`` deletes all at the end, so
    what a job gives back is written or collected inside the block.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        """A place for a table of that name; every call gives another one."""
        self._paths[name] = f"{self.base}/{name}-{uuid.uuid4().hex[:12]}"
        return self._paths[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read again."""
        path = self.path(name)
        with compiled(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def again(self, df: DataFrame, name: str) -> DataFrame:
        """As :meth:`keep`, in place of the last table of that name, which ``df`` may read."""
        old = self._paths.get(name)
        kept = self.keep(df, name)
        if old:
            delete(self.spark, old)
        return kept

    def drop(self, *names: str) -> None:
        """Delete the last tables of these names."""
        for name in names:
            delete(self.spark, self._paths.pop(name))

    def close(self) -> None:
        self._paths.clear()
        delete(self.spark, self.base)

    def __enter__(self) -> StageTables:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
