"""Shared-folder tables, scoped settings and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker gets at once, where this subpackage runs the job.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``.

    Only where the session has none, on one machine (tests), a temporary
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that the cluster shares in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` into the shared folder and read it again.

    Shuffle files of the write are dropped as soon as it has ended, since the
    written table is all that later steps read. Python workers get small
    batches, so their memory does not follow the length of texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scoped(spark, {_CLEAN_SHUFFLES: "true", _BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """The batches of :func:`written` for the rest of the session, for jobs that its user runs."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later step reads."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scoped(spark: SparkSession, conf: dict[str, str]):
    """Settings for the actions inside the block, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)``; component: the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A
    round only joins each edge to its vertex's smallest neighbour, so a vertex
    with very many edges is a skewed equi-join that AQE splits, and the
    minimum is combined before its shuffle. Vertices without a link to another
    vertex are absent.
    """
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    mark = None
    for _ in range(max_rounds):
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        ).select("e.a", "e.b")
        old, cur = cur, written(small.where("a <> b").distinct(), "cc")
        discard(old)
    else:
        raise RuntimeError("connected_components did not settle")
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
