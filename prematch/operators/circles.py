"""Circles of players who meet each other, directly or through others: components of who plays whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import StageTables


def components(edges: DataFrame, a: str, b: str, stages: StageTables | None = None, most_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every end of an edge; ``component`` is the smallest id reachable. Null ends are no vertices.

    Alternating star rounds (Kiveris et al., 2014): every edge moves to its
    larger end's smallest neighbour, so rounds grow with the logarithm of the
    longest path. A round is an aggregation and an equi-join, written before
    the next one starts; minima are combined before their shuffle, so a player
    who meets everyone is no hot group.
    """
    stages = stages or StageTables(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL OR y IS NOT NULL")
    alone = pairs.where("x IS NULL OR y IS NULL OR x = y").select(F.coalesce("x", "y").alias("id"))
    links = pairs.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
    now, before = stages.keep(links, "links"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        ends = now.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")), F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")))).alias("e")).select("e.*")
        least = ends.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = ends.where("u > v").join(least, "v").where("u <> m").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").select(
            F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        )
        now = stages.again(moved.select("e.*").where("hi <> lo").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    rest = alone.distinct().select("id", F.col("id").alias("component")).join(found.select("id"), "id", "left_anti").join(roots.select("id"), "id", "left_anti")
    return found.unionByName(roots).unionByName(rest)


def with_circle(df: DataFrame, w: str = "w", l: str = "l", out: str = "circle", stages: StageTables | None = None) -> DataFrame:  # noqa: E741
    """Adds each event's circle: folds that take it as their pool run in parallel and give the ratings of one fold."""
    found = components(df, w, l, stages).select(F.col("id").alias("_player"), F.col("component").alias(out))
    return df.join(found, F.coalesce(F.col(w), F.col(l)) == F.col("_player"), "left").drop("_player")
