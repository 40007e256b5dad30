"""Yearly files in, standard columns, prices found by pattern, results out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import lexicon

PRICE_PATTERN = r"^[A-Za-z0-9]+[WL]$"
#: The most rows of a task of a source that is spread.
SPREAD_ROWS = 500_000


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _columns(spark: SparkSession, path: str) -> StructType:
    """The columns of one year, from a footer or a header line."""
    reader = spark.read.option("header", True) if path.endswith(".csv") else spark.read
    return reader.csv(path).schema if path.endswith(".csv") else reader.parquet(path).schema


def read_yearly(
    spark: SparkSession, base: str, years: Sequence[int], schema: StructType | None = None, name: str = "matches_{year}.csv"
) -> DataFrame:
    """All years' files or folders, each row tagged ``year``; missing years are skipped, missing columns are null.

    One scan for all years, however many: columns are united from the footers
    first (CSV files by their header lines; files of one order of columns are
    one scan, as CSV goes by place), and the year comes from the path of the
    row's file. ``name`` has ``{year}`` once.
    """
    found = {y: f"{base}/{name.format(year=y)}" for y in years if _exists(spark, f"{base}/{name.format(year=y)}")}
    if not found:
        raise FileNotFoundError(f"no file of {years} under {base}")
    csv = name.endswith(".csv")
    before, after = name.split("{year}")
    year = F.regexp_extract(F.col("_metadata.file_path"), f"/{re.escape(before)}([0-9]+){re.escape(after)}(?:/[^/]*)?$", 1).cast("int").alias("year")

    def scan(paths: Sequence[str], columns: StructType) -> DataFrame:
        reader = spark.read.schema(columns)
        df = reader.csv(list(paths), header=True) if csv else reader.option("recursiveFileLookup", "true").parquet(*paths)
        return df.select(*[F.col(f"`{c}`") for c in columns.names], year)

    if schema is not None and not csv:
        return scan(list(found.values()), schema)
    kinds = {p: _columns(spark, p) for p in found.values()}
    if not csv:
        united = {f.name: f for kind in kinds.values() for f in kind}
        return scan(list(found.values()), StructType([StructField(f.name, f.dataType, True) for f in united.values()]))
    typed = {f.name: f.dataType for f in schema} if schema is not None else {}
    orders: dict[tuple[str, ...], list[str]] = {}
    for path, kind in kinds.items():
        orders.setdefault(tuple(kind.names), []).append(path)
    scans = [scan(paths, StructType([StructField(c, typed.get(c, StringType()), True) for c in names])) for names, paths in orders.items()]
    out = union_years(scans)
    if schema is None:
        return out
    return out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit(None).cast(kind).alias(c) for c, kind in typed.items()], "year")


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def standardize_columns(
    df: DataFrame, rename: Mapping[str, str] = lexicon.ODDS_COLUMNS, required: Sequence[str] = ()
) -> DataFrame:
    """Renames columns by ``rename``, case and outer blanks aside; required text columns are there and never null.

    Where several columns mean the same, each row takes the first that is not
    null, in their order (as text if their types differ).
    """
    meaning = [rename.get(c.lower().strip(), c) for c in df.columns]
    at: dict[str, list[int]] = {}
    for i, name in enumerate(meaning):
        at.setdefault(name, []).append(i)
    kinds = [t for _, t in df.dtypes]
    df = df.toDF(*[f"_{i}" for i in range(len(meaning))])

    def one(places: list[int]) -> Column:
        same = len({kinds[i] for i in places}) == 1
        return F.coalesce(*[F.col(f"_{i}") if same else F.col(f"_{i}").cast("string") for i in places])

    df = df.select(*[one(places).alias(name) for name, places in at.items()])
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in required}
    )


def detect_price_columns(df: DataFrame, pattern: str = PRICE_PATTERN) -> list[str]:
    return [c for c in df.columns if re.match(pattern, c)]


def project_final(
    df: DataFrame,
    base: Sequence[str],
    prices: Sequence[str],
    technical: Sequence[str],
    prefixes: Sequence[str] = ("w_", "l_", "winner_", "loser_"),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Base, price, technical and prefixed columns that are there, each once, renamed for export."""
    wanted = [*base, *prices, *technical, *[c for c in df.columns if c.startswith(tuple(prefixes))]]
    kept = [c for c in dict.fromkeys(wanted) if c in df.columns]
    return df.select(*kept).withColumnsRenamed(dict(rename or {}))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A source whose rows lie in fewer tasks than there are cores goes to all of them, before work that costs more than its shuffle.

    Splits of a file do not tell: those of a large row group are all empty but
    one. So the rows of each split are counted; no task shall have more than
    twice its share. ``by``: columns of many values to deal by, so that the
    shuffle need not sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if not sum(rows) or max(rows) * cores <= 2 * sum(rows):
        return df
    return df.repartition(cores * -(-sum(rows) // (SPREAD_ROWS * cores)), *by)  # whole waves of tasks
