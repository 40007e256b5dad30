"""Contest tables derived from the order tables: one SQL text that Spark and DuckDB both run.

Integer arithmetic only, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

#: Players of a circle; circles play among themselves, and their number grows with the customers.
PLAYERS, CIRCLE = 50, 150

_DIGIT = "CAST(substr(o_orderpriority, 1, 1) AS INT)"


def _price(factor: int, span: int) -> str:
    return f"CAST(101 + (o_orderkey * {factor}) % {span} AS DOUBLE) / 100"


_DRAWN = f"""
SELECT *, CAST(floor(o_custkey / {CIRCLE}) AS BIGINT) AS circle, o_custkey % {PLAYERS} AS w_id, (o_custkey * 7 + o_orderkey) % {PLAYERS} AS l_id, {_DIGIT} AS digit FROM {{orders}}
WHERE o_custkey % {PLAYERS} <> (o_custkey * 7 + o_orderkey) % {PLAYERS}
"""

MATCHES = f"""
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, circle, w_id, l_id,
 'p' || CAST(circle * {PLAYERS} + w_id AS STRING) AS w, 'p' || CAST(circle * {PLAYERS} + l_id AS STRING) AS l,
 CASE o_orderstatus WHEN 'F' THEN 'hard' WHEN 'O' THEN 'clay' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'sand' ELSE 'grass' END END AS surface,
 o_orderstatus AS pool,
 CASE digit WHEN 1 THEN 'F' WHEN 2 THEN 'SF' WHEN 3 THEN 'QF' WHEN 4 THEN 'R16' ELSE 'R32' END AS rnd,
 CAST(CASE digit WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE 3 END AS INT) AS round_ord,
 CAST(1 + o_custkey % 3 AS INT) AS level_ord,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {_price(37, 400)} END AS PSW,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 25 = 1 THEN {_price(37, 400)} ELSE {_price(53, 400)} END AS PSL,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_price(29, 300)} END AS AvgW,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_price(31, 300)} END AS AvgL,
 CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE CAST(95 + (o_orderkey * 41) % 300 AS DOUBLE) / 100 END AS B365W,
 CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE {_price(43, 300)} END AS B365L,
 CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(1 + o_custkey % 300 AS DOUBLE) END AS w_rank,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(1 + (o_custkey * 7 + o_orderkey) % 400 AS DOUBLE) END AS l_rank,
 CASE o_orderkey % 7 WHEN 0 THEN '5' WHEN 1 THEN '3' WHEN 2 THEN 'five' WHEN 3 THEN '5.0' WHEN 4 THEN ' 5 ' WHEN 5 THEN '' ELSE NULL END AS best_of_text,
 CASE o_orderkey % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE) ELSE NULL END AS best_of,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(180 + (o_custkey * 3) % 190 AS DOUBLE) / 10 END AS w_age,
 CAST(180 + (o_orderkey * 7) % 190 AS DOUBLE) / 10 AS l_age,
 CASE o_orderkey % 6 WHEN 0 THEN 'Grand Slam' WHEN 1 THEN 'ATP Masters 1000' WHEN 2 THEN 'ATP-500' WHEN 3 THEN 'Exhibition' ELSE '' END AS series,
 CASE o_orderkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'D' WHEN 2 THEN 'X' ELSE '' END AS code,
 CASE o_custkey % 8 WHEN 0 THEN 'Roland Garros' WHEN 1 THEN 'US Open' WHEN 2 THEN 'Indian Wells Masters' WHEN 3 THEN 'Wien'
  WHEN 4 THEN 'São Paulo' WHEN 5 THEN 'Davis Cup' WHEN 6 THEN 'St. Petersburg' ELSE 'Queen''s Club' END AS tourney
FROM ({_DRAWN})
"""

_FIRST = ("Alexandr", "Rafael", "Jo-Wilfried", "Kei", "Andrés", "Björn", "Stan", "Novak", "Łukasz", "Juan Martin")
_LAST = ("Dolgopolov", "Muñoz", "Tsonga", "Del Potro", "Søderling")


def _name(k: str) -> str:
    first = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FIRST))
    return f"CASE {k} % 10 {first} END"


def _last(k: str) -> str:
    """A last name; circles after the first have one more, of letters for the circle's number."""
    last = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LAST))
    letters = " || ".join(f"chr(CAST(97 + CAST(floor(circle / {26**i}) AS BIGINT) % 26 AS INT))" for i in range(4))
    return f"CASE CAST(floor({k} / 10) AS BIGINT) % 5 {last} END || CASE WHEN circle > 0 THEN ' Q' || {letters} ELSE '' END"


#: Rankings of some players at some times: several on one day, none at all for every fourth circle.
RANKINGS = f"""
SELECT o_orderkey AS ranking_id, 'p' || CAST(circle * {PLAYERS} + w_id AS STRING) AS player,
 CASE WHEN o_orderkey % 70 = 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 7 AS INT) AS DATE) END AS ranking_date, CAST(1 + (o_custkey * 13 + o_orderkey) % 500 AS INT) AS rank
FROM ({_DRAWN}) WHERE o_orderkey % 3 = 0 AND circle % 4 <> 3
"""

#: Results: full names, places and rounds as the one source writes them.
RESULTS = f"""
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date_tourney,
 {_name("w_id")} || ' ' || {_last("w_id")} AS winner_name, CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE {_name("l_id")} || ' ' || {_last("l_id")} END AS loser_name,
 CASE o_orderkey % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'D' WHEN 2 THEN 'X' ELSE '' END AS tourney_level,
 CASE o_orderkey % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE) ELSE NULL END AS best_of,
 CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(1 + o_custkey % 300 AS DOUBLE) END AS winner_rank, CAST(1 + o_orderkey % 400 AS DOUBLE) AS loser_rank,
 CAST(180 + (o_custkey * 3) % 190 AS DOUBLE) / 10 AS winner_age, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(180 + (o_orderkey * 7) % 190 AS DOUBLE) / 10 END AS loser_age,
 CASE o_custkey % 6 WHEN 0 THEN 'Roland Garros' WHEN 1 THEN 'US Open' WHEN 2 THEN 'Indian Wells Masters' WHEN 3 THEN 'Wien' WHEN 4 THEN 'St. Petersburg' ELSE 'Houston' END AS tourney_name,
 CASE o_orderstatus WHEN 'F' THEN 'Hard' WHEN 'O' THEN 'Clay' ELSE 'Grass' END AS surface,
 CASE digit WHEN 1 THEN 'F' WHEN 2 THEN 'SF' WHEN 3 THEN 'QF' WHEN 4 THEN 'R16' ELSE 'RR' END AS round,
 CAST(year(o_orderdate) AS INT) AS year
FROM ({_DRAWN})
"""

#: Odds: fewer events, other spellings, dates off by up to 20 days, some surfaces and rounds changed.
ODDS = f"""
SELECT o_orderkey AS right_id, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 - 20 AS INT) AS DATE) AS Date_dt,
 {_last("w_id")} || ' ' || substr({_name("w_id")}, 1, 1) || '.' AS Winner, CASE WHEN o_orderkey % 40 = 3 THEN '' ELSE {_last("l_id")} || ' ' || substr({_name("l_id")}, 1, 1) || '.' END AS Loser,
 CASE o_orderkey % 7 WHEN 0 THEN 'Grand Slam' WHEN 1 THEN 'Masters 1000' WHEN 2 THEN 'ATP250' ELSE '' END AS Series,
 CASE o_custkey % 6 WHEN 0 THEN 'Paris' WHEN 1 THEN 'New York' WHEN 2 THEN 'Indian Wells' WHEN 3 THEN 'Vienna' WHEN 4 THEN 'St Petersburg' ELSE 'Houston' END AS Location,
 CASE WHEN o_orderkey % 6 = 0 THEN 'i carpet' WHEN o_orderstatus = 'F' THEN 'h' WHEN o_orderstatus = 'O' THEN 'Red Clay' ELSE 'G' END AS Surface,
 CASE WHEN o_orderkey % 4 = 0 THEN '2nd Round' ELSE CASE digit WHEN 1 THEN 'Final' WHEN 2 THEN 'Semifinals' WHEN 3 THEN 'Quarterfinals' WHEN 4 THEN '3rd Round' ELSE 'Round Robin' END END AS Round,
 CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE {_price(37, 400)} END AS PSW,
 CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE {_price(53, 400)} END AS PSL
FROM ({_DRAWN}) WHERE o_orderkey % 5 <> 0
"""

#: The player dimension: keys may repeat, the last row of a key counts.
PLAYER_DIM = f"""
SELECT c_custkey AS player_id, 'p' || CAST(CAST(floor(c_custkey / {CIRCLE}) AS BIGINT) * {PLAYERS} + c_custkey % {PLAYERS + 10} AS STRING) AS player_key,
 CASE c_custkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'u' END AS hand,
 CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(160 + c_custkey % 45 AS STRING) END AS height_cm
FROM {{customer}} WHERE c_custkey % {PLAYERS + 10} <> 3
"""

#: Dates as text, in four forms and some that are none.
DATES = """
SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 50 = 7 THEN 'unknown' WHEN o_orderkey % 4 = 0 THEN y || '-' || m || '-' || d WHEN o_orderkey % 4 = 1 THEN y || m || d
 WHEN o_orderkey % 4 = 2 THEN d || '/' || m || '/' || y ELSE m || '/' || d || '/' || y END AS raw
FROM (SELECT o_orderkey, substr(t, 1, 4) AS y, substr(t, 6, 2) AS m, substr(t, 9, 2) AS d FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS t FROM {orders}))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer") if f"{{{n}}}" in sql}
    return spark.sql(sql, **frames)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results and odds; the narrow orders are spread before the wider rows are made of them."""
    orders = tables.spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return spark.sql(RESULTS, orders=orders), spark.sql(ODDS, orders=orders)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MATCHES)


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views."""
    return sql.format(orders="orders", customer="customer")
