"""Registered queries of the library's own operators, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, prices, text
from ..operators import circles, dataset, evaluate, history, link, ratings
from ..sources import tables
from ..sources.stages import StageTables
from . import model, standin, workloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TRAIN_UNTIL, VAL, TEST = 1999, 2000, 2001


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


# ---- SQL that several oracles share -------------------------------------------------------------------------------

_M = f"m AS ({standin.duck(standin.MATCHES)})"
_PRICED = """pr AS (SELECT * FROM (SELECT *, CASE WHEN PSW IS NOT NULL AND PSL IS NOT NULL THEN 'PS' WHEN AvgW IS NOT NULL AND AvgL IS NOT NULL THEN 'Avg'
 WHEN B365W IS NOT NULL AND B365L IS NOT NULL THEN 'B365' END AS book_used FROM m) WHERE book_used IS NOT NULL),
pp AS (SELECT *, CASE book_used WHEN 'PS' THEN PSW WHEN 'Avg' THEN AvgW ELSE B365W END AS oddsW, CASE book_used WHEN 'PS' THEN PSL WHEN 'Avg' THEN AvgL ELSE B365L END AS oddsL FROM pr)"""
_ORIENTED = """oo AS (SELECT *, CASE WHEN oddsW = oddsL THEN w <= l ELSE oddsW < oddsL END AS a_is_w FROM pp),
o AS (SELECT *, CASE WHEN a_is_w THEN w ELSE l END AS A_key, CASE WHEN a_is_w THEN l ELSE w END AS B_key, CAST(a_is_w AS INT) AS y,
 CASE WHEN a_is_w THEN oddsW ELSE oddsL END AS odds_A, CASE WHEN a_is_w THEN oddsL ELSE oddsW END AS odds_B FROM oo)"""
_O = f"WITH {_M}, {_PRICED}, {_ORIENTED}"
_LONG = """lg AS (SELECT match_id, w AS player, l AS opponent, 1 AS is_win, match_date, surface FROM m UNION ALL
 SELECT match_id, l, w, 0, match_date, surface FROM m)"""
_ML = f"WITH {_M}, {_LONG}"
_EVAL = (
    f"{_O}, ev AS (SELECT match_id, match_date, y, book_used, CASE WHEN year(match_date) <= {TRAIN_UNTIL} THEN 'train' WHEN year(match_date) = {VAL} THEN 'val' "
    f"WHEN year(match_date) = {TEST} THEN 'test' END AS split, round((1 / odds_A) / (1 / odds_A + 1 / odds_B), 9) AS p_book, "
    "round(1 / (1 + exp((coalesce(CASE WHEN a_is_w THEN w_rank ELSE l_rank END, 500) - coalesce(CASE WHEN a_is_w THEN l_rank ELSE w_rank END, 500)) / 150)), 9) AS p_model FROM o), "
    "lf AS (SELECT match_id, split, y, 'book' AS forecast, p_book AS p FROM ev WHERE split IS NOT NULL UNION ALL SELECT match_id, split, y, 'model', p_model FROM ev WHERE split IS NOT NULL)"
)


def _clean_sql(c: str) -> str:
    c = f"coalesce(CAST({c} AS VARCHAR), '')"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ø", "o"), ("ł", "l"), ("Ł", "L"), ("Ø", "O")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"""trim(regexp_replace(lower(strip_accents({c})), '[\\s.,''"()\\-–&/]+', ' ', 'g'))"""


def _case_sql(c: str, mapping: dict, default: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def _city_sql(c: str) -> str:
    return _case_sql(_clean_sql(c), lexicon.CITY_ALIASES, _clean_sql(c))


def _surface_sql(c: str) -> str:
    return _case_sql(_clean_sql(c), lexicon.SURFACES, _clean_sql(c))


def _round_sql(c: str) -> str:
    return _case_sql(_clean_sql(c), lexicon.ROUNDS, f"upper({_clean_sql(c)})")


def _place_sql(city: str, surface: str) -> str:
    return f"trim({_city_sql(city)} || '_' || {_surface_sql(surface)}, '_')"


def _initial_sql(s: str) -> str:
    return rf"trim(substr({s}, 1, 1) || ' ' || regexp_extract({s}, '^\S+ (.*)$', 1))"


def _last_initials_sql(c: str) -> str:
    s, p = _clean_sql(c), r"'^(.*?)((?:(?:^| )\S)+)$'"
    return (
        f"CASE WHEN instr({s}, ' ') = 0 THEN {s} WHEN regexp_extract({s}, {p}, 2) <> '' THEN "
        f"trim(substr(trim(regexp_extract({s}, {p}, 2)), 1, 1) || ' ' || regexp_extract({s}, {p}, 1)) ELSE {_initial_sql(s)} END"
    )


_KEYS = "w_key, l_key, tkey_city, city_key, rnd_canon, CASE WHEN w_key <> '' AND l_key <> '' THEN least(w_key, l_key) || '__' || greatest(w_key, l_key) END AS players_sorted"
_ROUNDS_IN = ", ".join(f"'{r}'" for r in lexicon.MAIN_ROUNDS)
_LINKED = (
    f"WITH l0 AS (SELECT *, {_initial_sql(_clean_sql('winner_name'))} AS w_key, {_initial_sql(_clean_sql('loser_name'))} AS l_key, {_place_sql('tourney_name', 'surface')} AS tkey_city, "
    f"{_city_sql('tourney_name')} AS city_key, {_round_sql('round')} AS rnd_canon FROM ({standin.duck(standin.RESULTS)})), "
    f"le AS (SELECT match_id, date_tourney, year, surface, round, tourney_name, tourney_level, best_of, winner_rank, loser_rank, winner_age, loser_age, {_KEYS} FROM l0 WHERE rnd_canon IN ({_ROUNDS_IN})), "
    f"r0 AS (SELECT *, {_last_initials_sql('Winner')} AS w_key, {_last_initials_sql('Loser')} AS l_key, {_place_sql('Location', 'Surface')} AS tkey_city, "
    f"{_city_sql('Location')} AS city_key, {_round_sql('Round')} AS rnd_canon FROM ({standin.duck(standin.ODDS)})), "
    f"ri AS (SELECT right_id, Date_dt, PSW, PSL, Surface, Round, Series, {_KEYS} FROM r0 WHERE rnd_canon IN ({_ROUNDS_IN}))"
)


def _nearest_sql(left: str, keys: tuple[str, ...], days: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return (
        f"SELECT * FROM (SELECT a.match_id, b.right_id, b.PSW, b.PSL, row_number() OVER (PARTITION BY a.match_id ORDER BY CASE WHEN a.rnd_canon = b.rnd_canon THEN 0 ELSE 1 END, "
        f"abs(datediff('day', b.Date_dt, a.date_tourney)), b.Date_dt, b.right_id) AS k FROM {left} a JOIN ri b ON {on} AND abs(datediff('day', b.Date_dt, a.date_tourney)) <= {days}) WHERE k = 1"
    )


_STAGED = (
    f"{_LINKED}, s1 AS (SELECT a.match_id, b.right_id, b.PSW, b.PSL FROM le a JOIN ri b ON a.tkey_city = b.tkey_city AND a.rnd_canon = b.rnd_canon AND a.players_sorted = b.players_sorted), "
    "u1 AS (SELECT * FROM le WHERE match_id NOT IN (SELECT match_id FROM s1)), "
    f"s2 AS ({_nearest_sql('u1', ('tkey_city', 'players_sorted'), 21)}), u2 AS (SELECT * FROM u1 WHERE match_id NOT IN (SELECT match_id FROM s2)), "
    f"s3 AS ({_nearest_sql('u2', ('city_key', 'players_sorted'), 14)}), u3 AS (SELECT * FROM u2 WHERE match_id NOT IN (SELECT match_id FROM s3)), "
    "lk AS (SELECT match_id, right_id, PSW, PSL, 'strict' AS stage FROM s1 UNION ALL SELECT match_id, right_id, PSW, PSL, 'nearest' FROM s2 "
    "UNION ALL SELECT match_id, right_id, PSW, PSL, 'loose' FROM s3 UNION ALL SELECT match_id, NULL, NULL, NULL, NULL FROM u3)"
)


# ---- frames that several queries share ----------------------------------------------------------------------------


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return standin.matches(spark, d)


def _oriented(spark: SparkSession, d: str) -> DataFrame:
    return prices.orient_favourite(prices.pick_price_pair(_matches(spark, d)))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return history.to_long(_matches(spark, d), extra=("match_date", "surface"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return standin.derived(spark, d, standin.RESULTS)


def _odds(spark: SparkSession, d: str) -> DataFrame:
    return standin.derived(spark, d, standin.ODDS)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return workloads.linked(*standin.sides(spark, d), even=True)


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    df = dataset.temporal_split(_oriented(spark, d), "match_date", TRAIN_UNTIL, VAL, TEST)
    rank = lambda a, b: F.coalesce(F.when(F.col("a_is_w"), F.col(a)).otherwise(F.col(b)), F.lit(500))
    gap = (rank("w_rank", "l_rank") - rank("l_rank", "w_rank")) / 150
    return df.select(
        "match_id", "match_date", "y", "book_used", "split", F.round("p_book_A", 9).alias("p_book"), F.round(1 / (1 + F.exp(gap)), 9).alias("p_model")
    )


def _told(spark: SparkSession, d: str) -> DataFrame:
    df = _forecasts(spark, d).where("split IS NOT NULL")
    return df.select("match_id", "split", "y", F.col("p_book").alias("book"), F.col("p_model").alias("model")).unpivot(
        ["match_id", "split", "y"], ["book", "model"], "forecast", "p"
    )


# ---- 2.1 sources and sinks ----------------------------------------------------------------------------------------


@query("read_yearly", "SELECT o_orderkey, CASE WHEN year(o_orderdate) % 2 = 0 THEN o_totalprice END AS o_totalprice, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def read_yearly(spark: SparkSession, d: str) -> DataFrame:
    """Writes a folder a year, the odd years without the price, and reads them back; the years before and after are absent."""
    orders = standin.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    base = StageTables(spark).path("yearly")
    orders.where("y % 2 = 0").write.partitionBy("y").parquet(base)
    orders.where("y % 2 = 1").drop("o_totalprice").write.mode("append").partitionBy("y").parquet(base)
    first, last = orders.agg(F.min("y"), F.max("y")).first()
    years = range(first - 1, last + 2) if first is not None else ()
    return tables.read_yearly(spark, base, years, name="y={year}").select("o_orderkey", "o_totalprice", "year")


@query(
    "standardize_columns",
    "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, c_mktsegment) AS Winner, "
    "coalesce(CASE WHEN c_custkey % 2 > 0 THEN c_mktsegment END, CAST(c_custkey AS VARCHAR)) AS Tournament, '' AS Location FROM customer",
)
def standardize_columns(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c, n: F.when(F.col("c_custkey") % n > 0, F.col(c))
    df = standin.table(spark, d, "customer").select(
        "c_custkey", some("c_name", 3).alias(" WINNER"), some("c_mktsegment", 2).alias("Event "),
        F.col("c_mktsegment").alias("p1"), F.col("c_custkey").alias("Tourney"),
    )
    return tables.standardize_columns(df, required=("Winner", "Tournament", "Location"))


@query("detect_price_columns", f"WITH {_M} SELECT match_id, PSW, PSL, AvgW, AvgL, B365W, B365L FROM m")
def detect_price_columns(spark: SparkSession, d: str) -> DataFrame:
    df = _matches(spark, d)
    return df.select("match_id", *tables.detect_price_columns(df))


@query("project_final", f"WITH {_M} SELECT match_date AS tourney_start_date, surface AS surface_sack, PSW, PSL, w_id, w_rank, w_age, l_id, l_rank, l_age FROM m")
def project_final(spark: SparkSession, d: str) -> DataFrame:
    return tables.project_final(
        _matches(spark, d), ("match_date", "surface", "absent"), ("PSW", "PSL"), ("w_rank",), ("w_", "l_"),
        {"match_date": "tourney_start_date", "surface": "surface_sack"},
    )


@query("write_table", f"WITH {_M} SELECT surface, count(*) AS n, CAST(year(match_date) AS INT) AS year FROM m GROUP BY ALL")
def write_table(spark: SparkSession, d: str) -> DataFrame:
    """Writes the yearly counts, partitioned, to the shared folder and reads them back."""
    path = StageTables(spark).path("write-table")
    counts = _matches(spark, d).groupBy(F.year("match_date").alias("year"), "surface").agg(F.count("*").alias("n"))
    tables.write_table(counts, path, partition_by=("year",))
    return spark.read.parquet(path).select("surface", "n", "year")


# ---- 2.2 text, dates and keys -------------------------------------------------------------------------------------


@query("clean_text", f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return standin.table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query("canonical_map", f"SELECT right_id, {_surface_sql('Surface')} AS surface_c FROM ({standin.duck(standin.ODDS)})")
def canonical_map(spark: SparkSession, d: str) -> DataFrame:
    return _odds(spark, d).select("right_id", text.canonical_map(F.col("Surface")).alias("surface_c"))


@query("canonical_round", f"SELECT right_id, {_round_sql('Round')} AS rnd FROM ({standin.duck(standin.ODDS)})")
def canonical_round(spark: SparkSession, d: str) -> DataFrame:
    return _odds(spark, d).select("right_id", text.canonical_round(F.col("Round")).alias("rnd"))


@query("alias_city", f"WITH {_M} SELECT match_id, {_city_sql('tourney')} AS city FROM m")
def alias_city(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", text.alias_city(F.col("tourney")).alias("city"))


@query("place_surface_key", f"WITH {_M} SELECT match_id, {_place_sql('tourney', 'surface')} AS place FROM m")
def place_surface_key(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", text.place_surface_key(F.col("tourney"), F.col("surface")).alias("place"))


_PLAYER_NAMES = "SELECT DISTINCT 'Jo-Wilfried' AS name_first, 'Tsonga' AS name_last FROM {orders} UNION ALL SELECT DISTINCT 'Juan Martin', 'Del Potro' FROM {orders}"


@query(
    "initial_last_key",
    f"SELECT match_id, CASE {_clean_sql('winner_name')} WHEN 'jo wilfried tsonga' THEN 'j tsonga' WHEN 'juan martin del potro' THEN 'j del potro' ELSE {_initial_sql(_clean_sql('winner_name'))} END AS w_key "
    f"FROM ({standin.duck(standin.RESULTS)})",
)
def initial_last_key(spark: SparkSession, d: str) -> DataFrame:
    players = standin.derived(spark, d, _PLAYER_NAMES)
    return text.initial_last_key(_results(spark, d), "winner_name", "w_key", players).select("match_id", "w_key")


@query("last_initials_key", f"SELECT right_id, {_last_initials_sql('Winner')} AS w_key FROM ({standin.duck(standin.ODDS)})")
def last_initials_key(spark: SparkSession, d: str) -> DataFrame:
    return _odds(spark, d).select("right_id", text.last_initials_key(F.col("Winner")).alias("w_key"))


@query("pair_key", f"WITH {_M} SELECT match_id, least(w, l) || '__' || greatest(w, l) AS pair FROM m")
def pair_key(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", text.pair_key(F.col("w"), F.col("l")).alias("pair"))


@query(
    "link_keys",
    f"{_LINKED} SELECT match_id, tkey_city || '__' || players_sorted AS key_city_players, tkey_city || '__' || rnd_canon || '__' || players_sorted AS key_city_round_players, "
    "city_key || '__' || players_sorted AS key_cityonly_players, city_key || '__' || rnd_canon || '__' || players_sorted AS key_cityonly_round_players FROM le",
)
def link_keys(spark: SparkSession, d: str) -> DataFrame:
    return workloads.keyed_results(_results(spark, d)).select(
        "match_id", "key_city_players", "key_city_round_players", "key_cityonly_players", "key_cityonly_round_players"
    )


@query(
    "parse_date_multi",
    "SELECT match_id, coalesce(TRY_CAST(CASE WHEN regexp_matches(raw, '^\\d{4}-') THEN raw END AS DATE), CAST(try_strptime(raw, '%Y%m%d') AS DATE), "
    f"CAST(try_strptime(raw, '%d/%m/%Y') AS DATE), CAST(try_strptime(raw, '%m/%d/%Y') AS DATE)) AS parsed FROM ({standin.duck(standin.DATES)})",
)
def parse_date_multi(spark: SparkSession, d: str) -> DataFrame:
    return standin.derived(spark, d, standin.DATES).select("match_id", text.parse_date_multi(F.col("raw")).alias("parsed"))


@query("coalesce_choice", f"WITH {_M} SELECT match_id, coalesce(nullif(series, ''), nullif(code, ''), surface) AS chosen FROM m")
def coalesce_choice(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", text.coalesce_choice(F.col("series"), F.col("code"), F.col("surface")).alias("chosen"))


@query("ordinal_encode", f"WITH {_M} SELECT match_id, CAST({_case_sql('rnd', lexicon.ROUND_ORDER, '0')} AS INT) AS ord FROM m")
def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", text.ordinal_encode(F.col("rnd")).alias("ord"))


@query("one_hot", f"WITH {_M} SELECT match_id, " + ", ".join(f"CAST(surface = '{s}' AS INT) AS surf_{s}" for s in ratings.SURFACES) + " FROM m")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return text.one_hot(_matches(spark, d).select("match_id", "surface"), "surface", ratings.SURFACES, "surf_").drop("surface")


@query(
    "numeric_default",
    f"WITH {_M} SELECT match_id, coalesce(CAST(trunc(TRY_CAST(trim(best_of_text) AS DOUBLE)) AS INT), 3) AS best_of, coalesce(CAST(best_of AS INT), 3) AS best_of_number FROM m",
)
def numeric_default(spark: SparkSession, d: str) -> DataFrame:
    text_, number = text.numeric_default(F.col("best_of_text")), text.numeric_default(F.col("best_of"))
    return _matches(spark, d).select("match_id", text_.alias("best_of"), number.alias("best_of_number"))


def _level_sql(series: str = "series", code: str = "code", name: str = "tourney") -> str:
    s, n = _clean_sql(series), _clean_sql(name)
    parts = [f"WHEN contains({s}, '{p}') THEN '{v}'" for p, v in lexicon.LEVEL_SERIES]
    parts += [f"WHEN {code} <> '' THEN {_case_sql(f'upper({code})', lexicon.LEVEL_CODES, f'upper({code})')}"]
    parts += [f"WHEN contains({n}, '{p}') THEN '{v}'" for p, v in lexicon.LEVEL_NAMES]
    return f"CASE {' '.join(parts)} ELSE '{lexicon.LEVEL_DEFAULT}' END"


@query("infer_level", f"WITH {_M}, lv AS (SELECT match_id, {_level_sql()} AS level FROM m) SELECT match_id, level, CAST({_case_sql('level', lexicon.LEVEL_ORDER, '0')} AS INT) AS level_ord FROM lv")
def infer_level(spark: SparkSession, d: str) -> DataFrame:
    df = text.with_level(_matches(spark, d), "level", F.col("series"), F.col("code"), [F.col("tourney")])
    return df.select("match_id", "level", text.ordinal_encode(F.col("level"), lexicon.LEVEL_ORDER).alias("level_ord"))


# ---- 2.3 filters --------------------------------------------------------------------------------------------------


@query("filter_main_rounds", f"SELECT match_id, round FROM ({standin.duck(standin.RESULTS)}) WHERE round IN ({_ROUNDS_IN})")
def filter_main_rounds(spark: SparkSession, d: str) -> DataFrame:
    return link.filter_main_rounds(_results(spark, d), "round", lexicon.MAIN_ROUNDS).select("match_id", "round")


@query("drop_undated", ORACLES["parse_date_multi"].replace("SELECT match_id", "SELECT * FROM (SELECT match_id", 1) + ") WHERE parsed IS NOT NULL")
def drop_undated(spark: SparkSession, d: str) -> DataFrame:
    return link.drop_undated(parse_date_multi(spark, d), "parsed")


@query("temporal_split", f"{_EVAL} SELECT match_id, split FROM ev")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d).select("match_id", "split")


@query("single_book_subset", f"{_EVAL} SELECT match_id, y, p_book FROM ev WHERE book_used = 'PS'")
def single_book_subset(spark: SparkSession, d: str) -> DataFrame:
    return dataset.single_book_subset(_forecasts(spark, d)).select("match_id", "y", "p_book")


# ---- 2.4 joins ----------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return workloads.keyed_sides(*standin.sides(spark, d), even=True)


_LINK_OUT = ("match_id", "td_right_id", "td_PSW", "td_PSL")


@query(
    "link_strict",
    f"{_LINKED} SELECT a.match_id, b.right_id AS td_right_id, b.PSW AS td_PSW, b.PSL AS td_PSL FROM le a LEFT JOIN ri b ON a.tkey_city = b.tkey_city AND a.rnd_canon = b.rnd_canon AND a.players_sorted = b.players_sorted",
)
def link_strict(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return link.link_strict(left, right, ("tkey_city", "rnd_canon", "players_sorted")).select(*_LINK_OUT)


def _nearest_oracle(keys: tuple[str, ...], days: int) -> str:
    return f"{_LINKED}, n AS ({_nearest_sql('le', keys, days)}) SELECT le.match_id, n.right_id AS td_right_id, n.PSW AS td_PSW, n.PSL AS td_PSL FROM le LEFT JOIN n USING (match_id)"


@query("link_nearest", _nearest_oracle(("tkey_city", "players_sorted"), 21))
def link_nearest(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return link.link_nearest(left, right, ("tkey_city", "players_sorted"), "date_tourney", "Date_dt", 21, "rnd_canon").select(*_LINK_OUT)


@query("link_nearest_loose", _nearest_oracle(("city_key", "players_sorted"), 14))
def link_nearest_loose(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    out = link.link_nearest(left, right, ("city_key", "players_sorted"), "date_tourney", "Date_dt", 14, "rnd_canon", bucket=True)
    return out.select(*_LINK_OUT)


@query("link_staged", f"{_STAGED} SELECT match_id, right_id AS td_right_id, stage FROM lk")
def link_staged(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("match_id", "td_right_id", "stage")


@query("link_stage_counts", f"{_STAGED} SELECT stage, count(*) AS n FROM lk GROUP BY stage")
def link_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).groupBy("stage").agg(F.count("*").alias("n"))


@query(
    "link_coverage",
    f"{_STAGED} SELECT count(*) AS n, count(right_id) AS matched, count(*) FILTER (coalesce(PSW, PSL) IS NOT NULL) AS with_price, count(*) FILTER (coalesce(PSW, PSL) IS NULL) AS without_price FROM lk",
)
def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    return link.link_coverage(_linked(spark, d), ("td_PSW", "td_PSL"))


@query("unmatched_sample", f"{_STAGED} SELECT match_id FROM lk WHERE right_id IS NULL ORDER BY match_id LIMIT 30")
def unmatched_sample(spark: SparkSession, d: str) -> DataFrame:
    return link.unmatched_sample(_linked(spark, d)).select("match_id")


@query(
    "missing_price_sample",
    f"{_STAGED} SELECT match_id, right_id AS td_right_id FROM lk WHERE PSW IS NULL AND PSL IS NULL ORDER BY match_id, right_id LIMIT 30",
)
def missing_price_sample(spark: SparkSession, d: str) -> DataFrame:
    out = link.missing_price_sample(_linked(spark, d), ("td_PSW", "td_PSL"), order=("match_id", F.col("td_right_id").asc_nulls_last()))
    return out.select("match_id", "td_right_id")


_FORM = "avg(is_win) OVER (PARTITION BY player ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_REST = "datediff('day', lag(match_date) OVER (PARTITION BY player ORDER BY match_date, match_id), match_date)"


@query(
    "attach_side_features",
    f"{_O}, {_LONG}, f AS (SELECT match_id, is_win, {_FORM} AS form5, {_REST} AS rest FROM lg) SELECT o.match_id, round(a.form5, 6) AS A_form5, round(b.form5, 6) AS B_form5, CAST(a.rest AS INT) AS A_rest_days, CAST(b.rest AS INT) AS B_rest_days "
    "FROM o JOIN f a ON a.match_id = o.match_id AND (a.is_win = 1) = o.a_is_w JOIN f b ON b.match_id = o.match_id AND (b.is_win = 1) <> o.a_is_w",
)
def attach_side_features(spark: SparkSession, d: str) -> DataFrame:
    long = history.rest_days(history.rolling_form(_long(spark, d), 5))
    out = history.attach_side_features(_oriented(spark, d), long, ("form5", "rest_days"))
    return out.select("match_id", r6("A_form5"), r6("B_form5"), "A_rest_days", "B_rest_days")


@query(
    "attach_player_attributes",
    f"{_O}, pd AS (SELECT player_key, CAST(upper(hand) = 'L' AS INT) AS lefty, TRY_CAST(height_cm AS DOUBLE) AS cm FROM (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY player_id DESC) AS k FROM ({standin.duck(standin.PLAYER_DIM)})) WHERE k = 1) "
    "SELECT match_id, a.lefty AS A_lefty, b.lefty AS B_lefty, a.cm AS A_height_cm, b.cm AS B_height_cm, a.cm - b.cm AS height_diff, CAST(coalesce(a.lefty = 1 AND b.lefty = 0, false) AS INT) AS lefty_vs_righty "
    "FROM o LEFT JOIN pd a ON a.player_key = A_key LEFT JOIN pd b ON b.player_key = B_key",
)
def attach_player_attributes(spark: SparkSession, d: str) -> DataFrame:
    out = history.attach_player_attributes(_oriented(spark, d), standin.derived(spark, d, standin.PLAYER_DIM))
    return out.select("match_id", "A_lefty", "B_lefty", "A_height_cm", "B_height_cm", "height_diff", "lefty_vs_righty")


@query("attach_market_prob", f"{_EVAL} SELECT e.match_id, e.p_model, round((1 / odds_A) / (1 / odds_A + 1 / odds_B), 6) AS p_book_A FROM ev e JOIN o USING (match_id)")
def attach_market_prob(spark: SparkSession, d: str) -> DataFrame:
    pred = _forecasts(spark, d).select("match_id", "p_model")
    feats = _oriented(spark, d).select("match_id", "odds_A", "odds_B")
    return evaluate.attach_market_prob(pred, feats).select("match_id", "p_model", r6("p_book_A"))


@query(
    "rank_asof",
    f"WITH {_M}, rk AS (SELECT * FROM ({standin.duck(standin.RANKINGS)}) WHERE ranking_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY player, ranking_date ORDER BY ranking_id DESC) = 1), "
    "a AS (SELECT match_id, rank, datediff('day', ranking_date, match_date) AS days FROM m ASOF JOIN rk ON w = player AND match_date >= ranking_date), "
    "b AS (SELECT match_id, rank, datediff('day', ranking_date, match_date) AS days FROM m ASOF JOIN rk ON l = player AND match_date >= ranking_date) "
    "SELECT m.match_id, a.rank AS w_rank_asof, b.rank AS l_rank_asof, CAST(a.days AS INT) AS w_rank_days, CAST(b.days AS INT) AS l_rank_days FROM m LEFT JOIN a USING (match_id) LEFT JOIN b USING (match_id)",
)
def rank_asof(spark: SparkSession, d: str) -> DataFrame:
    out = history.rank_asof(_matches(spark, d), standin.derived(spark, d, standin.RANKINGS), tie=("ranking_id",))
    return out.select("match_id", "w_rank_asof", "l_rank_asof", "w_rank_days", "l_rank_days")


@query(
    "with_rankings",
    f"WITH ra AS ({ORACLES['rank_asof']}), {_M} SELECT match_id, coalesce(w_rank, CAST(w_rank_asof AS DOUBLE)) AS w_rank, coalesce(l_rank, CAST(l_rank_asof AS DOUBLE)) AS l_rank FROM m JOIN ra USING (match_id)",
)
def with_rankings(spark: SparkSession, d: str) -> DataFrame:
    out = workloads.with_rankings(_matches(spark, d), standin.derived(spark, d, standin.RANKINGS), tie=("ranking_id",))
    return out.select("match_id", "w_rank", "l_rank")


# ---- 2.5 prices and orientation -----------------------------------------------------------------------------------


@query("pick_price_pair", f"WITH {_M}, {_PRICED} SELECT match_id, book_used, oddsW, oddsL FROM pp")
def pick_price_pair(spark: SparkSession, d: str) -> DataFrame:
    return prices.pick_price_pair(_matches(spark, d)).select("match_id", "book_used", "oddsW", "oddsL")


@query(
    "pick_price_pair_strict",
    f"WITH {_M}, q AS (SELECT *, CASE WHEN PSW > 1 AND PSL > 1 THEN 'PS' WHEN AvgW > 1 AND AvgL > 1 THEN 'Avg' WHEN B365W > 1 AND B365L > 1 THEN 'B365' END AS book_used FROM m) "
    "SELECT match_id, book_used FROM q WHERE book_used IS NOT NULL",
)
def pick_price_pair_strict(spark: SparkSession, d: str) -> DataFrame:
    return prices.pick_price_pair(_matches(spark, d), prices.BOOKS_STRICT, 1.0).select("match_id", "book_used")


@query("implied_prob", f"WITH {_M} SELECT match_id, round((1 / PSW) / (1 / PSW + 1 / PSL), 6) AS p FROM m")
def implied_prob(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", r6(prices.implied_prob(F.col("PSW"), F.col("PSL")), "p"))


@query("orient_favourite", f"{_O} SELECT match_id, A_key, B_key, y, odds_A, odds_B, round((1 / odds_A) / (1 / odds_A + 1 / odds_B), 6) AS p_book_A FROM o")
def orient_favourite(spark: SparkSession, d: str) -> DataFrame:
    return _oriented(spark, d).select("match_id", "A_key", "B_key", "y", "odds_A", "odds_B", r6("p_book_A"))


_RANKS = "CASE WHEN a_is_w THEN w_rank ELSE l_rank END AS A_rank, CASE WHEN a_is_w THEN l_rank ELSE w_rank END AS B_rank"


@query("side_values", f"{_O}, s AS (SELECT match_id, {_RANKS} FROM o) SELECT *, coalesce(A_rank, 5000) - coalesce(B_rank, 5000) AS rank_diff FROM s")
def side_values(spark: SparkSession, d: str) -> DataFrame:
    out = prices.side_values(_oriented(spark, d), "w_rank", "l_rank", "rank", 5000.0)
    return out.select("match_id", "A_rank", "B_rank", "rank_diff")


@query("diff_features", f"{_O}, s AS (SELECT match_id, {_RANKS} FROM o) SELECT match_id, A_rank - B_rank AS rank_diff FROM s")
def diff_features(spark: SparkSession, d: str) -> DataFrame:
    out = prices.side_values(_oriented(spark, d), "w_rank", "l_rank", "rank", 0.0).drop("rank_diff")
    return prices.diff_features(out, {"rank": None}).select("match_id", "rank_diff")


# ---- 2.6 history --------------------------------------------------------------------------------------------------


@query("to_long", f"{_ML} SELECT match_id, player, opponent, is_win, match_date, surface FROM lg")
def to_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


@query("rolling_form", f"{_ML} SELECT match_id, player, round({_FORM}, 6) AS form5, round({_FORM.replace('5 PRECEDING', '10 PRECEDING')}, 6) AS form10 FROM lg")
def rolling_form(spark: SparkSession, d: str) -> DataFrame:
    return history.rolling_form(history.rolling_form(_long(spark, d), 5), 10).select("match_id", "player", r6("form5"), r6("form10"))


_GROUND = "CASE WHEN surface IN ('hard', 'clay', 'grass', 'carpet') THEN surface ELSE 'hard' END"


@query("rolling_form_surface", f"{_ML} SELECT match_id, player, round({_FORM.replace('BY player', f'BY player, {_GROUND}', 1)}, 6) AS form5_surf FROM lg")
def rolling_form_surface(spark: SparkSession, d: str) -> DataFrame:
    return history.rolling_form_surface(_long(spark, d)).select("match_id", "player", r6("form5_surf"))


@query("rest_days", f"{_ML} SELECT match_id, player, CAST({_REST} AS INT) AS rest_days, CAST(least(greatest(coalesce({_REST}, 14), 0), 60) AS INT) AS rest_filled FROM lg")
def rest_days(spark: SparkSession, d: str) -> DataFrame:
    long = history.rest_days(history.rest_days(_long(spark, d)), 14, (0, 60), out="rest_filled")
    return long.select("match_id", "player", "rest_days", "rest_filled")


@query(
    "rest_transforms",
    f"WITH z AS ({ORACLES['attach_side_features']}), x AS (SELECT *, CASE WHEN A_rest_days IS NOT NULL THEN ln(1 + least(greatest(A_rest_days, 0), 14)) END AS la, CASE WHEN B_rest_days IS NOT NULL THEN ln(1 + least(greatest(B_rest_days, 0), 14)) END AS lb FROM z) "
    "SELECT match_id, round(la, 6) AS A_rest_log, round(lb, 6) AS B_rest_log, round(la - lb, 6) AS rest_log_diff, CAST(coalesce(A_rest_days < 3, false) AS INT) AS A_short_rest_lt3, CAST(coalesce(B_rest_days < 3, false) AS INT) AS B_short_rest_lt3 FROM x",
)
def rest_transforms(spark: SparkSession, d: str) -> DataFrame:
    out = history.rest_transforms(attach_side_features(spark, d))
    return out.select("match_id", r6("A_rest_log"), r6("B_rest_log"), r6("rest_log_diff"), "A_short_rest_lt3", "B_short_rest_lt3")


_H2H = "OVER (PARTITION BY player, opponent ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("h2h_before", f"{_ML} SELECT match_id, player, opponent, count(is_win) {_H2H} AS h2h_played, CAST(coalesce(sum(is_win) {_H2H}, 0) AS BIGINT) AS h2h_wins FROM lg")
def h2h_before(spark: SparkSession, d: str) -> DataFrame:
    return history.h2h_before(_long(spark, d)).select("match_id", "player", "opponent", "h2h_played", "h2h_wins")


@query(
    "h2h_rate_conf",
    f"{_O}, {_LONG}, f AS (SELECT match_id, is_win, count(is_win) {_H2H} AS p, coalesce(sum(is_win) {_H2H}, 0) AS g FROM lg), j AS (SELECT o.match_id, a.g AS ag, b.g AS bg, a.g / greatest(a.p, 1) AS ar, b.g / greatest(b.p, 1) AS br, 1 / sqrt(greatest(a.p, 1)) AS ac, 1 / sqrt(greatest(b.p, 1)) AS bc "
    "FROM o JOIN f a ON a.match_id = o.match_id AND (a.is_win = 1) = o.a_is_w JOIN f b ON b.match_id = o.match_id AND (b.is_win = 1) <> o.a_is_w) "
    "SELECT match_id, round(ar, 6) AS A_h2h_rate, round(br, 6) AS B_h2h_rate, round(ac, 6) AS A_h2h_conf, round(bc, 6) AS B_h2h_conf, CAST(ag - bg AS DOUBLE) AS h2h_diff, round(ar - br, 6) AS h2h_rate_diff, round(ac - bc, 6) AS h2h_conf_diff FROM j",
)
def h2h_rate_conf(spark: SparkSession, d: str) -> DataFrame:
    df = history.attach_side_features(_oriented(spark, d), history.h2h_before(_long(spark, d)), ("h2h_played", "h2h_wins"))
    out = history.h2h_rate_conf(df)
    return out.select("match_id", *[r6(c) for c in ("A_h2h_rate", "B_h2h_rate", "A_h2h_conf", "B_h2h_conf")], "h2h_diff", r6("h2h_rate_diff"), r6("h2h_conf_diff"))


# ---- 2.7 ratings --------------------------------------------------------------------------------------------------


def _elo_sql(pool: str, k: float, name: str, source: str = "m", order: str = "match_date, match_id", players: str = str(standin.PLAYERS)) -> str:
    """Each pool's events in order; a list of ratings is carried from event to event."""
    return (
        f"n{name} AS (SELECT match_id, match_date, w_id, l_id, {pool} AS pool, row_number() OVER (PARTITION BY {pool} ORDER BY {order}) AS n FROM {source}), "
        f"e{name} AS (SELECT DISTINCT CAST(0 AS BIGINT) AS n, pool, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, [CAST(1500 AS DOUBLE) FOR x IN range({players})] AS r FROM n{name} "
        f"UNION ALL SELECT s.n, s.pool, s.match_id, e.r[s.w_id + 1], e.r[s.l_id + 1], list_transform(e.r, lambda v, i: CASE WHEN i - 1 = s.l_id THEN v - {k} * (1 - 1 / (1 + pow(10, (e.r[s.l_id + 1] - e.r[s.w_id + 1]) / 400))) "
        f"WHEN i - 1 = s.w_id THEN v + {k} * (1 - 1 / (1 + pow(10, (e.r[s.l_id + 1] - e.r[s.w_id + 1]) / 400))) ELSE v END) FROM e{name} e JOIN n{name} s ON s.pool = e.pool AND s.n = e.n + 1)"
    )


@query("elo_before", f"WITH RECURSIVE {_M}, {_elo_sql('circle', 32.0, 'g')} SELECT match_id, round(a, 6) AS elo_w, round(b, 6) AS elo_l FROM eg WHERE n > 0")
def elo_before(spark: SparkSession, d: str) -> DataFrame:
    return ratings.elo_before(_matches(spark, d), pool=("circle",)).select("match_id", r6("elo_w"), r6("elo_l"))


@query(
    "elo_final_state",
    f"WITH RECURSIVE {_M}, {_elo_sql('circle', 32.0, 'g')}, z AS (SELECT pool AS c, unnest(range({standin.PLAYERS})) AS id, unnest(r) AS rating FROM eg JOIN (SELECT pool, max(n) AS n FROM eg GROUP BY pool) USING (pool, n)) "
    f"SELECT c AS circle, 'p' || CAST(c * {standin.PLAYERS} + id AS VARCHAR) AS player, round(rating, 6) AS rating FROM z WHERE EXISTS (SELECT 1 FROM m WHERE m.circle = c AND (w_id = id OR l_id = id))",
)
def elo_final_state(spark: SparkSession, d: str) -> DataFrame:
    """Two seasons one after the other; the second starts from the first one's last ratings."""
    df, stages = _matches(spark, d), StageTables(spark)
    early = F.year("match_date") <= TRAIN_UNTIL
    _, state = ratings.elo_with_state(df.where(early), stages, pool=("circle",))
    _, state = ratings.elo_with_state(df.where(~early), stages, pool=("circle",), initial_state=state)
    return state.select("circle", "player", r6("rating"))


@query(
    "circles",
    f"WITH RECURSIVE {_M}, e AS (SELECT w AS a, l AS b FROM m UNION SELECT l, w FROM m), r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id",
)
def circles_(spark: SparkSession, d: str) -> DataFrame:
    return circles.components(_matches(spark, d), "w", "l")


@query("elo_before_surface", f"WITH RECURSIVE {_M}, {_elo_sql(f"CAST(circle AS VARCHAR) || ({_GROUND})", 24.0, 's')} SELECT match_id, round(a, 6) AS selo_w, round(b, 6) AS selo_l FROM es WHERE n > 0")
def elo_before_surface(spark: SparkSession, d: str) -> DataFrame:
    return ratings.elo_before_surface(_matches(spark, d), pool=("circle",)).select("match_id", r6("selo_w"), r6("selo_l"))


def _decay_sql(v: str, days: str) -> str:
    return f"CASE WHEN {days} > 0 THEN 1500 + ({v} - 1500) * exp({days} * (-0.6931471805599453 / 180)) ELSE {v} END"


_DAYS = f"dy AS (SELECT match_id, is_win, {_REST} AS days FROM lg)"
_DECAYED = (
    f"{_LONG}, {_DAYS}, dc AS (SELECT e.match_id, e.a, e.b, {_decay_sql('e.a', 'x.days')} AS da, {_decay_sql('e.b', 'z.days')} AS db FROM eg e JOIN dy x ON x.match_id = e.match_id AND x.is_win = 1 "
    "JOIN dy z ON z.match_id = e.match_id AND z.is_win = 0 WHERE e.n > 0)"
)


@query("elo_decay_before", f"WITH RECURSIVE {_M}, {_elo_sql('circle', 32.0, 'g')}, {_DECAYED} SELECT match_id, round(da, 6) AS elo_decay_w, round(db, 6) AS elo_decay_l FROM dc")
def elo_decay_before(spark: SparkSession, d: str) -> DataFrame:
    df = _matches(spark, d)
    return ratings.elo_decay_before(df, ratings.elo_before(df, pool=("circle",))).select("match_id", r6("elo_decay_w"), r6("elo_decay_l"))


@query(
    "elo_sides",
    f"WITH RECURSIVE {_M}, {_PRICED}, {_ORIENTED}, {_elo_sql('circle', 32.0, 'g')}, {_DECAYED} SELECT o.match_id, round(CASE WHEN a_is_w THEN a ELSE b END, 6) AS A_elo, round(CASE WHEN a_is_w THEN b ELSE a END, 6) AS B_elo, "
    "round(CASE WHEN a_is_w THEN a - b ELSE b - a END, 6) AS elo_diff, round(CASE WHEN a_is_w THEN da - db ELSE db - da END, 6) AS elo_decay_diff FROM o JOIN dc USING (match_id)",
)
def elo_sides(spark: SparkSession, d: str) -> DataFrame:
    df = _matches(spark, d)
    rated = ratings.elo_decay_before(df, ratings.elo_before(df, pool=("circle",)))
    out = ratings.elo_sides(_oriented(spark, d).join(rated, "match_id"))
    return out.select("match_id", r6("A_elo"), r6("B_elo"), r6("elo_diff"), r6("elo_decay_diff"))


# ---- 2.8 aggregations, sorts, top-k -------------------------------------------------------------------------------


@query(
    "impute_train_median",
    f"WITH {_M}, sp AS (SELECT *, CASE WHEN year(match_date) <= {TRAIN_UNTIL} THEN 'train' ELSE 'later' END AS split FROM m), md AS (SELECT median(w_rank) AS mw, median(l_rank) AS ml FROM sp WHERE split = 'train') "
    "SELECT match_id, split, round(coalesce(w_rank, mw), 6) AS w_rank, round(coalesce(l_rank, ml), 6) AS l_rank FROM sp, md",
)
def impute_train_median(spark: SparkSession, d: str) -> DataFrame:
    df = _matches(spark, d).withColumn("split", F.when(F.year("match_date") <= TRAIN_UNTIL, "train").otherwise("later"))
    out = dataset.impute_train_median(df, ("w_rank", "l_rank"))
    return out.select("match_id", "split", r6("w_rank"), r6("l_rank"))


@query("select_features", f"{_O} SELECT round_ord, best_of, {_RANKS} FROM o")
def select_features(spark: SparkSession, d: str) -> DataFrame:
    df = prices.side_values(_oriented(spark, d), "w_rank", "l_rank", "rank").drop("rank_diff")
    return df.select(*dataset.select_features(df, mode="basic"))


@query("leak_guard", f"WITH {_M} SELECT w_id, l_id, w_age, l_age, w_rank, l_rank FROM m")
def leak_guard(spark: SparkSession, d: str) -> DataFrame:
    df = _matches(spark, d)
    return df.select(*dataset.leak_guard(df))


_LL = "-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) ELSE ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) END"


def _auc_sql(source: str, by: str, p: str = "p") -> str:
    return (
        f"SELECT {by}, CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2 * sum(pos) * sum(neg)) END AS auc FROM (SELECT *, "
        f"coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY {p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {by}, {p}, sum(y) AS pos, sum(1 - y) AS neg FROM {source} WHERE {p} IS NOT NULL GROUP BY {by}, {p})) GROUP BY {by}"
    )


_METRICS = (
    f"{_EVAL}, au AS ({_auc_sql('lf', 'split, forecast')}), mt AS (SELECT split, forecast, avg({_LL}) AS logloss, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM lf GROUP BY split, forecast)"
)


@query("prob_metrics", f"{_METRICS} SELECT split, forecast, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round(auc, 6) AS auc, n FROM mt JOIN au USING (split, forecast)")
def prob_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.prob_metrics(_told(spark, d), "y", "p", ("split", "forecast"))
    return out.select("split", "forecast", r6("logloss"), r6("brier"), r6("auc"), "n")


@query("auc", f"{_EVAL}, au AS ({_auc_sql('lf', 'split, forecast')}) SELECT split, forecast, round(auc, 6) AS auc FROM au")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(_told(spark, d), "y", "p", ("split", "forecast")).select("split", "forecast", r6("auc"))


@query(
    "metric_deltas",
    f"{_METRICS} SELECT split, round(max(logloss) FILTER (forecast = 'book') - max(logloss) FILTER (forecast = 'model'), 6) AS d_logloss, round(max(brier) FILTER (forecast = 'book') - max(brier) FILTER (forecast = 'model'), 6) AS d_brier FROM mt GROUP BY split",
)
def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    metrics = evaluate.prob_metrics(_told(spark, d), "y", "p", ("split", "forecast"))
    return evaluate.metric_deltas(metrics).select("split", r6("d_logloss"), r6("d_brier"))


@query("accuracy_at", f"{_EVAL} SELECT split, forecast, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 6) AS accuracy FROM lf GROUP BY split, forecast")
def accuracy_at(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy_at(_told(spark, d), "y", "p", by=("split", "forecast")).select("split", "forecast", r6("accuracy"))


@query(
    "calibration_table",
    f"{_EVAL}, ix AS (SELECT p_model AS p, y, row_number() OVER (ORDER BY p_model, match_id) - 1 AS i, count(*) OVER () AS t FROM ev WHERE split = 'val'), bn AS (SELECT *, CAST(greatest(ceil(CAST(i * 10 AS DOUBLE) / greatest(t - 1, 1)) - 1, 0) AS INT) AS bin FROM ix) "
    "SELECT bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(y), 6) AS y_rate, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, round(avg(p) - avg(y), 6) AS gap FROM bn GROUP BY bin",
)
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.calibration_table(_forecasts(spark, d).where("split = 'val'"), "y", "p_model", "match_id")
    return out.select("bin", "n", *[r6(c) for c in ("p_mean", "y_rate", "p_min", "p_max", "gap")])


_MIX_LL = "avg(-CASE WHEN y = 1 THEN ln(greatest(least(q, 1 - 1e-6), 1e-6)) ELSE ln(1 - greatest(least(q, 1 - 1e-6), 1e-6)) END)"


@query(
    "blend_weight_search",
    f"{_EVAL}, ws AS (SELECT CAST(k AS DOUBLE) / 40 AS w FROM range(41) t(k)), mx AS (SELECT w, y, w * p_model + (1 - w) * p_book AS q FROM ev, ws WHERE split = 'val') "
    f"SELECT w, round(l, 6) AS logloss FROM (SELECT w, {_MIX_LL} AS l FROM mx GROUP BY w) ORDER BY l, w LIMIT 1",
)
def blend_weight_search(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.blend_weight_search(_forecasts(spark, d).where("split = 'val'"), "y", "p_model", "p_book")
    return out.select("w", r6("logloss"))


@query("blend_apply", f"{_EVAL} SELECT match_id, round(greatest(least(0.25 * p_model + 0.75 * p_book, 1 - 1e-6), 1e-6), 6) AS p_blend FROM ev")
def blend_apply(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.blend_apply(_forecasts(spark, d), F.lit(0.25), "p_model", "p_book")
    return out.select("match_id", r6("p_blend"))


@query(
    "single_feature_auc",
    f"{_O}, uf AS (SELECT y, unnest(['A_rank', 'B_rank', 'level_ord', 'round_ord']) AS feature, unnest([CASE WHEN a_is_w THEN w_rank ELSE l_rank END, CASE WHEN a_is_w THEN l_rank ELSE w_rank END, CAST(level_ord AS DOUBLE), CAST(round_ord AS DOUBLE)]) AS value FROM o), "
    f"au AS ({_auc_sql('uf', 'feature', 'value')}) SELECT feature, round(abs(auc - 0.5), 6) AS auc_gap FROM au ORDER BY abs(auc - 0.5) DESC, feature LIMIT 25",
)
def single_feature_auc(spark: SparkSession, d: str) -> DataFrame:
    df = prices.side_values(_oriented(spark, d), "w_rank", "l_rank", "rank")
    return evaluate.single_feature_auc(df, "y", ("A_rank", "B_rank", "level_ord", "round_ord")).select("feature", r6("auc_gap"))


def _permuted_sql(seed: int) -> str:
    """CTE ``pz``: place ``i`` of ``px(i, n, y, match_id)`` and its permuted place ``j``, round by round."""
    prime, rounds = evaluate._PRIME, evaluate.round_keys(seed)
    steps = ["p0 AS (SELECT i, n, y, i AS j FROM px)"]
    for r, (k, a, b) in enumerate(rounds):
        turned = f"(greatest(j, v) % {prime} * {a} + {b}) % {prime}"
        steps.append(
            f"p{r + 1} AS (SELECT i, n, y, CASE WHEN (h * h) % {prime} % 2 = 1 THEN v ELSE j END AS j FROM (SELECT *, {turned} AS h FROM (SELECT *, (({k} - j) % n + n) % n AS v FROM p{r})))"
        )
    return ", ".join(steps) + f", pz AS (SELECT i, y, j FROM p{len(rounds)})"


@query(
    "permute_target",
    f"{_O}, px AS (SELECT match_id, y, row_number() OVER (ORDER BY match_id) - 1 AS i, count(*) OVER () AS n FROM o), {_permuted_sql(42)} SELECT px.match_id, pz.y FROM px JOIN pz ON px.i = pz.j",
)
def permute_target(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.permute_target(_oriented(spark, d).select("match_id", "y"), "y", "match_id", 42)


@query(
    "match_order",
    f"{_O} SELECT match_id, CAST(row_number() OVER (PARTITION BY pool ORDER BY match_date, level_ord, round_ord, A_key, B_key, match_id) AS INT) AS place FROM o",
)
def match_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("pool").orderBy(*history.match_order())
    return _oriented(spark, d).select("match_id", F.row_number().over(w).alias("place"))


# ---- 2.9 models and whole jobs ------------------------------------------------------------------------------------


_OR = lambda a, b: f"coalesce(nullif({a}, ''), {b})"
_MATCH_TABLE = (
    f"{_STAGED}, f1 AS (SELECT match_id, min(right_id) AS right_id FROM lk GROUP BY match_id), mt AS (SELECT le.match_id, coalesce(ri.Date_dt, le.date_tourney) AS match_date, "
    f"{_surface_sql(_OR('ri.Surface', 'le.surface'))} AS surface, {_round_sql(_OR('ri.Round', 'le.round'))} AS rnd, {_level_sql('ri.Series', 'le.tourney_level', 'le.tourney_name')} AS level, "
    "coalesce(CAST(le.best_of AS INT), 3) AS best_of, coalesce(nullif(ri.w_key, ''), nullif(le.w_key, '')) AS w, coalesce(nullif(ri.l_key, ''), nullif(le.l_key, '')) AS l, "
    "winner_rank AS w_rank, loser_rank AS l_rank, winner_age AS w_age, loser_age AS l_age, ri.PSW, ri.PSL FROM f1 JOIN le USING (match_id) LEFT JOIN ri ON ri.right_id = f1.right_id) "
)


@query(
    "match_table",
    f"{_MATCH_TABLE} SELECT match_id, match_date, surface, rnd, CAST({_case_sql('rnd', lexicon.ROUND_ORDER, '0')} AS INT) AS round_ord, level, CAST({_case_sql('level', lexicon.LEVEL_ORDER, '0')} AS INT) AS level_ord, "
    "best_of, w, l, w_rank, l_rank, w_age, l_age, PSW, PSL FROM mt",
)
def match_table(spark: SparkSession, d: str) -> DataFrame:
    return workloads.match_table(_linked(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    matches = text.with_level(_matches(spark, d), "level", F.col("series"), F.col("code"), [F.col("tourney")])
    matches = matches.withColumn("best_of", text.numeric_default(F.col("best_of_text")))
    return workloads.feature_table(matches, standin.derived(spark, d, standin.PLAYER_DIM), pool=("circle",))


_PLAYERS = (
    f"pd AS (SELECT player_key, CAST(upper(hand) = 'L' AS INT) AS lefty, TRY_CAST(height_cm AS DOUBLE) AS cm FROM (SELECT *, row_number() OVER (PARTITION BY player_key ORDER BY player_id DESC) AS k FROM ({standin.duck(standin.PLAYER_DIM)})) WHERE k = 1), "
)


def _feature_sql(matches: str, players: str = "", count: str = str(standin.PLAYERS)) -> str:
    """``matches``: CTEs up to ``m``; ``players``: a CTE ``pd``, or none; ``count``: players of a circle."""
    order = "match_date, level_ord, round_ord, A_key, B_key, match_id"
    by = lambda *keys: f"PARTITION BY {', '.join(keys)} ORDER BY {order}, is_win"
    form = lambda *keys: f"avg(is_win) OVER ({by(*keys)} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    rest = lambda *keys: f"datediff('day', lag(match_date) OVER ({by(*keys)}), match_date)"
    met = f"OVER ({by('player', 'opponent')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    side = "match_id, a_is_w, match_date, surface, level_ord, round_ord, A_key, B_key"
    both = lambda name, a, b: f"round({a}, 6) AS A_{name}, round({b}, 6) AS B_{name}"
    three = lambda name, a, b: f"{both(name, a, b)}, round({a} - {b}, 6) AS {name}_diff"
    side_of = lambda a, b: (f"CASE WHEN a_is_w THEN {a} ELSE {b} END", f"CASE WHEN a_is_w THEN {b} ELSE {a} END")
    faded = lambda v, days: _decay_sql(v, days)
    log_rest = lambda c: f"CASE WHEN {c} IS NOT NULL THEN ln(1 + least(greatest({c}, 0), 14)) END"
    levels = ", ".join(f"CAST(level = '{v}' AS INT) AS level_{v}" for v in lexicon.LEVEL_ORDER)
    grounds = ", ".join(f"CAST(surface = '{v}' AS INT) AS surf_{v}" for v in ratings.SURFACES)
    return (
        f"WITH RECURSIVE {matches}, {_PRICED}, {_ORIENTED}, "
        f"fl AS (SELECT {side}, w AS player, l AS opponent, 1 AS is_win FROM o UNION ALL SELECT {side}, l, w, 0 FROM o), "
        f"fw AS (SELECT match_id, (is_win = 1) = a_is_w AS is_a, {form('player')} AS form, {form('player', _GROUND)} AS sform, {rest('player')} AS rest, {rest('player', _GROUND)} AS srest, "
        f"count(is_win) {met} AS met, coalesce(sum(is_win) {met}, 0) AS won FROM fl), "
        f"{_elo_sql('circle', 32.0, 'g', 'o', order, count)}, {_elo_sql(f'CAST(circle AS VARCHAR) || ({_GROUND})', 24.0, 's', 'o', order, count)}, {players}"
        f"x AS (SELECT o.*, a.form AS fa, b.form AS fb, a.sform AS sfa, b.sform AS sfb, a.rest AS ra, b.rest AS rb, a.srest AS sra, b.srest AS srb, "
        "a.met AS ma, b.met AS mb, a.won AS wa, b.won AS wb, "
        + ", ".join(f"{v} AS {n}" for e, t in (("g", "eg"), ("s", "es")) for v, n in zip(side_of(f"{t}.a", f"{t}.b"), (f"{e}a", f"{e}b")))
        + ", " + ", ".join(f"{v} AS {n}" for c in ("rank", "age") for v, n in zip(side_of(f"w_{c}", f"l_{c}"), (f"{c}a", f"{c}b")))
        + (", pa.lefty AS la, pb.lefty AS lb, pa.cm AS ca, pb.cm AS cb" if players else "")
        + " FROM o JOIN fw a ON a.match_id = o.match_id AND a.is_a JOIN fw b ON b.match_id = o.match_id AND NOT b.is_a JOIN eg ON eg.match_id = o.match_id AND eg.n > 0 JOIN es ON es.match_id = o.match_id AND es.n > 0 "
        + ("LEFT JOIN pd pa ON pa.player_key = A_key LEFT JOIN pd pb ON pb.player_key = B_key" if players else "")
        + ") SELECT match_id, match_date, book_used, y, odds_A, odds_B, round((1 / odds_A) / (1 / odds_A + 1 / odds_B), 6) AS p_book_A, round_ord, level_ord, best_of, level AS tourney_level_norm, A_key, B_key, "
        f"{both('form5', 'fa', 'fb')}, {both('form5_surf', 'sfa', 'sfb')}, CAST(ra AS INT) AS A_rest_days, CAST(rb AS INT) AS B_rest_days, ma AS A_h2h_played, mb AS B_h2h_played, CAST(wa AS BIGINT) AS A_h2h_wins, CAST(wb AS BIGINT) AS B_h2h_wins, "
        f"{three('elo', 'ga', 'gb')}, {three('selo', 'sa', 'sb')}, {three('elo_decay', faded('ga', 'ra'), faded('gb', 'rb'))}, {three('selo_decay', faded('sa', 'sra'), faded('sb', 'srb'))}, "
        f"{both('h2h_rate', 'wa / greatest(ma, 1)', 'wb / greatest(mb, 1)')}, {both('h2h_conf', '1 / sqrt(greatest(ma, 1))', '1 / sqrt(greatest(mb, 1))')}, CAST(wa - wb AS DOUBLE) AS h2h_diff, "
        "round(wa / greatest(ma, 1) - wb / greatest(mb, 1), 6) AS h2h_rate_diff, round(1 / sqrt(greatest(ma, 1)) - 1 / sqrt(greatest(mb, 1)), 6) AS h2h_conf_diff, "
        f"{both('rest_log', log_rest('ra'), log_rest('rb'))}, round({log_rest('ra')} - {log_rest('rb')}, 6) AS rest_log_diff, CAST(coalesce(ra < 3, false) AS INT) AS A_short_rest_lt3, CAST(coalesce(rb < 3, false) AS INT) AS B_short_rest_lt3, "
        "ranka AS A_rank, rankb AS B_rank, coalesce(ranka, 5000) - coalesce(rankb, 5000) AS rank_diff, agea AS A_age, ageb AS B_age, round(agea - ageb, 6) AS age_diff, "
        f"round(coalesce(fa, 0.5) - coalesce(fb, 0.5), 6) AS form5_diff, CAST(coalesce(ra, 14) - coalesce(rb, 14) AS INT) AS rest_days_diff, {grounds}, {levels}"
        + (", la AS A_lefty, lb AS B_lefty, ca AS A_height_cm, cb AS B_height_cm, ca - cb AS height_diff, CAST(coalesce(la = 1 AND lb = 0, false) AS INT) AS lefty_vs_righty" if players else "")
        + " FROM x"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if kind == "double" and c not in ("odds_A", "odds_B") else F.col(c) for c, kind in df.dtypes])


_STANDIN_M = (
    f"m0 AS ({standin.duck(standin.MATCHES)}), m AS (SELECT * EXCLUDE (best_of), coalesce(CAST(trunc(TRY_CAST(trim(best_of_text) AS DOUBLE)) AS INT), 3) AS best_of, {_level_sql()} AS level FROM m0)"
)


@query("feature_table", _feature_sql(_STANDIN_M, _PLAYERS))
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return StageTables(spark).keep(_rounded(_features(spark, d)), "features")


_LINKED_M = (
    f"{_MATCH_TABLE.removeprefix('WITH ')}, nm AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT w AS name FROM mt UNION SELECT l FROM mt)), "
    f"m AS (SELECT mt.*, CAST({_case_sql('rnd', lexicon.ROUND_ORDER, '0')} AS INT) AS round_ord, CAST({_case_sql('level', lexicon.LEVEL_ORDER, '0')} AS INT) AS level_ord, 0 AS circle, a.id AS w_id, b.id AS l_id, "
    "CAST(NULL AS DOUBLE) AS AvgW, CAST(NULL AS DOUBLE) AS AvgL, CAST(NULL AS DOUBLE) AS B365W, CAST(NULL AS DOUBLE) AS B365L "
    "FROM mt LEFT JOIN nm a ON a.name = w LEFT JOIN nm b ON b.name = l)"
)


@query("whole_job", _feature_sql(_LINKED_M, count="(SELECT count(*) FROM nm)"))
def whole_job(spark: SparkSession, d: str) -> DataFrame:
    """From two sources to features: what is linked, priced and oriented; ratings fold in the circles that the events show."""
    stages = StageTables(spark)
    matches = stages.keep(workloads.match_table(_linked(spark, d)), "matches")
    matches = stages.keep(circles.with_circle(matches, stages=stages), "circles")
    return stages.keep(_rounded(workloads.feature_table(matches, pool=("circle",))), "features")


_CALIBRATION = (
    f"{_EVAL}, ix AS (SELECT split, forecast, p, y, row_number() OVER (PARTITION BY split, forecast ORDER BY p, match_id) - 1 AS i, count(*) OVER (PARTITION BY split, forecast) AS t FROM lf WHERE split IN ('val', 'test')), "
    "bn AS (SELECT *, CAST(greatest(ceil(CAST(i * 10 AS DOUBLE) / greatest(t - 1, 1)) - 1, 0) AS INT) AS bin FROM ix) "
)


@query(
    "calibration_reports",
    f"{_CALIBRATION} SELECT split, forecast, bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(y), 6) AS y_rate, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, round(avg(p) - avg(y), 6) AS gap FROM bn GROUP BY ALL",
)
def calibration_reports(spark: SparkSession, d: str) -> DataFrame:
    out = workloads.calibration_reports(_told(spark, d), forecasts=("book", "model"))
    return out.select("split", "forecast", "bin", "n", *[r6(c) for c in ("p_mean", "y_rate", "p_min", "p_max", "gap")])


@query(
    "book_metrics",
    f"{_EVAL}, lb AS (SELECT lf.* FROM lf JOIN ev USING (match_id) WHERE book_used = 'PS' AND lf.split IN ('val', 'test')), au AS ({_auc_sql('lb', 'split, forecast')}), "
    f"mt AS (SELECT split, forecast, avg({_LL}) AS logloss, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM lb GROUP BY split, forecast) "
    "SELECT split, forecast, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round(auc, 6) AS auc, n FROM mt JOIN au USING (split, forecast)",
)
def book_metrics(spark: SparkSession, d: str) -> DataFrame:
    told = workloads.told_forecasts(dataset.single_book_subset(_forecasts(spark, d)))
    told = told.withColumn("forecast", F.substring("forecast", 3, 9))
    out = evaluate.prob_metrics(told, "y", "p", ("split", "forecast"))
    return out.select("split", "forecast", r6("logloss"), r6("brier"), r6("auc"), "n")


@query(
    "single_feature_auc_val",
    f"{_O}, uf AS (SELECT y, unnest(['A_rank', 'B_rank', 'level_ord', 'round_ord']) AS feature, unnest([CASE WHEN a_is_w THEN w_rank ELSE l_rank END, CASE WHEN a_is_w THEN l_rank ELSE w_rank END, CAST(level_ord AS DOUBLE), CAST(round_ord AS DOUBLE)]) AS value FROM o WHERE year(match_date) = {VAL}), "
    f"au AS ({_auc_sql('uf', 'feature', 'value')}) SELECT feature, round(abs(auc - 0.5), 6) AS auc_gap FROM au ORDER BY abs(auc - 0.5) DESC, feature LIMIT 25",
)
def single_feature_auc_val(spark: SparkSession, d: str) -> DataFrame:
    df = dataset.temporal_split(prices.side_values(_oriented(spark, d), "w_rank", "l_rank", "rank"), "match_date", TRAIN_UNTIL, VAL, TEST)
    return evaluate.single_feature_auc(df.where("split = 'val'"), "y", ("A_rank", "B_rank", "level_ord", "round_ord")).select("feature", r6("auc_gap"))


def _scored(spark: SparkSession, d: str) -> tuple:
    stages = StageTables(spark)
    data = stages.keep(dataset.temporal_split(_features(spark, d), "match_date", TRAIN_UNTIL, VAL, TEST), "features")
    return data, dataset.select_features(data), stages


@query("train_boosted")
def train_boosted(spark: SparkSession, d: str) -> DataFrame:
    data, names, stages = _scored(spark, d)
    fitted, _ = model.train_boosted(data, names, stages=stages)
    return model.importances(data, fitted, names)


_ISOTONIC = (
    f"{_EVAL}, vx AS (SELECT p_model AS x, sum(y) AS s, count(*) AS n FROM ev WHERE split = 'val' GROUP BY p_model), "
    "cx AS (SELECT x, s, n, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM vx), "
    "lo AS (SELECT a.i AS a, b.i AS b, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS low FROM cx a JOIN cx b ON a.i <= b.i), "
    "fx AS (SELECT x, f FROM cx JOIN (SELECT b AS i, max(low) AS f FROM lo GROUP BY b) USING (i)), "
    "px AS (SELECT p, (SELECT max(x) FROM fx WHERE x <= p) AS xl, (SELECT min(x) FROM fx WHERE x >= p) AS xu FROM (SELECT DISTINCT p_model AS p FROM ev)), "
    "py AS (SELECT p, coalesce(l.f, u.f) AS fl, coalesce(u.f, l.f) AS fu, xl, xu FROM px LEFT JOIN fx l ON l.x = xl LEFT JOIN fx u ON u.x = xu) "
)


@query(
    "calibrate_isotonic",
    f"{_ISOTONIC} SELECT match_id, split, y, round(CASE WHEN xl IS NULL OR xu IS NULL OR xl = xu THEN fl ELSE fl + (fu - fl) * (p - xl) / (xu - xl) END, 6) AS p_iso FROM ev JOIN py ON p = p_model",
)
def calibrate_isotonic(spark: SparkSession, d: str) -> DataFrame:
    """The map that val outcomes give a forecast, applied to all rows."""
    out = model.calibrate_isotonic(_forecasts(spark, d), p="p_model", out="p_iso")
    return out.select("match_id", "split", "y", r6("p_iso"))


@query("predictions")
def predictions(spark: SparkSession, d: str) -> DataFrame:
    data, names, stages = _scored(spark, d)
    _, calibrated = workloads._fitted(data, names, stages)
    return model.predictions(calibrated)


@query("permuted_refit")
def permuted_refit(spark: SparkSession, d: str) -> DataFrame:
    data, names, stages = _scored(spark, d)
    return workloads.permuted_refit(data, names, stages, seed=42)


@query("basic_ablation")
def basic_ablation(spark: SparkSession, d: str) -> DataFrame:
    """What the basic features (no ratings, history or rest) reach, beside the market."""
    data, _, stages = _scored(spark, d)
    _, calibrated = workloads._fitted(data, dataset.select_features(data, mode="basic"), stages)
    told = workloads.told_forecasts(model.predictions(calibrated))
    return evaluate.prob_metrics(told, "y", "p", ("split", "forecast"), stages=stages)
