"""The jobs: link two sources, make the match table, build the feature table, evaluate, blend and diagnose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, prices, text
from ..operators import dataset, evaluate, history, link, ratings
from ..sources import tables
from ..sources.stages import StageTables
from . import model

LINK_STAGES = (
    link.Stage("strict", ("tkey_city", "rnd_canon", "players_sorted")),
    link.Stage("nearest", ("tkey_city", "players_sorted"), 21, "rnd_canon"),
    link.Stage("loose", ("city_key", "players_sorted"), 14, "rnd_canon"),
)
#: Rows by player (two an event) that one task of the feature table sorts.
_TASK_ROWS = 100_000


def keyed_results(results: DataFrame, players: DataFrame | None = None) -> DataFrame:
    names = None if players is None else text.player_names(players)
    df = text.initial_last_key(results, "winner_name", "w_key", names=names)
    df = text.initial_last_key(df, "loser_name", "l_key", names=names)
    df = text.link_keys(df, "tourney_name", "surface", "round", "w_key", "l_key")
    return link.filter_main_rounds(df, "rnd_canon", lexicon.MAIN_ROUNDS)


def keyed_odds(odds: DataFrame) -> DataFrame:
    df = text.last_initials_keys(odds, {"w_key": "Winner", "l_key": "Loser"})
    df = text.link_keys(df, "Location", "Surface", "Round", "w_key", "l_key")
    return link.filter_main_rounds(df, "rnd_canon", lexicon.MAIN_ROUNDS)


def keyed_sides(
    results: DataFrame, odds: DataFrame, players: DataFrame | None = None, stages: StageTables | None = None, even: bool = False
) -> tuple[DataFrame, DataFrame]:
    """:func:`keyed_results` and :func:`keyed_odds`, written once: a link reads each side twice, and cleaning names costs more than a write.

    The composite keys are made anew from their parts when they are read.
    ``even``: the sources are spread already.
    """
    stages = stages or StageTables(results.sparkSession)
    if not even:
        results, odds = tables.spread(results, "match_id"), tables.spread(odds, "right_id")
    kept = lambda df, name: text.composite_keys(stages.keep(df.drop(*text.COMPOSITE_KEYS), name))
    return kept(keyed_results(results, players), "results"), kept(keyed_odds(odds), "odds")


def linked(
    results: DataFrame, odds: DataFrame, players: DataFrame | None = None, stages: StageTables | None = None, even: bool = False
) -> DataFrame:
    """Results with their odds and the ``stage`` that found them; ``even`` as in :func:`keyed_sides`."""
    left, right = keyed_sides(results, odds, players, stages, even)
    return link.link_staged(left, right, LINK_STAGES, "date_tourney", "Date_dt")


def match_table(found: DataFrame, match_id: str = "match_id", right_id: str = "td_right_id") -> DataFrame:
    """What :func:`feature_table` needs, from rows of :func:`linked`: one row an event.

    Where both sources say something, the linked one counts, row by row. Of
    several linked rows of an event the one of the smallest right id stays.
    Columns that a source does not have are passed over.
    """
    place = Window.partitionBy(match_id).orderBy(F.col(right_id).asc_nulls_last())
    found = found.withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")
    have = lambda *names: [F.col(c) for c in names if c in found.columns]
    first = lambda *names: text.coalesce_choice(*have(*names), F.lit(None).cast("string"))
    number = lambda c: F.col(c).cast("string").try_cast("double") if c in found.columns else F.lit(None).cast("double")
    right = [c for c in found.columns if c.startswith("td_")]
    books = tables.detect_price_columns(found.select(*right).toDF(*[c.removeprefix("td_") for c in right]))
    names = [*have("td_Tournament", "tourney_name"), F.lit("")]
    df = text.with_level(found, "_level", first("td_Series"), F.coalesce(first("tourney_level"), F.lit("")), names)
    df = text.with_canonical(df, {"_surface": (first("td_Surface", "surface"), lexicon.SURFACES, False), "_round": (first("td_Round", "round"), lexicon.ROUNDS, True)})
    return df.select(
        match_id,
        F.coalesce(*have("td_Date_dt", "date_tourney")).alias("match_date"),
        F.col("_surface").alias("surface"),
        F.col("_round").alias("rnd"),
        text.ordinal_encode(F.col("_round")).alias("round_ord"),
        F.col("_level").alias("level"),
        text.ordinal_encode(F.col("_level"), lexicon.LEVEL_ORDER).alias("level_ord"),
        text.numeric_default(first("best_of")).alias("best_of"),
        first("td_w_key", "w_key").alias("w"),
        first("td_l_key", "l_key").alias("l"),
        *[number(f"{side}_{c}").alias(f"{side[0]}_{c}") for c in ("rank", "age") for side in ("winner", "loser")],
        *[F.col(f"td_{c}").alias(c) for c in books],
    )


def with_rankings(matches: DataFrame, rankings: DataFrame, **how) -> DataFrame:
    """Ranks that the match table lacks, from the ranking history: each side's last one on or before the event's day.

    ``rankings(player, ranking_date, rank)``, ``how`` as in :func:`history.rank_asof`; a rank that is there stays.
    """
    found = history.rank_asof(matches, rankings, **how)
    found = found.withColumns({f"{s}_rank": F.coalesce(F.col(f"{s}_rank").cast("double"), F.col(f"{s}_rank_asof").cast("double")) for s in "wl"})
    return found.select(*matches.columns)


def feature_table(matches: DataFrame, players: DataFrame | None = None, pool: Sequence[str] = ()) -> DataFrame:
    """Features known before each event, oriented to the favourite.

    Windows over the long table share the exchange by player; one fold keeps
    both ratings; one aggregation by event brings the sides back. ``pool`` names columns that divide the players into circles
    that never meet: their folds run in parallel and give the same ratings.
    Partitions are as many as the events ask for, which are counted first, so
    a task's sorts need as much memory at any size.
    """
    parts = max(matches.sparkSession.sparkContext.defaultParallelism, -(-2 * matches.count() // _TASK_ROWS))
    base = prices.orient_favourite(prices.pick_price_pair(link.drop_undated(matches, "match_date")))
    order = ("match_date", "level_ord", "round_ord", "A_key", "B_key", "match_id")
    long = history.to_long(base.withColumn("_ground", ratings.ground()), extra=("match_date", "surface", "_ground", "level_ord", "round_ord", "A_key", "B_key", "a_is_w"))
    long = long.repartition(parts, "player")
    last = (*order, "is_win")  # where two names have one key, a player meets themself
    long = history.rest_days(history.rolling_form(long, 5, order=last), order=last)
    long = history.h2h_before(history.rolling_form(long, 5, ("player", "_ground"), last, "form5_surf"), order=last)
    long = history.rest_days(long, by=("player", "_ground"), order=last, out="rest_ground")
    sides = ["form5", "form5_surf", "rest_days", "rest_ground", "h2h_played", "h2h_wins"]
    if players is not None:  # joined where the rows lie by player already
        long, sides = long.join(history.player_attributes(players), "player", "left"), [*sides, "lefty", "height_cm"]
    by_event = lambda df: df.repartition(parts, "match_id")
    df = history.attach_side_features(by_event(base), by_event(long.select("match_id", "is_win", "a_is_w", *sides)), sides)
    df = ratings.elo_sides(df.join(by_event(ratings.elo_both(base, order=order, pool=pool, partitions=parts)), "match_id"))
    days = {"elo": "rest_days", "selo": "rest_ground"}
    df = df.withColumns({f"{s}_{p}_decay": ratings.faded(F.col(f"{s}_{p}"), F.col(f"{s}_{d}")) for p, d in days.items() for s in "AB"})
    df = prices.diff_features(df, {f"{p}_decay": None for p in days}).drop("A_rest_ground", "B_rest_ground")
    df = history.h2h_rate_conf(history.rest_transforms(df))
    df = prices.side_values(df, "w_rank", "l_rank", "rank", 5000.0)
    if {"w_age", "l_age"} <= set(df.columns):
        df = prices.side_values(df, "w_age", "l_age", "age")
    df = prices.diff_features(df, {"form5": 0.5, "rest_days": 14})
    df = text.one_hot(df, "surface", ratings.SURFACES, "surf_")
    if "level" in df.columns:
        df = text.one_hot(df, "level", tuple(lexicon.LEVEL_ORDER), "level_").withColumnRenamed("level", "tourney_level_norm")
    if players is not None:
        df = history.compare_attributes(df)
    first = ("match_id", "match_date", "book_used", "y", "odds_A", "odds_B", "p_book_A", "round_ord", "level_ord", "best_of", "tourney_level_norm")
    kept = [c for c in df.columns if c.startswith(("A_", "B_", "surf_", "level_", "h2h_")) or c.endswith("_diff") or c == "lefty_vs_righty"]
    return df.select(*[c for c in first if c in df.columns], *[c for c in kept if c not in first])


def told_forecasts(pred: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """Predictions as ``(match_id, split, y, forecast, p)``: two rows an event, the market's and the model's."""
    rows = pred.where(F.col("split").isin(list(splits)))
    return rows.unpivot(["match_id", "split", "y"], ["p_book", "p_model"], "forecast", "p")


def calibration_reports(told: DataFrame, splits: Sequence[str] = ("val", "test"), forecasts: Sequence[str] = ("p_book", "p_model"), **how) -> DataFrame:
    """The calibration table of each split and forecast, all in one pass."""
    wanted = told.where(F.col("split").isin(list(splits)) & F.col("forecast").isin(list(forecasts)))
    return evaluate.calibration_table(wanted, "y", "p", "match_id", by=("split", "forecast"), **how)


def _fitted(data: DataFrame, names: Sequence[str], stages: StageTables, **settings) -> tuple:
    """The model and its calibrated val and test predictions; their raw scores are written once."""
    fitted, scored = model.train_boosted(data, names, stages=stages, **settings)
    kept = [c for c in ("match_id", "match_date", "split", "y", "p_book_A", "book_used", "p_raw") if c in scored.columns]
    scored = stages.keep(scored.where("split IN ('val', 'test')").select(*kept), "scored")
    return fitted, model.calibrate_isotonic(scored)


def evaluated(
    features: DataFrame, train_until: int, val: int, test: int, stages: StageTables | None = None, **settings
) -> dict[str, DataFrame]:
    """Fits, calibrates, blends. Reports by split and forecast: ``metrics``, ``deltas``, ``accuracy``, ``calibration``,
    ``importances``, ``predictions``, ``blend_weight``, ``blend`` (metrics) and ``blended`` (predictions).

    The features and the predictions are written once, as tables of
    ``stages``; all reports read these. ``settings`` go to
    :func:`model.train_boosted`.
    """
    stages = stages or StageTables(features.sparkSession)
    data = stages.keep(dataset.temporal_split(features, "match_date", train_until, val, test), "features")
    names = dataset.select_features(data)
    fitted, calibrated = _fitted(data, names, stages, **settings)
    pred = stages.keep(model.predictions(calibrated), "predictions")
    best = evaluate.blend_weight_search(pred.where("split = 'val'"), "y", "p_model", "p_book").first()
    blended = evaluate.blend_apply(pred.withColumn("w", F.lit(best.w)), F.col("w"), "p_model", "p_book")
    told = blended.unpivot(["match_id", "split", "y"], ["p_book", "p_model", "p_blend"], "forecast", "p")
    metrics = stages.keep(evaluate.prob_metrics(told, "y", "p", ("split", "forecast"), stages=stages), "metrics")
    own = told.where("forecast <> 'p_blend'")
    return {
        "metrics": metrics.where("forecast <> 'p_blend'"),
        "deltas": evaluate.metric_deltas(metrics, "p_book", "p_model"),
        "accuracy": evaluate.accuracy_at(own, "y", "p", by=("split", "forecast")),
        "calibration": calibration_reports(own, stages=stages),
        "importances": model.importances(features, fitted, names),
        "predictions": pred,
        "blend_weight": features.sparkSession.createDataFrame([(best.w, best.logloss)], "w double, logloss double"),
        "blend": metrics.where("forecast = 'p_blend'").select("split", F.lit(best.w).alias("w"), "logloss", "brier", "auc", "n"),
        "blended": blended,
    }


def permuted_refit(data: DataFrame, names: Sequence[str], stages: StageTables, seed: int = 42, **settings) -> DataFrame:
    """Val metrics of a fit on train targets dealt anew; its log loss is near ln 2 if nothing leaks. ``data`` has ``split``."""
    train = evaluate.permute_target(data.where("split = 'train'").select("match_id", "split", "y", *names), "y", "match_id", seed, stages=stages)
    dealt = stages.keep(train.unionByName(data.where("split = 'val'").select("match_id", "split", "y", *names)), "permuted")
    _, blind = model.train_boosted(dealt, names, stages=stages, **settings)
    blind = stages.keep(blind.where("split = 'val'").select("y", "p_raw"), "blind")  # read several times
    return evaluate.prob_metrics(blind, "y", "p_raw", stages=stages)


def diagnosed(
    features: DataFrame, train_until: int, val: int, test: int, mode: str = "full", book: str = "PS", seed: int = 42,
    stages: StageTables | None = None, **settings,
) -> dict[str, DataFrame]:
    """Checks of a feature table for leaks and of what its features add.

    Fits on all features or on the ``basic`` ones (no ratings, history or rest).
    ``metrics``, ``deltas`` and ``importances`` of that fit; ``book_metrics`` for
    events with prices of one book; ``single_auc`` of each feature on the val
    split; ``permuted``: :func:`permuted_refit`; ``post_match``: names of
    columns that are known only after the event. Stage tables as in
    :func:`evaluated`.
    """
    stages = stages or StageTables(features.sparkSession)
    data = stages.keep(dataset.temporal_split(features, "match_date", train_until, val, test), "features")
    names = dataset.select_features(data, mode=mode)
    fitted, calibrated = _fitted(data, names, stages, **settings)
    kept = stages.keep(calibrated.select("match_id", "split", "y", F.col("p_book_A").alias("p_book"), "p_model", "book_used"), "predictions")
    told = told_forecasts(kept)
    # Both sets of events in one pass: all, and those of one book.
    sets = F.explode(F.when(F.col("book_used") == book, F.array(F.lit("all"), F.lit("book"))).otherwise(F.array(F.lit("all"))))
    both = kept.withColumn("_set", sets).unpivot(["_set", "split", "y"], ["p_book", "p_model"], "forecast", "p")
    metrics = stages.keep(evaluate.prob_metrics(both, "y", "p", ("_set", "split", "forecast"), stages=stages), "metrics")
    all_ = metrics.where("_set = 'all'").drop("_set")
    rows = [(c,) for c in dataset.leak_guard(features)]
    return {
        "metrics": all_,
        "deltas": evaluate.metric_deltas(all_, "p_book", "p_model"),
        "book_metrics": metrics.where("_set = 'book'").drop("_set"),
        "importances": model.importances(features, fitted, names),
        "calibration": calibration_reports(told, forecasts=("p_model",), stages=stages),
        "single_auc": evaluate.single_feature_auc(dataset.impute_train_median(data, names).where("split = 'val'"), "y", names, stages=stages),
        "permuted": permuted_refit(data, names, stages, seed, **settings),
        "post_match": features.sparkSession.createDataFrame(rows, "column string"),
    }


def write_reports(reports: Mapping[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Each report to a folder of its name under ``path``."""
    for name, df in reports.items():
        tables.write_table(df, f"{path}/{name}", fmt)
