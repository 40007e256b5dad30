"""Point-in-time features: only rows strictly before an event in its order count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import initial_last

#: Total order of events; the id comes last, nulls come last.
ORDER = ("match_date", "level_ord", "round_ord", "A_key", "B_key", "match_id")


def match_order(columns: Sequence[str] = ORDER) -> list:
    """Sort keys for windows and folds, never for a global sort."""
    return [F.col(c).asc_nulls_last() for c in columns]


def to_long(df: DataFrame, w: str = "w", l: str = "l", extra: Sequence[str] = ("match_date",), match_id: str = "match_id") -> DataFrame:  # noqa: E741
    """Two rows an event: ``(match_id, player, opponent, is_win, extra..)``."""
    side = lambda p, o, win: F.struct(
        F.col(p).alias("player"), F.col(o).alias("opponent"), F.lit(win).alias("is_win")
    )
    both = F.explode(F.array(side(w, l, 1), side(l, w, 0))).alias("_side")
    return df.select(match_id, *extra, both).select(match_id, "_side.player", "_side.opponent", "_side.is_win", *extra)


def rolling_form(
    long: DataFrame, n: int, by: Sequence[str] = ("player",), order: Sequence[str] = ("match_date", "match_id"), out: str | None = None
) -> DataFrame:
    """Adds the mean result of the last ``n`` events before this one; null for the first."""
    w = Window.partitionBy(*by).orderBy(*match_order(order)).rowsBetween(-n, -1)
    return long.withColumn(out or f"form{n}", F.avg("is_win").over(w))


def rolling_form_surface(long: DataFrame, n: int = 5, surface: str = "surface", known: Sequence[str] = ("hard", "clay", "grass", "carpet"), **kw) -> DataFrame:
    """The same per player and surface; an unknown surface counts as hard."""
    ground = F.when(F.col(surface).isin(list(known)), F.col(surface)).otherwise("hard")
    return rolling_form(long.withColumn("_ground", ground), n, ("player", "_ground"), out=f"form{n}_surf", **kw).drop("_ground")


def rest_days(
    long: DataFrame, fill: int | None = None, clip: tuple[int, int] | None = None, by: Sequence[str] = ("player",),
    order: Sequence[str] = ("match_date", "match_id"), date: str = "match_date", out: str = "rest_days",
) -> DataFrame:
    """Adds days since the player's event before this one; null, or ``fill``, for the first."""
    days = F.datediff(date, F.lag(date).over(Window.partitionBy(*by).orderBy(*match_order(order))))
    if fill is not None:
        days = F.coalesce(days, F.lit(fill))
    if clip is not None:
        days = F.least(F.greatest(days, F.lit(clip[0])), F.lit(clip[1]))
    return long.withColumn(out, days)


def rest_transforms(df: DataFrame, lo: int = 0, hi: int = 14, short: int = 3) -> DataFrame:
    """Adds log1p of clipped rest, its difference, and short-rest flags (null rest is not short)."""
    clipped = lambda c: F.when(F.col(c).isNotNull(), F.log1p(F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))))
    df = df.withColumns({f"{s}_rest_log": clipped(f"{s}_rest_days") for s in "AB"})
    return df.withColumns(
        {
            "rest_log_diff": F.col("A_rest_log") - F.col("B_rest_log"),
            **{f"{s}_short_rest_lt{short}": F.coalesce(F.col(f"{s}_rest_days") < short, F.lit(False)).cast("int") for s in "AB"},
        }
    )


def h2h_before(long: DataFrame, order: Sequence[str] = ("match_date", "match_id")) -> DataFrame:
    """Adds earlier meetings of player and opponent, and the player's wins among them."""
    w = Window.partitionBy("player", "opponent").orderBy(*match_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumns(
        {"h2h_played": F.count("is_win").over(w), "h2h_wins": F.coalesce(F.sum("is_win").over(w), F.lit(0))}
    )


def h2h_rate_conf(df: DataFrame, empty_rate: float | None = None) -> DataFrame:
    """Adds win rate and 1/sqrt(meetings) of both sides (meetings at least 1), and differences.

    ``empty_rate``: the rate of sides that never met, instead of 0.
    """
    new = {}
    for s in "AB":
        met = F.greatest(F.col(f"{s}_h2h_played"), F.lit(1))
        rate = F.col(f"{s}_h2h_wins") / met
        if empty_rate is not None:
            rate = F.when(F.col(f"{s}_h2h_played") == 0, F.lit(empty_rate)).otherwise(rate)
        new |= {f"{s}_h2h_rate": rate, f"{s}_h2h_conf": 1 / F.sqrt(met)}
    df = df.withColumns(new)
    return df.withColumns(
        {
            "h2h_diff": (F.col("A_h2h_wins") - F.col("B_h2h_wins")).cast("double"),
            "h2h_rate_diff": F.col("A_h2h_rate") - F.col("B_h2h_rate"),
            "h2h_conf_diff": F.col("A_h2h_conf") - F.col("B_h2h_conf"),
        }
    )


def attach_side_features(df: DataFrame, long: DataFrame, cols: Sequence[str], match_id: str = "match_id") -> DataFrame:
    """Brings the long rows' columns back as ``A_..`` and ``B_..``: one aggregation by event, one join.

    Long rows that do not carry ``a_is_w`` get it by one more join.
    """
    first = (F.col("is_win") == 1) == F.col("a_is_w")
    pick = lambda c, a: F.max(F.when(first == F.lit(a), F.col(c)))
    wide = long if "a_is_w" in long.columns else long.join(df.select(match_id, "a_is_w"), match_id)
    wide = wide.select(match_id, "is_win", "a_is_w", *cols).groupBy(match_id)
    wide = wide.agg(*[pick(c, a).alias(f"{s}_{c}") for c in cols for s, a in (("A", True), ("B", False))])
    return df.join(wide, match_id, "left")


def player_attributes(players: DataFrame, key: str = "player_key", order: str = "player_id") -> DataFrame:
    """``(player, lefty, height_cm)``: of each key the last row by ``order``; a missing column is null for that attribute only.

    Without the key column it is made of ``name_first`` and ``name_last``, the
    key that full names have.
    """
    if key not in players.columns:
        full = F.concat_ws(" ", F.coalesce("name_first", F.lit("")), F.coalesce("name_last", F.lit("")))
        players = players.withColumn(key, initial_last(full, "name"))
    col = lambda c, kind: F.col(c).cast("string").try_cast(kind) if c in players.columns else F.lit(None).cast(kind)
    last = players.groupBy(F.col(key).alias("player")).agg(
        F.max_by(F.struct(F.upper(col("hand", "string")).alias("hand"), col("height_cm", "double").alias("cm")), F.col(order)).alias("_p")
    )
    lefty = F.coalesce(F.col("_p.hand").startswith("L"), F.lit(False)).cast("int")
    return last.select("player", lefty.alias("lefty"), F.col("_p.cm").alias("height_cm"))


def compare_attributes(df: DataFrame) -> DataFrame:
    """Adds the height difference and left against right, from both sides' attributes."""
    against = F.coalesce((F.col("A_lefty") == 1) & (F.col("B_lefty") == 0), F.lit(False))
    return df.withColumns({"height_diff": F.col("A_height_cm") - F.col("B_height_cm"), "lefty_vs_righty": against.cast("int")})


def attach_player_attributes(df: DataFrame, players: DataFrame, key: str = "player_key", order: str = "player_id") -> DataFrame:
    """Adds both sides' :func:`player_attributes` and :func:`compare_attributes`."""
    known = player_attributes(players, key, order)
    for s in "AB":
        side = known.select(F.col("player").alias(f"{s}_key"), F.col("lefty").alias(f"{s}_lefty"), F.col("height_cm").alias(f"{s}_height_cm"))
        df = df.join(side, f"{s}_key", "left")
    return compare_attributes(df)


def asof_join(
    events: DataFrame, history: DataFrame, by: Sequence[str], t: str, t_history: str, values: Sequence[str], tie: Sequence[str] = (), span_days: int = 366
) -> DataFrame:
    """Adds ``values`` of each event's last history row of equal ``by`` that is not later than it; null without one.

    Both sides are united and ordered by key and time, history first, and the
    last known value is carried forward. Time is cut into ranges of
    ``span_days``; what is known at a range's begin is carried in from a table
    of one row for each key and range, so a key with very many rows is many
    tasks. Of history rows of one time the last by ``tie`` counts. Null keys or
    times, of either side, match nothing.
    """
    known = history.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, t_history]))
    sides = events.select(F.struct(*events.columns).alias("_row"), *by, F.col(t).alias("_t"), F.lit(1).alias("_kind"))
    past = known.select(
        *by, F.col(t_history).alias("_t"), F.lit(0).alias("_kind"), F.struct(*values).alias("_v"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(tie)]).alias("_tie"),
    )
    both = sides.unionByName(past, allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.unix_date(F.col("_t").cast("date")) / span_days))
    range_ = Window.partitionBy(*by, "_b").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(range_)).where("_kind = 1")
    last = both.groupBy(*by, "_b").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.struct("_t", "_tie"))).alias("_v"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_b", F.last("_v", ignorenulls=True).over(earlier).alias("_c")).where("_c IS NOT NULL")
    out = seen.join(carried, [*by, "_b"], "left").withColumn("_v", F.coalesce("_v", "_c"))
    return out.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in values])


def rank_asof(
    df: DataFrame, rankings: DataFrame, match_id: str = "match_id", w: str = "w", l: str = "l", date: str = "match_date",  # noqa: E741
    player: str = "player", ranked_on: str = "ranking_date", rank: str = "rank", tie: Sequence[str] = (), span_days: int = 366,
) -> DataFrame:
    """Adds ``w_<rank>_asof``, ``l_<rank>_asof`` and the days since then: both sides' last ranking on or before the event's day.

    Sides are long rows, so one as-of join serves both; ids are unique.
    """
    side = lambda c, s: F.struct(F.col(c).alias("player"), F.lit(s).alias("side"))
    long = df.select(match_id, date, F.explode(F.array(side(w, "w"), side(l, "l"))).alias("s")).select(match_id, F.col(date).alias("_on"), "s.*")
    past = rankings.select(F.col(player).alias("player"), F.col(ranked_on).alias("_since"), F.col(rank).alias("_rank"), *tie)
    found = asof_join(long, past, ("player",), "_on", "_since", ("_rank", "_since"), tie, span_days)
    pick = lambda c, s: F.max(F.when(F.col("side") == s, c))
    wide = found.groupBy(match_id).agg(
        *[pick(F.col("_rank"), s).alias(f"{s}_{rank}_asof") for s in "wl"],
        *[pick(F.datediff("_on", "_since"), s).alias(f"{s}_{rank}_days") for s in "wl"],
    )
    return df.join(wide, match_id, "left")
