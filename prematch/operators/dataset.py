"""Splits, imputation and selection of features."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.stages import compiled

#: Numeric columns that are no features, by their role: ids, the target, prices and what follows from prices.
IDS, TARGET, PRICES = ("match_id", "player_id", "right_id"), ("y", "split"), ("odds_A", "odds_B", "p_book_A")
EXCLUDED = (*IDS, *TARGET, *PRICES)
# Beginnings of the basic features' names (without ratings, history and rest).
BASIC_PREFIXES = ("round_ord", "surf_", "A_rank", "B_rank", "rank_diff", "A_age", "B_age", "age_diff", "best_of")
POST_MATCH = ("minutes", "score")
POST_MATCH_PREFIXES = ("w_", "l_")


def temporal_split(df: DataFrame, date: str, train_until: int, val: int, test: int) -> DataFrame:
    """Adds ``split`` by year: train up to a year, one year each for val and test, null otherwise."""
    y = F.year(date)
    return df.withColumn("split", F.when(y <= train_until, "train").when(y == val, "val").when(y == test, "test"))


def single_book_subset(df: DataFrame, book: str = "PS", col: str = "book_used") -> DataFrame:
    return df.where(F.col(col) == book)


def select_features(
    df: DataFrame, exclude: Sequence[str] = EXCLUDED, mode: str = "full", keep_prefixes: Sequence[str] = BASIC_PREFIXES
) -> list[str]:
    """Numeric columns but ids, target and prices; ``basic`` keeps those of the prefixes only."""
    if mode not in ("full", "basic"):
        raise ValueError("mode is 'full' or 'basic'")
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]
    return numeric if mode == "full" else [c for c in numeric if c.startswith(tuple(keep_prefixes))]


#: Ranges of a pass over a column's values, and values that the last pass fetches at most for a column.
_BINS, _FETCH = 256, 1000
#: Rows, about, whose quantiles so far from the middle tell where to look first.
_HINT_ROWS, _HINT_SPAN = 200_000, 0.005


def _hints(df: DataFrame, at: Iterable[int], n: int) -> dict[int, tuple[float, float]]:
    """Quantiles just below and above the middle of columns ``v<i>``, in about ``_HINT_ROWS`` of ``n`` rows."""
    some = df.sample(_HINT_ROWS / n, seed=1) if n > _HINT_ROWS else df
    spans = [0.5 - _HINT_SPAN, 0.5 + _HINT_SPAN]
    told = some.agg(*[F.percentile_approx(f"v{i}", spans).alias(f"v{i}") for i in at]).first()
    return {i: tuple(told[f"v{i}"]) for i in at if told[f"v{i}"]}


def _between(v: Column, lo: float, hi: float) -> list[Column]:
    """How many values lie below ``lo``; how many from there to ``hi``, the least and the greatest of them."""
    inside = v.between(lo, hi)
    return [F.count_if(v < lo), F.count_if(inside), F.min(F.when(inside, v)), F.max(F.when(inside, v))]


def exact_medians(df: DataFrame, cols: Sequence[str], bins: int = _BINS, fetch: int = _FETCH) -> dict[str, float | None]:
    """Each column's median, the mean of the two middle values; None where all are null. NaN counts as null, infinities as the largest doubles.

    Rank selection in passes that serve all columns at once. Two quantiles of
    some rows only hint where to look; what lies below and between them is
    counted over all rows, and they become the bounds if the middle is there.
    Then a pass counts the
    values of a column's open bounds in ``bins`` ranges and keeps the range (or
    the two) where the middle lies, with its own least and greatest value, until
    the bounds hold one value or at most ``fetch`` rows, which are fetched.
    Only counts reach the driver. A value that fills half a column ends the
    search at once; each pass drops at least one value, usually all but one in
    ``bins``.
    """
    largest = F.lit(sys.float_info.max)
    values = [F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, largest), -largest)) for v in (F.col(c).cast("double") for c in cols)]
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])  # made once a row
    values = [F.col(f"v{i}") for i in range(len(cols))]
    with compiled(df.sparkSession):
        seen = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    open_ = {i: (seen[f"lo{i}"], seen[f"hi{i}"], 0, seen[f"n{i}"]) for i in range(len(cols)) if seen[f"n{i}"]}
    middle = {i: ((n - 1) // 2, n // 2) for i, (_, _, _, n) in open_.items()}
    still = lambda: {i: x for i, x in open_.items() if x[1] / 2 - x[0] / 2 > 0 and x[3] > fetch}
    if hinted := still():
        with compiled(df.sparkSession):
            near = _hints(df, hinted, max(n for _, _, _, n in hinted.values()))
            told = iter(df.agg(*[c for i in near for c in _between(values[i], *near[i])]).first() if near else ())
        for i, below, n, lo, hi in zip(near, told, told, told, told):
            if below <= middle[i][0] and middle[i][1] < below + n:
                open_[i] = (lo, hi, below, n)
    while wide := still():
        parts = []
        for i, (lo, hi, _, _) in wide.items():
            # Halves, so that a span beyond the largest double does not overflow.
            place = F.least(F.floor((values[i] / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)).cast("int")
            parts.append(F.when(values[i].between(lo, hi), F.struct(F.lit(i).alias("i"), place.alias("b"), values[i].alias("v"))))
        told = df.select(F.explode(F.array_compact(F.array(*parts))).alias("e")).groupBy("e.i", "e.b")
        counted: dict[int, list] = {}
        for r in told.agg(F.count("*").alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi")).collect():
            counted.setdefault(r.i, []).append(r)
        for i, (_, _, below, _) in wide.items():
            kept = []
            for r in sorted(counted[i], key=lambda r: r.lo):
                if below + r.n > middle[i][0] and below <= middle[i][1]:
                    kept.append((r.lo, r.hi, below, r.n))
                below += r.n
            # The two middles may lie in two neighbouring ranges; a range that holds one of them at its edge is that value.
            if len(kept) == 2:
                at = [kept[0][1], kept[1][0]]
                open_[i] = (at[0], at[1], middle[i][0], 0)
            else:
                open_[i] = kept[0]
    few = [i for i, x in open_.items() if x[0] < x[1] and x[3]]
    lists = {}
    if few:
        inside = [F.sort_array(F.collect_list(F.when(values[i].between(open_[i][0], open_[i][1]), values[i]))).alias(f"v{i}") for i in few]
        row = df.agg(*inside).first()
        lists = {i: row[f"v{i}"] for i in few}
    out: dict[str, float | None] = dict.fromkeys(cols)
    for i, (lo, hi, below, _) in open_.items():
        a, b = (lists[i][m - below] for m in middle[i]) if i in lists else (lo, hi)
        out[cols[i]] = a if a == b else (a + b) / 2
    return out


def impute_train_median(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Nulls become the train split's :func:`exact_medians`, in all splits; a column that is null throughout stays null.

    Medians are sought only of columns that have nulls, which one scan tells.
    """
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else ()
    cols = [c for c, n in zip(cols, holes) if n]
    medians = exact_medians(df.where(F.col(split) == "train"), cols) if cols else {}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def leak_guard(df: DataFrame, names: Sequence[str] = POST_MATCH, prefixes: Sequence[str] = POST_MATCH_PREFIXES) -> list[str]:
    """Columns that are known only after the event."""
    return [c for c in df.columns if c in names or c.startswith(tuple(prefixes))]
