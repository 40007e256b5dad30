"""Linking two sources of the same events: exact keys, then the nearest date under looser keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_main_rounds(df: DataFrame, col: str, rounds: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isin(list(rounds)))


def drop_undated(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k] == right[f"td_{k}"])
    return cond


def prefixed(right: DataFrame, prefix: str = "td_") -> DataFrame:
    """Column names are case-insensitive, so the right source's get a prefix."""
    return right.withColumnsRenamed({c: c if c.startswith(prefix) else prefix + c for c in right.columns})


def link_strict(left: DataFrame, right: DataFrame, keys: Sequence[str], dedupe: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Left join on equal ``keys``; ``right`` is prefixed. Several right rows give several rows.

    ``dedupe`` = (left id, right id, left date, right date) keeps the right row of the nearest date.
    """
    right = prefixed(right)
    if dedupe is None:
        return left.join(right, _same(left, right, keys), "left")
    left_id, right_id, t_left, t_right = dedupe
    best = _nearest(left, right, keys, t_left, t_right, None, None, left_id, right_id, False)
    return left.join(best, left_id, "left")


def _nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t_left: str, t_right: str, tolerance_days: int | None,
    prefer: str | None, left_id: str, right_id: str, bucket: bool,
) -> DataFrame:
    """(left id, right columns) of each left row's best candidate."""
    gap = F.abs(F.datediff(left[t_left], right[f"td_{t_right}"]))
    cond = _same(left, right, keys)
    need = [left_id, *keys, t_left, *([prefer] if prefer else [])]
    one = left.select(*dict.fromkeys(need))
    if tolerance_days is not None:
        cond &= gap <= tolerance_days
    if bucket and tolerance_days:
        # Windows as wide as the tolerance: a hot key's candidates are those of three windows, not all its rows.
        day = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / tolerance_days)
        one = one.withColumn("_w", F.explode(F.array(*[day(F.col(t_left)) + i for i in (-1, 0, 1)])))
        right = right.withColumn("td__w", day(F.col(f"td_{t_right}")))
        keys = [*keys, "_w"]
        gap = F.abs(F.datediff(one[t_left], right[f"td_{t_right}"]))
        cond = _same(one, right, keys) & (gap <= tolerance_days)
    else:
        gap = F.abs(F.datediff(one[t_left], right[f"td_{t_right}"]))
        cond = _same(one, right, keys)
        if tolerance_days is not None:
            cond &= gap <= tolerance_days
    other = ~F.coalesce(one[prefer] == right[f"td_{prefer}"], F.lit(False)) if prefer else F.lit(False)
    payload = F.struct(*[right[c] for c in right.columns if c != "td__w"])
    ranked = one.join(right, cond).select(
        F.col(left_id),
        F.struct(
            other.alias("other"), gap.alias("gap"), right[f"td_{t_right}"].alias("t"), right[f"td_{right_id}"].alias("i"),
            payload.alias("row"),
        ).alias("best"),
    )
    # The minimum is combined before its shuffle; no candidate list is sorted or kept.
    return ranked.groupBy(left_id).agg(F.min("best").alias("best")).select(left_id, "best.row.*")


def link_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t_left: str,
    t_right: str,
    tolerance_days: int,
    prefer: str | None = None,
    left_id: str = "match_id",
    right_id: str = "right_id",
    bucket: bool = False,
) -> DataFrame:
    """Left join to the right row of equal ``keys`` and nearest date within the tolerance.

    Candidates with an equal ``prefer`` column come first, then the smaller
    gap, the earlier date, the smaller right id. Left rows without a date or a
    candidate keep null right columns. ``bucket`` splits hot keys by time.
    """
    best = _nearest(left, prefixed(right), keys, t_left, t_right, tolerance_days, prefer, left_id, right_id, bucket)
    return left.join(best, left_id, "left")


@dataclass(frozen=True)
class Stage:
    name: str
    keys: Sequence[str]
    tolerance_days: int | None = None
    prefer: str | None = None


def _parts(df: DataFrame, kind: int, columns: Sequence[str], *more: Column) -> Column:
    """One number for a key of several parts, with its kind; null if a part is null. Parts are compared again after the join."""
    parts = [*[df[k].cast("string") for k in columns], *more]
    whole = F.lit(True)
    for c in parts:
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *parts).alias("h")))


def candidates(left: DataFrame, right: DataFrame, stages: Sequence[Stage], t_left: str, t_right: str, left_id: str, right_id: str) -> DataFrame:
    """``(left id, _met, td_<right id>, td_<right time>)``: pairs with the first stage whose terms they meet; ``right`` is prefixed.

    One equi-join of narrow rows. A strict stage has its own key. The others
    share the keys that they have in common and the time in blocks of four
    times their largest tolerance: a left row looks into the one or two blocks
    that its tolerance reaches, so a key with very many rows meets its
    neighbours in time, not all of them.
    """
    loose = [s for s in stages if s.tolerance_days is not None]
    common = [k for k in loose[0].keys if all(k in s.keys for s in loose)] if loose else []
    if loose and not common:
        raise ValueError("the stages with a tolerance have no key in common")
    wide = max([1, *[s.tolerance_days for s in loose]])
    block = lambda c, days=0: F.floor((F.unix_date(c.cast("date")) + days) / (4 * wide))
    near = len(stages)  # kinds of keys: a strict stage's place, or this
    strict = [(i, s) for i, s in enumerate(stages) if s.tolerance_days is None]
    of = {k: f"td_{k}" for s in stages for k in s.keys}
    left_keys = [_parts(left, i, s.keys) for i, s in strict]
    right_keys = [_parts(right, i, [of[k] for k in s.keys]) for i, s in strict]
    if loose:
        first, last = (block(left[t_left], days) for days in (-wide, wide))
        left_keys += [_parts(left, near, common, first), F.when(first != last, _parts(left, near, common, last))]
        right_keys += [_parts(right, near, [of[k] for k in common], block(right[f"td_{t_right}"]))]
    need = dict.fromkeys([left_id, t_left, *[k for s in stages for k in s.keys], *[s.prefer for s in loose if s.prefer]])
    have = dict.fromkeys([f"td_{c}" for c in (right_id, t_right, *[k for s in stages for k in s.keys], *[s.prefer for s in loose if s.prefer])])
    one = left.select(*need, F.explode(F.array_compact(F.array(*left_keys))).alias("_k"))
    two = right.select(*have, F.explode(F.array_compact(F.array(*right_keys))).alias("_rk"))
    gap = F.abs(F.datediff(one[t_left], two[f"td_{t_right}"]))
    of_kind = lambda i: (F.col("_k.kind") == i) & (F.col("_rk.kind") == i)
    met = []
    for i, s in enumerate(stages):
        if s.tolerance_days is None:
            met.append(F.when(of_kind(i) & _same(one, two, s.keys), F.struct(F.lit(i).alias("i"), F.lit(False).alias("other"), F.lit(0).alias("gap"))))
        else:
            other = ~F.coalesce(one[s.prefer] == two[f"td_{s.prefer}"], F.lit(False)) if s.prefer else F.lit(False)
            ok = of_kind(near) & _same(one, two, s.keys) & (gap <= s.tolerance_days)
            met.append(F.when(ok, F.struct(F.lit(i).alias("i"), other.alias("other"), gap.alias("gap"))))
    pairs = one.join(two, one["_k.h"] == two["_rk.h"])
    return pairs.select(left_id, F.coalesce(*met).alias("_met"), f"td_{right_id}", f"td_{t_right}").where("_met IS NOT NULL")


def link_staged(
    left: DataFrame, right: DataFrame, stages: Sequence[Stage], t_left: str, t_right: str, left_id: str = "match_id", right_id: str = "right_id"
) -> DataFrame:
    """Each stage links what the stages before it left open; adds ``stage`` (null: not linked).

    A stage without a tolerance is a strict one, and gives a row for each right
    row; the others give the nearest as in :func:`link_nearest`. All stages
    share the join of :func:`candidates`; each left row keeps the best of its
    best stage, ranked by keys alone in groups cut short before their shuffle.
    Whole right rows are joined last. ``left_id`` and ``right_id`` are unique.
    """
    right = prefixed(right)
    pairs = candidates(left, right, stages, t_left, t_right, left_id, right_id)
    strict = F.col("_met.i").isin([i for i, s in enumerate(stages) if s.tolerance_days is None])
    loose = lambda c: F.when(~strict, F.col(c))
    order = Window.partitionBy(left_id).orderBy("_met", loose(f"td_{t_right}"), loose(f"td_{right_id}"))
    best = pairs.withColumn("_rank", F.rank().over(order)).where("_rank = 1")
    names = F.array(*[F.lit(s.name) for s in stages])
    best = best.select(left_id, F.col(f"td_{right_id}").alias("_right"), names[F.col("_met.i")].alias("stage"))
    found = best.join(right, F.col("_right") == F.col(f"td_{right_id}")).select(left_id, *right.columns, "stage")
    return left.join(found, left_id, "left")


def link_coverage(df: DataFrame, price_cols: Sequence[str], matched: str = "td_right_id") -> DataFrame:
    """One row: rows, matched, with a price, without any."""
    priced = F.coalesce(*[F.col(c) for c in price_cols]).isNotNull()
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(matched).isNotNull()).alias("matched"),
        F.count_if(priced).alias("with_price"),
        F.count_if(~priced).alias("without_price"),
    )


def unmatched_sample(df: DataFrame, n: int = 30, matched: str = "td_right_id", order: Sequence[str] = ("match_id",)) -> DataFrame:
    return df.where(F.col(matched).isNull()).orderBy(*order).limit(n)


def missing_price_sample(df: DataFrame, price_cols: Sequence[str], n: int = 30, order: Sequence[str] = ("match_id",)) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c) for c in price_cols]).isNull()).orderBy(*order).limit(n)
