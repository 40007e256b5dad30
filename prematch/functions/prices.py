"""Prices of two sides: choice of a book, probabilities without margin, orientation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Books in order of preference, and an older order that also asks for prices above 1.
BOOKS = ("PS", "Avg", "B365", "EX", "IW")
BOOKS_STRICT = ("PS", "Avg", "B365", "Max", "LB", "EX")


def pick_price_pair(df: DataFrame, priority: Sequence[str] = BOOKS, min_price: float | None = None) -> DataFrame:
    """Adds ``book_used, oddsW, oddsL`` of the first book with both prices (each above ``min_price``); rows without go.

    Books whose columns are missing are passed over.
    """
    choices = []
    for book in priority:
        w, l = f"{book}W", f"{book}L"  # noqa: E741
        if w in df.columns and l in df.columns:
            good = F.col(w).isNotNull() & F.col(l).isNotNull()
            if min_price is not None:
                good &= (F.col(w) > min_price) & (F.col(l) > min_price)
            pair = F.struct(F.lit(book).alias("book"), F.col(w).cast("double").alias("w"), F.col(l).cast("double").alias("l"))
            choices.append(F.when(good, pair))
    if not choices:
        raise ValueError("no book of the priority list has both price columns")
    df = df.withColumn("_price", F.coalesce(*choices)).where("_price IS NOT NULL")
    return df.select(
        "*", F.col("_price.book").alias("book_used"), F.col("_price.w").alias("oddsW"), F.col("_price.l").alias("oddsL")
    ).drop("_price")


def implied_prob(odds_a: Column, odds_b: Column) -> Column:
    """Probability of side a without the book's margin."""
    return (1 / odds_a) / (1 / odds_a + 1 / odds_b)


def orient_favourite(
    df: DataFrame, w: str = "w", l: str = "l", odds_w: str = "oddsW", odds_l: str = "oddsL", ties: str = "smaller_key"  # noqa: E741
) -> DataFrame:
    """Adds ``A_key, B_key, y, a_is_w, odds_A, odds_B, p_book_A``; A is the side of the lower price.

    At equal prices A is the smaller key, or the winner (``ties='winner'``).
    """
    tie = {"smaller_key": F.col(w) <= F.col(l), "winner": F.lit(True)}[ties]
    first = F.when(F.col(odds_w) == F.col(odds_l), tie).otherwise(F.col(odds_w) < F.col(odds_l))
    df = df.withColumn("a_is_w", first)
    side = lambda x, y: F.when(F.col("a_is_w"), F.col(x)).otherwise(F.col(y))
    df = df.withColumns({"A_key": side(w, l), "B_key": side(l, w), "odds_A": side(odds_w, odds_l), "odds_B": side(odds_l, odds_w)})
    return df.withColumns(
        {"y": F.col("a_is_w").cast("int"), "p_book_A": implied_prob(F.col("odds_A"), F.col("odds_B"))}
    )


def side_values(df: DataFrame, w_col: str, l_col: str, out: str, fill: float | None = None) -> DataFrame:
    """Adds ``A_out, B_out, out_diff`` from winner and loser columns; null is ``fill`` in the difference, if given."""
    a = F.when(F.col("a_is_w"), F.col(w_col)).otherwise(F.col(l_col))
    b = F.when(F.col("a_is_w"), F.col(l_col)).otherwise(F.col(w_col))
    return diff_features(df.withColumns({f"A_{out}": a, f"B_{out}": b}), {out: fill})


def diff_features(df: DataFrame, fills: Mapping[str, float | None]) -> DataFrame:
    """Adds ``name_diff`` = A - B for each name, nulls counted as the name's fill."""
    filled = lambda c, v: F.col(c) if v is None else F.coalesce(F.col(c), F.lit(v))
    return df.withColumns({f"{n}_diff": filled(f"A_{n}", v) - filled(f"B_{n}", v) for n, v in fills.items()})
