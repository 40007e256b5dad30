"""Mixing sources to target weights by hierarchical budgeting.

The tree's inner levels and leaves are columns of the documents, for instance
domain, language and source. Budgets go down the tree: a node's budget is
shared among its children by weight, no child gets more than its capacity
(its tokens times the epochs allowed), and what a short child leaves goes to
its siblings. A node's capacity is that of its subtree, so a shortage is made
up among siblings first and reaches an ancestor only when a whole subtree is
used up. Each leaf then takes whole seeded epochs of its documents and a
prefix, to the token, of one more.

Everything is DataFrame operations in 64-bit integers, and their products in
decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import written

#: Words in the sense of the token counts.
WORDS = r"[^\x20\x09-\x0D]+"

_BUCKET_BITS = 12
_HASH_BITS = 60
#: A leaf's documents are joined to its budget in so many parts, so a hot source is no hot task.
_SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(name: Column, weights: Mapping[str, int], default: int) -> Column:
    if any(w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights are whole numbers from 1")
    found = F.lit(default).cast("long")
    for key, w in weights.items():
        found = F.when(name == key, F.lit(w).cast("long")).otherwise(found)
    return found


def _share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes(parent.., name, weight, cap, parent_budget): water-filling, to the token.

    Children in order of cap / weight; a child is full while the level that
    fills it, spread over all heavier ones, is within the parent's budget. The
    others share what is left by weight; running sums are rounded, so the
    shares add up exactly.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = nodes.withColumn("caps", F.sum("cap").over(upto)).withColumn(
        "rest", F.sum("weight").over(by) - F.sum("weight").over(upto)
    )
    big = lambda c: F.col(c).cast("decimal(19,0)")
    x = x.withColumn("full", big("weight") * big("caps") + big("cap") * big("rest") <= big("parent_budget") * big("weight"))
    x = x.withColumn(
        "left", F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(by)
    )
    open_weight = F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))
    x = x.withColumn("w_all", F.sum(open_weight).over(by)).withColumn("w_upto", F.sum(open_weight).over(upto))
    x = x.withColumns({"left": big("left"), "w_upto": big("w_upto")})
    line = F.expr("left * w_upto div w_all - left * (w_upto - weight) div w_all")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(line)).drop(
        "caps", "rest", "full", "left", "w_all", "w_upto", "parent_budget"
    )


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    *,
    share: tuple[int, int],
    max_epochs: int,
    default_weight: int = 1,
) -> DataFrame:
    """``leaves(levels.., tokens)`` with ``budget``; the whole budget is ``share`` (a fraction) of all tokens."""
    cap = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs).cast("long"))
    above = cap.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(
        F.lit(0).alias("root"),
        F.least(F.expr(f"t * {share[0]}L div {share[1]}L"), F.col("t") * max_epochs).alias("parent_budget"),
    )
    parent = ["root"]
    for depth, name in enumerate(levels):
        here = list(levels[: depth + 1])
        nodes = cap.groupBy(*here).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(F.col(name), weights.get(name, {}), default_weight))
        nodes = nodes.withColumn("root", F.lit(0)).join(above, parent)
        above = _share(nodes, parent, name)
        parent = here
        if depth + 1 < len(levels):
            above = above.select(*here, F.col("budget").alias("parent_budget"))
    return above.select(*levels, "tokens", "budget")


def mix(
    docs: DataFrame,
    *,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]] | None = None,
    default_weight: int = 1,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(doc_id, levels.., epoch, n_tokens, n_taken, leaf_budget, ..)``: one row for each document and epoch taken.

    ``levels`` names the tree's levels from the top and gives their columns.
    Epoch e of a leaf is all its documents in the order of a 60-bit hash of
    (seed, e, id); a leaf takes whole epochs, then a prefix of the next, whose
    last document is taken in part (``n_taken < n_tokens``: its first tokens).
    The prefix is found without sorting a leaf: token sums of hash ranges are
    added up, and only the one range that holds the cut is sorted, so a source
    with a third of all documents is no hot task.

    Nulls and missing names count as the node ``none``; a null text is empty.
    Documents without tokens are never taken. Ties of the hash go by id, then
    by tokens. Repeated rows are documents of their own. Without documents the
    result is empty. ``keep`` passes further columns, which break later ties.
    """
    names, kept = list(levels), list(keep or {})
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit("none")).alias(n) for n, c in levels.items()],
        word_count(F.col(text_col)).alias("n_tokens"),
        *[c.alias(n) for n, c in (keep or {}).items()],
    )
    base = written(base.where("n_tokens > 0"), "mix")
    leaves = base.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(
        leaves, names, weights or {}, share=share, max_epochs=max_epochs, default_weight=default_weight
    ).where("budget > 0")
    plan = written(
        plan.select(
            *names,
            F.col("budget").alias("leaf_budget"),
            F.expr("budget div tokens").alias("whole"),
            F.expr("budget % tokens").alias("part"),
        ),
        "mix",
    )
    at = F.conv(
        F.substring(
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.col("doc_id")).cast("binary")),
            1,
            _HASH_BITS // 4,
        ),
        16,
        10,
    ).cast("long")
    salted = lambda leaf: leaf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    dealt = dealt.join(salted(plan), [*names, "salt"]).withColumn("at", at)
    dealt = dealt.withColumn("bucket", F.shiftright("at", _HASH_BITS - _BUCKET_BITS))
    sums = dealt.where("part > 0").groupBy(*names, "bucket", "part").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.withColumn("upto", F.sum("tokens").over(run)).where("upto >= part AND upto - tokens < part")
    cut = cut.select(*names, F.col("bucket").alias("cut"), (F.col("upto") - F.col("tokens")).alias("before"))
    dealt = dealt.join(salted(cut), [*names, "salt"], "left")

    whole = dealt.where("whole > 0").select(
        "doc_id", *names, F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch"), "n_tokens",
        F.col("n_tokens").alias("n_taken"), "leaf_budget", *kept,
    )
    head = dealt.where("bucket < cut").select(
        "doc_id", *names, F.col("whole").alias("epoch"), "n_tokens", F.col("n_tokens").alias("n_taken"), "leaf_budget",
        *kept,
    )
    order = Window.partitionBy(*names).orderBy("at", "doc_id", "n_tokens", *kept)
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = dealt.where("bucket = cut").withColumn(
        "before", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")
    )
    edge = edge.where("before < part").select(
        "doc_id", *names, F.col("whole").alias("epoch"), "n_tokens",
        F.least(F.col("n_tokens"), F.col("part") - F.col("before")).alias("n_taken"), "leaf_budget", *kept,
    )
    return whole.unionByName(head).unionByName(edge).withColumn("epoch", F.col("epoch").cast("int"))


def mix_sql(
    *,
    table: str,
    levels: Mapping[str, str],
    weights: Mapping[str, Mapping[str, int]],
    share: tuple[int, int],
    max_epochs: int,
    seed: int,
    default_weight: int = 1,
) -> str:
    """DuckDB SQL of :func:`mix`; ``levels`` has SQL expressions."""
    names = list(levels)
    ctes = [
        f"base AS (SELECT * FROM (SELECT doc_id, {', '.join(f"coalesce(CAST({e} AS VARCHAR), 'none') AS {n}" for n, e in levels.items())}, "
        r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens "
        f"FROM {table}) WHERE n_tokens > 0)",
        f"leaves AS (SELECT {', '.join(names)}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY ALL)",
        f"b0 AS (SELECT 0 AS root, CAST(least(sum(tokens) * {share[0]} // {share[1]}, sum(tokens) * {max_epochs}) AS BIGINT) AS parent_budget FROM leaves)",
    ]
    parent = ["root"]
    for depth, name in enumerate(names):
        here = names[: depth + 1]
        case = "".join(f" WHEN {name} = '{k}' THEN {w}" for k, w in weights.get(name, {}).items())
        weight = f"CASE{case} ELSE {default_weight} END" if case else f"{default_weight}"
        p, upto = ", ".join(parent), f"PARTITION BY {', '.join(parent)} ORDER BY cap / weight, {name} ROWS UNBOUNDED PRECEDING"
        ctes += [
            f"n{depth} AS (SELECT 0 AS root, {', '.join(here)}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap, CAST({weight} AS BIGINT) AS weight FROM leaves GROUP BY {', '.join(here)})",
            f"s{depth} AS (SELECT *, sum(cap) OVER ({upto}) AS caps, sum(weight) OVER (PARTITION BY {p}) - sum(weight) OVER ({upto}) AS rest FROM n{depth} JOIN b{depth} USING ({p}))",
            f"f{depth} AS (SELECT *, weight * caps + cap * rest <= parent_budget * weight AS is_full FROM s{depth})",
            f"o{depth} AS (SELECT *, parent_budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {p}) AS remain, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {p}) AS w_all, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({upto}) AS w_upto FROM f{depth})",
            f"b{depth + 1} AS (SELECT {', '.join(here)}, {'' if depth + 1 < len(names) else 'tokens, '}CAST(CASE WHEN is_full THEN cap ELSE remain * w_upto // w_all - remain * (w_upto - weight) // w_all END AS BIGINT) AS {'parent_budget' if depth + 1 < len(names) else 'leaf_budget'} FROM o{depth})",
        ]
        parent = here
    keys = ", ".join(names)
    ctes += [
        f"plan AS (SELECT *, leaf_budget // tokens AS whole, leaf_budget % tokens AS part FROM b{len(names)} WHERE leaf_budget > 0)",
        f"dealt AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '{seed}', whole, doc_id)), 1, {_HASH_BITS // 4}) AS BIGINT) AS spot FROM base JOIN plan USING ({keys}))",
        f"run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY spot, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM dealt)",
    ]
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, {keys}, CAST(epoch AS INTEGER) AS epoch, n_tokens, n_tokens AS n_taken, leaf_budget "
        "FROM (SELECT *, unnest(range(whole)) AS epoch FROM dealt) "
        f"UNION ALL SELECT doc_id, {keys}, CAST(whole AS INTEGER), n_tokens, CAST(least(n_tokens, part - before) AS BIGINT), leaf_budget FROM run WHERE before < part"
    )
