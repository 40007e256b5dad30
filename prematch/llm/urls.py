"""Allow or block urls: rules by host suffix and path, and boosted trees for the rest.

The trees see lexical features only and learn from the urls that a rule
decides. Everything is Spark SQL and Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_chars", "n_host", "depth", "labels", "digits", "entropy", "params", "hyphens", "other", "suffix_rate", "suffix_n",
    "ending_rate", "ending_n",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + F.lit(4))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path start) that fits; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))
    )
    count = lambda pattern, of=url: F.regexp_count(of, F.lit(pattern)).cast("double")
    return df.withColumns(
        {
            "n_chars": F.length(url).cast("double"),
            "n_host": F.length("host").cast("double"),
            "depth": count("/[^/]", F.col("path")),
            "labels": count(r"[^.]+", F.col("host")),
            "digits": count("[0-9]") / n,
            "entropy": entropy,
            "params": count("[?&][^=&#]+="),
            "hyphens": count("-"),
            "other": count("[^a-zA-Z0-9/.:]") / n,
            "suffix": F.substring_index("host", ".", -1),
            "ending": F.substring_index("host", ".", -2),
        }
    )


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    sample: int = 20_000,
    trees: int = 12,
    depth: int = 4,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_probability)`` for each row.

    A rule's verdict stands; for other urls the trees decide (block from 0.5).
    They are fitted on the ``sample`` rule-labelled urls of the smallest hash;
    the block rates of host suffixes (last label, last two labels) are those of
    all labelled urls; a labelled url's own label is left out of its rates, so
    the trees learn how far to trust a rare suffix. Rules of one length go by
    host and path, the greater wins. Whole urls count, however long. Null urls and urls without ``://`` have an empty host and
    path and fit no rule. If the labelled urls are all alike, or there are none,
    their verdict (``allow`` if none) is everyone's. Ids may be null or repeat;
    equal urls get equal verdicts. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    out = ("page_id", "host", "path", "rule", "verdict", "block_probability")

    labelled = rows.where("said IS NOT NULL")
    sizes = {r.said: r["count"] for r in labelled.groupBy("said").count().collect()}
    if len(sizes) < 2:
        only = next(iter(sizes), "allow")
        p = F.lit(float(only == "block"))
        return rows.withColumns({"verdict": F.coalesce("said", F.lit(only)), "block_probability": p}).select(*out)

    prior = sizes["block"] / sum(sizes.values())
    ready = _lexical(rows)
    block = (F.col("said") == "block").cast("double")
    for key in ("suffix", "ending"):
        rate = ready.where("said IS NOT NULL").groupBy(key).agg(
            F.sum(block).alias("_blocked"), F.count("*").alias("_all")
        )
        # A suffix is a key with a fixed rate: the table is written once, and a hot one is split as a skewed join.
        ready = ready.join(written(rate, "suffix"), key, "left").fillna(0, ["_blocked", "_all"])
        others = F.col("_all") - F.col("said").isNotNull().cast("long")
        blocked = F.col("_blocked") - F.coalesce(block, F.lit(0.0))
        ready = ready.withColumns({f"{key}_rate": (blocked + 5 * prior) / (others + 5), f"{key}_n": F.log1p(others)}).drop("_blocked", "_all")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
    fitted = ready.where("said IS NOT NULL").withColumn("label", block).orderBy(F.xxhash64("url"), "url").limit(sample)
    fitted = written(fitted.select("features", "label"), "urls")
    if len({r.label for r in fitted.select("label").distinct().collect()}) < 2:
        return rows.withColumns({"verdict": F.coalesce("said", F.lit("block" if prior >= 0.5 else "allow")), "block_probability": F.lit(prior)}).select(*out)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(fitted)
    scored = model.transform(ready).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce("said", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*out)
