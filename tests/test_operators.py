import contextlib
import datetime
import math
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from prematch.functions import prices, text
from prematch.jobs import model, workloads
from prematch.operators import circles, dataset, evaluate, history, link, ratings
from prematch.sources import tables
from prematch.sources.stages import StageTables

D = datetime.date


def _matches(spark, n=300, players=12, pools=2, shuffle=0):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rnd.sample(range(players), 2)
        pool = i % pools
        rows.append((i, D(2020, 1, 1) + datetime.timedelta(days=i // 3), f"{pool}-{a}", f"{pool}-{b}", f"pool{pool}", rnd.choice(["hard", "clay", "sand"])))
    if shuffle:
        random.Random(shuffle).shuffle(rows)
    return rows, spark.createDataFrame(rows, "match_id long, match_date date, w string, l string, pool string, surface string")


def _elo(rows, k=32.0, key=lambda r: r[4]):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = state.get((key(r), r[2]), 1500.0), state.get((key(r), r[3]), 1500.0)
        out[r[0]] = (a, b)
        gain = k * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        state[key(r), r[2]], state[key(r), r[3]] = a + gain, b - gain
    return out, state


@pytest.mark.parametrize(("pool", "parts"), [((), 3), (("pool",), 1), (("pool",), 5)])
def test_rating_fold(spark, pool, parts):
    rows, df = _matches(spark, shuffle=parts)
    got = {r.match_id: (r.elo_w, r.elo_l) for r in ratings.elo_before(df.repartition(parts), pool=pool).collect()}
    assert got == _elo(rows)[0]


def test_rating_continues_from_a_state(spark):
    rows, df = _matches(spark)
    want, _ = _elo(rows)
    _, state = _elo([r for r in rows if r[0] < 150])
    first = spark.createDataFrame([(p, x, v) for (p, x), v in state.items()], "pool string, player string, rating double")
    got = ratings.elo_before(df.where("match_id >= 150"), pool=("pool",), initial_state=first).collect()
    assert all((r.elo_w, r.elo_l) == want[r.match_id] for r in got) and len(got) == 150


def test_rating_sum_is_constant_and_surfaces_are_apart(spark):
    rows, df = _matches(spark)
    got = {r.match_id: (r.selo_w, r.selo_l) for r in ratings.elo_before_surface(df).collect()}
    assert got == _elo(rows, 24.0, lambda r: r[5] if r[5] != "sand" else "hard")[0]
    _, state = _elo(rows)
    assert abs(sum(state.values()) - 1500 * len(state)) < 1e-6


@pytest.mark.parametrize("pool", [(), ("pool",)])
def test_both_ratings_in_one_pass(spark, pool):
    rows, df = _matches(spark, shuffle=2)
    got = {r.match_id: tuple(r[1:]) for r in ratings.elo_both(df, pool=pool).collect()}
    all_, own = _elo(rows)[0], _elo(rows, 24.0, lambda r: r[5] if r[5] != "sand" else "hard")[0]
    assert got == {i: (*all_[i], *own[i]) for i in all_}


def test_a_later_event_never_changes_an_earlier_row(spark):
    rows, df = _matches(spark)
    long = lambda d: history.h2h_before(history.rest_days(history.rolling_form(history.to_long(d, extra=("match_date", "surface")), 5)))
    early = sorted(map(repr, long(df).where("match_id < 200").collect()))
    changed = df.withColumns({"w": F.when(F.col("match_id") >= 200, F.col("l")).otherwise(F.col("w")), "l": F.when(F.col("match_id") >= 200, F.col("w")).otherwise(F.col("l"))})
    assert sorted(map(repr, long(changed).where("match_id < 200").collect())) == early


def test_history_invariants(spark):
    _, df = _matches(spark)
    long = history.h2h_before(history.rolling_form(history.to_long(df, extra=("match_date",)), 5))
    by = {}
    for r in long.collect():
        assert 0 <= r.h2h_wins <= r.h2h_played and (r.form5 is None or 0 <= r.form5 <= 1)
        by.setdefault(r.match_id, []).append(r)
    assert all(a.h2h_played == b.h2h_played == a.h2h_wins + b.h2h_wins for a, b in by.values())


def test_orientation_and_prices(spark):
    rows = [(1, "b", "a", 2.0, 2.0, None, None), (2, "b", "a", None, 3.0, 1.5, 2.5), (3, "b", "a", None, None, 0.9, 2.0), (4, "a", "b", None, None, None, 1.1)]
    df = spark.createDataFrame(rows, "match_id int, w string, l string, PSW double, PSL double, AvgW double, AvgL double")
    got = {r.match_id: r for r in prices.orient_favourite(prices.pick_price_pair(df)).collect()}
    assert {k: (r.A_key, r.y, r.book_used) for k, r in got.items()} == {1: ("a", 0, "PS"), 2: ("b", 1, "Avg"), 3: ("b", 1, "Avg")}
    assert got[1].p_book_A == 0.5
    assert prices.orient_favourite(prices.pick_price_pair(df), ties="winner").where("match_id = 1").first().y == 1
    assert {r.match_id for r in prices.pick_price_pair(df, min_price=1.0).collect()} == {1, 2}


def test_nearest_link(spark):
    left = spark.createDataFrame([(1, "k", "F", D(2020, 1, 10)), (2, "k", "SF", D(2020, 3, 1)), (3, "k", "F", None), (4, "z", "F", D(2020, 1, 1))], "match_id int, key string, rnd string, day date")
    right = spark.createDataFrame([(9, "k", "QF", D(2020, 1, 10)), (8, "k", "F", D(2020, 1, 20)), (7, "k", "F", D(2019, 12, 31)), (6, "k", "F", D(2020, 2, 20))], "right_id int, key string, rnd string, day date")
    for bucket in (False, True):
        got = link.link_nearest(left, right, ("key",), "day", "day", 21, "rnd", bucket=bucket)
        assert {r.match_id: r.td_right_id for r in got.collect()} == {1: 7, 2: 6, 3: None, 4: None}
    got = link.link_nearest(left, right, ("key",), "day", "day", 21)
    assert {r.match_id: r.td_right_id for r in got.collect()} == {1: 9, 2: 6, 3: None, 4: None}
    strict = link.link_strict(left, right, ("key", "rnd"))
    assert sorted((r.match_id, r.td_right_id or 0) for r in strict.collect()) == [(1, 6), (1, 7), (1, 8), (2, 0), (3, 6), (3, 7), (3, 8), (4, 0)]
    one = link.link_strict(left, right, ("key", "rnd"), dedupe=("match_id", "right_id", "day", "day"))
    assert one.where("match_id = 1").first().td_right_id == 7


@pytest.mark.parametrize(("n", "sizes"), [(2352, [236, *[235] * 8, 236]), (2376, [238, 238, 237, 238, 237, 238, 237, 238, 237, 238])])
def test_calibration_bins(spark, n, sizes):
    df = spark.range(n).select("id", (F.floor(F.col("id") / 400) / 10).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    rows = evaluate.calibration_table(df, "y", "p", "id").orderBy("bin").collect()
    assert [r.n for r in rows] == sizes


def test_index_is_the_order(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0.5, 0.5, 0.5, rnd.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, p double").repartition(7)
    want = {i: k for k, (_, i) in enumerate(sorted((p, i) for i, p in rows))}
    for n in (1 << 20, 40):  # one range, many
        assert {r.id: r.i for r in evaluate.global_index(df, "p", "id", rows=n).collect()} == want


def test_metrics(spark):
    rnd = random.Random(2)
    rows = [("s", rnd.randrange(2), round(rnd.random(), 1)) for _ in range(300)] + [("one", 1, 0.3)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r for r in evaluate.prob_metrics(df, "y", "p", ("g",), 1e-6).collect()}
    part = [(y, p) for g, y, p in rows if g == "s"]
    pos, neg = [p for y, p in part if y], [p for y, p in part if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    loss = -sum(math.log(clip(p)) if y else math.log(1 - clip(p)) for y, p in part) / len(part)
    assert got["s"].auc == pytest.approx(area) and got["s"].logloss == pytest.approx(loss) and got["s"].n == 300
    assert got["one"].auc is None


def test_blend_is_no_worse_than_its_ends(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.randrange(2), rnd.random(), rnd.random()) for _ in range(200)], "y int, a double, b double")
    best = evaluate.blend_weight_search(df, "y", "a", "b").first()
    ends = [evaluate.prob_metrics(df, "y", c, eps=1e-6).first().logloss for c in ("a", "b")]
    assert best.logloss <= min(ends) + 1e-12


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permuted_places_are_a_bijection(spark, n):
    got = [r.j for r in spark.range(n).select("id", evaluate.permuted_place(F.col("id"), F.lit(n), 5).alias("j")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    other = [r.j for r in spark.range(n).select("id", evaluate.permuted_place(F.col("id"), F.lit(n), 6).alias("j")).orderBy("id").collect()]
    if n == 1000:
        assert sum(i == j for i, j in enumerate(got)) < 10 and sum(i == j for i, j in zip(got, other)) < 10
        mean = sum((i - 499.5) * (j - 499.5) for i, j in enumerate(got)) / n / (n * n / 12)
        assert abs(mean) < 0.1


def test_ranges_hold_few_rows_at_any_size(spark):
    df = spark.range(6000).select(F.col("id"), (F.col("id") % 4).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1500)).alias("v"), (F.col("id") % 2).alias("y"))
    ranged = evaluate._ranges(df, ["v", "id"], 6000, 500, None)
    sizes = [r["count"] for r in ranged.groupBy("_b").count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 500 and sum(sizes) == 6000
    one = {r.g: r.auc for r in evaluate.auc(df, "y", "v", ("g",)).collect()}
    many = {r.g: r.auc for r in evaluate.auc(df, "y", "v", ("g",), rows=100).collect()}
    assert one == many
    bins = lambda n: sorted(map(tuple, evaluate.calibration_table(df, "y", "v", "id", by=("g",), rows=n).collect()))
    assert bins(1 << 20) == bins(200)


def test_permutation_keeps_the_targets(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("y"), F.lit("x").alias("z"))
    got = evaluate.permute_target(df, "y", "id", 1)
    assert got.columns == df.columns
    assert sorted(r.y for r in got.collect()) == sorted(i % 3 for i in range(100))
    assert [r.y for r in got.orderBy("id").collect()] != [i % 3 for i in range(100)]


def test_imputation_and_selection(spark):
    df = spark.createDataFrame([(1, "train", 1.0, None), (2, "train", 3.0, None), (3, "test", None, None)], "match_id long, split string, a double, b double")
    assert [r.a for r in dataset.impute_train_median(df, ("a", "b")).orderBy("match_id").collect()] == [1.0, 3.0, 2.0]
    assert dataset.select_features(df) == ["a", "b"]
    assert dataset.leak_guard(df.selectExpr("*", "1 AS w_ace", "2 AS minutes")) == ["w_ace", "minutes"]


def test_yearly_files(spark, tmp_path):
    for year in (2019, 2021):
        frame = spark.createDataFrame([(year, "x")], "a int, b string") if year == 2019 else spark.createDataFrame([(year,)], "a int")
        tables.write_table(frame, f"{tmp_path}/matches_{year}.parquet")
    got = tables.read_yearly(spark, str(tmp_path), range(2018, 2023), name="matches_{year}.parquet").orderBy("a").collect()
    assert [(r.a, r.b, r.year) for r in got] == [(2019, "x", 2019), (2021, None, 2021)]
    with pytest.raises(FileNotFoundError):
        tables.read_yearly(spark, str(tmp_path), [1999])


def test_years_are_one_scan(spark, tmp_path):
    for year in range(2001, 2013):
        frame = spark.range(3).select((F.col("id") + year).alias("a"), F.lit("x").alias("b"))
        tables.write_table(frame if year % 2 else frame.drop("b"), f"{tmp_path}/y={year}")
        tables.write_table(frame.select("b", "a") if year == 2005 else frame, f"{tmp_path}/m_{year}.csv", "csv")
    got = tables.read_yearly(spark, str(tmp_path), range(1990, 2020), name="y={year}")
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = got.collect()
    assert len(rows) == 36 and all(r.year <= r.a < r.year + 3 and (r.b == "x") == (r.year % 2 == 1) for r in rows)
    text = tables.read_yearly(spark, str(tmp_path), range(1990, 2020), name="m_{year}.csv")
    assert text._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2  # two orders of columns
    rows = text.collect()
    assert len(rows) == 36 and all(r.year <= int(r.a) < r.year + 3 and r.b == "x" for r in rows)
    kind = spark.createDataFrame([], "a long, c double").schema
    typed = tables.read_yearly(spark, str(tmp_path), [2001, 2005], kind, "m_{year}.csv")
    assert typed.columns == ["a", "c", "year"] and sorted(r.a for r in typed.collect()) == [2001, 2002, 2003, 2005, 2006, 2007]


def test_a_pair_of_very_many_meetings(spark):
    n, day = 4000, lambda c, off: F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") * 3 + off).cast("int"))
    left = spark.range(n).select(F.col("id").alias("match_id"), F.lit("c").alias("city"), F.lit("p").alias("pair"), (F.col("id") % 50).cast("string").alias("rnd"), day("id", 0).alias("day"))
    right = spark.range(n).select(F.col("id").alias("right_id"), F.lit("c").alias("city"), F.lit("p").alias("pair"), F.lit("none").alias("rnd"), day("id", 1).alias("day"))
    stages = (link.Stage("strict", ("city", "rnd", "pair")), link.Stage("near", ("city", "pair"), 21, "rnd"), link.Stage("loose", ("pair",), 14))
    met = link.candidates(left, link.prefixed(right), stages, "day", "day", "match_id", "right_id")
    assert met.count() <= 15 * n
    got = {r.match_id: (r.td_right_id, r.stage) for r in link.link_staged(left, right, stages, "day", "day").collect()}
    assert got == {i: (i, "near") for i in range(n)}


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    spark.range(400_000).select(F.col("id").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b")).coalesce(1).write.parquet(f"{tmp_path}/one")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.read.parquet(f"{tmp_path}/one")
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # many splits, all rows in one
        rows = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows(df)) == 1
        assert sum(rows(tables.spread(df, "a"))) == 400_000 and max(rows(tables.spread(df, "a"))) < 150_000
        assert len(rows(tables.spread(df, "a"))) % spark.sparkContext.defaultParallelism == 0  # whole waves
        even = df.repartition(4)
        assert tables.spread(even) is even and tables.spread(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_few_blocks_of_time_a_row(spark):
    day = F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int"))
    left = spark.range(1000).select(F.col("id").alias("match_id"), F.lit("p").alias("pair"), day.alias("day"))
    right = link.prefixed(left.withColumnRenamed("match_id", "right_id"))
    met = link.candidates(left, right, (link.Stage("near", ("pair",), 21),), "day", "day", "match_id", "right_id")
    got = {tuple(r) for r in met.select("match_id", "td_right_id").collect()}
    assert got == {(a, b) for a in range(1000) for b in range(max(0, a - 21), min(1000, a + 22))} and met.count() == len(got)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("84.0") >= 2 and "xxhash64" in plan  # blocks of four tolerances, of which a row looks into two at most


def test_stages_equal_a_loop(spark):
    rnd = random.Random(20)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(days=rnd.randrange(120)) if rnd.random() > 0.05 else None
    pick = lambda *v: rnd.choice([*v, *v, None])
    lrows = [(i, pick("a", "b"), pick("x", "y"), pick("F", "R"), day()) for i in range(120)]
    rrows = [(i, pick("a", "b"), pick("x", "y"), pick("F", "R"), day()) for i in range(60)]
    left = spark.createDataFrame(lrows, "match_id long, city string, pair string, rnd string, day date")
    right = spark.createDataFrame(rrows, "right_id long, city string, pair string, rnd string, day date")
    stages = (link.Stage("strict", ("city", "rnd", "pair")), link.Stage("near", ("city", "pair"), 9, "rnd"), link.Stage("loose", ("pair",), 4, "rnd"))
    at = {"city": 1, "pair": 2, "rnd": 3}
    want = []
    for l in lrows:  # noqa: E741
        for s in stages:
            same = [r for r in rrows if all(l[at[k]] is not None and l[at[k]] == r[at[k]] for k in s.keys)]
            if s.tolerance_days is None:
                found = [r[0] for r in same]
            else:
                near = [(not (l[3] is not None and l[3] == r[3]), abs((l[4] - r[4]).days), r[4], r[0]) for r in same if l[4] and r[4]]
                near = [x for x in near if x[1] <= s.tolerance_days]
                found = [min(near)[3]] if near else []
            if found:
                want += [(l[0], r, s.name) for r in found]
                break
        else:
            want.append((l[0], None, None))
    got = link.link_staged(left, right, stages, "day", "day").select("match_id", "td_right_id", "stage").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_columns(spark):
    df = spark.createDataFrame([(None, "a", 1.5)], "` Player 1` string, EVENT string, PSW double")
    got = tables.standardize_columns(df, required=("Winner", "Tournament", "Round"))
    assert got.first().asDict() == {"Winner": "", "Tournament": "a", "PSW": 1.5, "Round": ""}
    assert tables.detect_price_columns(got) == ["PSW"]


def test_columns_of_one_meaning(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "b", 2), (None, None, 3)], "tourney string, `Event ` string, p1 int")
    got = tables.standardize_columns(df, required=("Tournament",)).collect()
    assert [(r.Tournament, r.Winner) for r in got] == [("a", 1), ("b", 2), ("", 3)]
    mixed = tables.standardize_columns(df.select("tourney", F.col("p1").alias("EVENT")), required=("Tournament",)).collect()
    assert [r.Tournament for r in mixed] == ["a", "2", "3"]


def test_exact_medians(spark):
    rnd = random.Random(8)
    inf = float("inf")
    columns = {
        "even": [rnd.gauss(0, 1e6) for _ in range(400)],
        "odd": [float(i) for i in range(399)] + [None],
        "ties": [7.0] * 250 + [rnd.random() for _ in range(150)],
        "edge": [1.0] * 200 + [2.0] * 200,
        "wide": [2.0**rnd.randrange(-900, 900) * rnd.choice((1, -1)) for _ in range(400)],
        "odd_values": [None, float("nan"), -inf, inf, inf] * 20 + [3.0] * 300,
        "few": [1.5, 2.5] + [None] * 398,
        "none": [None] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(5)
    want = {}
    for c, values in columns.items():
        v = sorted(x for x in values if x is not None and x == x)
        want[c] = None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    for bins, fetch in ((256, 1000), (4, 3)):
        assert dataset.exact_medians(df, list(columns), bins, fetch) == want
    assert dataset.exact_medians(df.where("false"), ["odd"]) == {"odd": None}


def test_medians_are_exact_whatever_the_hint(spark, monkeypatch):
    rows = [(float(i * 7919 % 5003), float(i % 3)) for i in range(5003)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    want = {"a": 2501.0, "b": 1.0}
    passes = []
    explode = F.explode
    monkeypatch.setattr(dataset.F, "explode", lambda c: passes.append(1) or explode(c))
    assert dataset.exact_medians(df, ("a", "b")) == want and not passes  # the hint leaves few rows: no pass that deals values to ranges
    for wrong in ({0: (0.0, 3.0), 1: (2.0, 2.0)}, {0: (4000.0, 4100.0)}, {}):
        monkeypatch.setattr(dataset, "_hints", lambda df, at, n: wrong)
        assert dataset.exact_medians(df, ("a", "b")) == want
    assert passes


def _sources(spark):
    results = [
        (1, D(2020, 1, 6), "Rome", "Clay", "Final", "Rafael Nadal", "Kei Nishikori", "M", "5", 30.0),
        (2, D(2020, 1, 6), "Rome", "Clay", "Semifinals", "Rafael Nadal", "Juan Martin Del Potro", "", None, 30.0),
        (3, D(2020, 3, 2), "Wien", "Hard", "R16", "Kei Nishikori", "Rafael Nadal", "", "3.0", 29.0),
        (4, D(2020, 3, 2), "Wien", "Hard", "R16", "", "", "", None, None),
    ]
    odds = [
        (11, D(2020, 1, 14), "Roma", "clay", "The Final", "Nadal R.", "Nishikori K.", "Masters 1000", 1.5, 2.6),
        (12, D(2020, 1, 13), "Rome", "Clay", "Semifinals", "Nadal R.", "Del Potro J.M.", "", 1.4, 2.9),
        (13, D(2020, 1, 12), "Rome", "Clay", "Semifinals", "Nadal R.", "Del Potro J.M.", "", 1.3, 3.1),
        (14, D(2020, 3, 4), "Vienna", "Indoor Hard", "3rd Round", "Nishikori K.", "Nadal R.", "ATP500", 3.0, 1.4),
        (15, D(2020, 3, 4), "Vienna", "Hard", "3rd Round", "", "", "ATP500", 3.0, 1.4),
    ]
    players = [(1, "Juan Martin", "Del Potro", "r", "198"), (2, "Rafael", "Nadal", "l", "185"), (3, "Kei", "Nishikori", "R", None)]
    return (
        spark.createDataFrame(results, "match_id long, date_tourney date, tourney_name string, surface string, round string, winner_name string, loser_name string, tourney_level string, best_of string, winner_age double"),
        spark.createDataFrame(odds, "right_id long, Date_dt date, Location string, Surface string, Round string, Winner string, Loser string, Series string, PSW double, PSL double"),
        spark.createDataFrame(players, "player_id long, name_first string, name_last string, hand string, height_cm string"),
    )


def test_from_two_sources_to_features(spark):
    results, odds, players = _sources(spark)
    found = workloads.linked(results, odds, players)
    got = sorted((r.match_id, r.td_right_id, r.stage) for r in found.collect() if r.stage)
    # "The Final" is no main round, so match 1 has no odds; blank names link with nothing.
    assert got == [(2, 12, "strict"), (2, 13, "strict"), (3, 14, "strict")]
    matches = {r.match_id: r for r in workloads.match_table(found).collect()}
    assert len(matches) == 4 and matches[2].match_date == D(2020, 1, 13) and matches[2].PSW == 1.4
    assert (matches[3].surface, matches[3].rnd, matches[3].round_ord, matches[3].level, matches[3].level_ord, matches[3].best_of) == ("hard", "R16", 4, "ATP500", 2, 3)
    assert (matches[1].level, matches[1].best_of, matches[1].w) == ("M1000", 5, "r nadal")
    feats = {r.match_id: r for r in workloads.feature_table(workloads.match_table(found), players).collect()}
    assert sorted(feats) == [2, 3]
    assert (feats[2].A_key, feats[2].B_key, feats[2].y, feats[2].A_lefty, feats[2].A_height_cm, feats[2].B_height_cm) == ("r nadal", "j del potro", 1, 1, 185.0, None)
    assert (feats[3].B_lefty, feats[3].lefty_vs_righty) == (0, 1)
    assert (feats[3].A_key, feats[3].y, feats[3].A_rest_days, feats[3].level_ATP500, feats[3].best_of) == ("r nadal", 0, 51, 1, 3)
    assert feats[3].A_elo == 1516.0 and abs(feats[3].A_elo_decay - (1500 + 16 * 0.5 ** (51 / 180))) < 1e-9 and feats[3].A_selo == 1500.0


@contextlib.contextmanager
def _jobs(spark):
    """The jobs of the block."""
    group, told = uuid.uuid4().hex, []
    spark.sparkContext.setJobGroup(group, group)
    try:
        yield told
    finally:
        told += spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_features_are_computed_once(spark):
    rows, df = _matches(spark, n=900, players=20, pools=3)
    odds = lambda k: F.lit(1.2) + F.pmod(F.xxhash64("match_id", F.lit(k)), F.lit(200)) / 100
    df = df.withColumns({"PSW": odds(1), "PSL": odds(2), "level_ord": F.lit(1), "round_ord": F.lit(2), "best_of": F.lit(3), "w_rank": odds(3), "l_rank": odds(4)})
    folds = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            folds.add(b.num_rows)
            yield b

    features = workloads.feature_table(df, pool=("pool",))
    counted = features.mapInArrow(seen, features.schema)
    with StageTables(spark) as stages:
        split = counted.withColumn("match_date", F.make_date(F.lit(2019) + F.floor(F.col("match_id") / 300).cast("int"), F.lit(1), F.lit(1)))
        with _jobs(spark) as jobs:
            reports = workloads.evaluated(split, 2019, 2020, 2021, stages, trees=2)
            told = {k: v.collect() for k, v in reports.items()}
        assert folds.value == 900
        assert len(told["predictions"]) == 600 and len(told["calibration"]) == 40 and len(told["metrics"]) == 4 and len(told["blend"]) == 2
        assert len(jobs) <= 60, len(jobs)
        base = stages.base
    assert not os.path.exists(base.removeprefix("file://"))


def test_reports_and_diagnosis(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for i in range(900):
        a, p = rnd.gauss(0, 1), rnd.uniform(0.5, 0.9)
        rows.append((i, D(2019 + i // 300, 1, 1), int(rnd.random() < 1 / (1 + math.exp(-2 * a))), rnd.choice(["PS", "Avg"]), p, a, rnd.random()))
    feats = spark.createDataFrame(rows, "match_id long, match_date date, y int, book_used string, p_book_A double, A_form5 double, round_ord double")
    out = workloads.diagnosed(feats, 2019, 2020, 2021, trees=5)
    permuted = out["permuted"].first()
    assert abs(permuted.logloss - math.log(2)) < 0.1 and permuted.n == 300  # 300 rows only
    assert out["single_auc"].first().feature == "A_form5" and out["post_match"].count() == 0
    full = {(r.split, r.forecast): r for r in out["metrics"].collect()}
    assert full["test", "p_model"].auc > 0.7 and {r.n < 300 for r in out["book_metrics"].collect()} == {True}
    basic = workloads.diagnosed(feats, 2019, 2020, 2021, mode="basic", trees=2)["metrics"].collect()
    assert all(r.auc < 0.6 for r in basic if r.forecast == "p_model" and r.split == "test")
    reports = workloads.evaluated(feats, 2019, 2020, 2021, trees=3)
    bins = reports["calibration"].groupBy("split", "forecast").agg(F.count("*").alias("bins"), F.sum("n").alias("n")).collect()
    assert len(bins) == 4 and all((r.bins, r.n) == (10, 300) for r in bins)
    workloads.write_reports({k: reports[k] for k in ("metrics", "accuracy", "blend_weight")}, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/metrics", header=True).count() == 4
    assert 0 <= float(spark.read.csv(f"{tmp_path}/blend_weight", header=True).first().w) <= 1


def test_isotonic_calibration_equals_pooled_neighbours(spark):
    rnd = random.Random(7)
    rows = [(i, "val" if i < 60 else "test", int(rnd.random() < i % 60 / 80 + 0.1), (i % 60) / 60 + 0.001) for i in range(90)]
    got = {r.match_id: r.p_model for r in model.calibrate_isotonic(spark.createDataFrame(rows, "match_id long, split string, y int, p_raw double")).collect()}
    blocks: list[list[float]] = []
    for _, _, y, _ in rows[:60]:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n]
    want = [s / n for s, n in blocks for _ in range(n)]
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(60))
    assert all(abs(got[60 + i] - want[i]) < 1e-9 for i in range(30))


def test_a_plateau_ends_nothing():
    losses = [0.9, 0.8, 0.8, 0.81, 0.82, 0.7, 0.71, 0.7, 0.69, 0.75]
    assert model.best_prefix(losses) == 9 and model.best_prefix(losses, 3) == 2 and model.best_prefix(losses, 4) == 9
    assert model.best_prefix([0.5]) == 1 and model.best_prefix([0.5, 0.5]) == 1


def test_trees_follow_the_val_split(spark):
    """Train targets are noise, so few trees are kept; the prefix is that of the same trees."""
    rnd = random.Random(3)
    rows = [(i, ("train", "val")[i // 300], rnd.randrange(2), rnd.random(), rnd.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "match_id long, split string, y int, a double, b double").repartition(1).sortWithinPartitions("match_id")
    fitted, _ = model.train_boosted(df, ("a", "b"), trees=15, least_rows=5)
    assert fitted.getNumTrees < 15
    whole, _ = model.train_boosted(df.where("split = 'train'"), ("a", "b"), trees=15, least_rows=5)
    assert whole.getNumTrees == 15
    assert [t.toDebugString.split("\n", 1)[1] for t in whole.trees[: fitted.getNumTrees]] == [t.toDebugString.split("\n", 1)[1] for t in fitted.trees]


def test_asof_join_equals_a_loop(spark):
    rnd = random.Random(12)
    day = lambda n: D(2020, 1, 1) + datetime.timedelta(days=n)
    events = [(i, rnd.choice(["a", "b", "c", None]), day(rnd.randrange(900)) if i % 20 else None, "z") for i in range(300)]
    past = [(i, rnd.choice(["a", "a", "a", "b", None]), day(rnd.randrange(900)) if i % 15 else None, rnd.choice([None, rnd.randrange(9)])) for i in range(200)]
    left = spark.createDataFrame(events, "id long, key string, day date, v2 string").repartition(3)
    right = spark.createDataFrame(past, "hid long, key string, day date, v long").repartition(3)
    want = {}
    for i, k, d, _ in events:
        found = [(x, h, v) for h, q, x, v in past if k is not None and d is not None and q == k and x is not None and x <= d]
        want[i] = (max(found)[1:] if found else (None, None))
    for span in (7, 366, 10_000):
        got = history.asof_join(left, right.withColumnRenamed("day", "since"), ("key",), "day", "since", ("hid", "v"), ("hid",), span).collect()
        assert {r.id: (r.hid, r.v) for r in got} == want and len(got) == 300
        assert set(got[0].asDict()) == {"id", "key", "day", "v2", "hid", "v"}
    assert history.asof_join(left, right.where("false"), ("key",), "day", "day", ("v",)).where("v IS NOT NULL").count() == 0


def test_rank_asof_of_both_sides(spark):
    df = spark.createDataFrame([(1, D(2020, 5, 1), "a", "b"), (2, D(2020, 1, 1), "b", "c"), (3, None, "a", "b"), (4, D(2021, 5, 1), "a", None)], "match_id long, match_date date, w string, l string")
    rankings = spark.createDataFrame([("a", D(2020, 4, 1), 5), ("a", D(2020, 5, 1), 6), ("b", D(2020, 4, 30), 9)], "player string, ranking_date date, rank int")
    got = {r.match_id: r[4:] for r in history.rank_asof(df, rankings).collect()}
    assert got == {1: (6, 9, 0, 1), 2: (None, None, None, None), 3: (None,) * 4, 4: (6, None, 365, None)}


@pytest.mark.parametrize("n", [0, 40])
def test_circles_are_who_meets_whom(spark, n):
    rnd = random.Random(n)
    rows = [(f"p{rnd.randrange(70)}", f"p{rnd.randrange(70)}") for _ in range(n)] + [(f"q{i}", f"q{i + 1}") for i in range(n)] + [("s", "s"), (None, "t"), ("p1", None), (None, None)][: n]
    root = {x: x for r in rows for x in r if x}
    def find(x):
        return x if root[x] == x else find(root[x])
    for a, b in rows:
        if a and b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(rows, "w string, l string")
    got = circles.components(df, "w", "l").collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_folds_run_in_the_circles_of_the_data(spark):
    rows, df = _matches(spark, pools=5)
    found = circles.with_circle(df.drop("pool"))
    groups = found.select("circle").distinct().count()
    assert groups == 5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with StageTables(spark) as stages:
        before, state = ratings.elo_with_state(found, stages, pool=("circle",))
        assert {r.match_id: (r.elo_w, r.elo_l) for r in before.collect()} == _elo(rows)[0]
        assert state.select("circle").distinct().count() == groups
        assert len(before.inputFiles()) > 1  # one file a task
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_two_seasons_equal_one_run(spark):
    rows, df = _matches(spark)
    want, state = _elo(rows)
    with StageTables(spark) as stages:
        first, then = ratings.elo_with_state(df.where("match_id < 120"), stages, pool=("pool",))
        second, last = ratings.elo_with_state(df.where("match_id >= 120"), stages, pool=("pool",), initial_state=then)
        got = {r.match_id: (r.elo_w, r.elo_l) for r in first.unionByName(second).collect()}
        assert got == want
        assert {(r.pool, r.player): r.rating for r in last.collect()} == state
        _, alone = ratings.elo_with_state(df.where("match_id < 120").select("match_id", "match_date", "w", "l"), stages)
        assert {r.player: r.rating for r in alone.collect()} == {p: v for (_, p), v in _elo(rows[:120])[1].items()}
        none, empty = ratings.elo_with_state(df.where("false"), stages, pool=("pool",), initial_state=then)
        assert none.count() == 0 and empty.count() == then.count()


def test_boosted_trees_learn(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        a = rnd.gauss(0, 1)
        rows.append((i, ("train", "val", "test")[i // 200], int(rnd.random() < 1 / (1 + math.exp(-3 * a))), a if i % 10 else None, rnd.random(), None))
    df = spark.createDataFrame(rows, "match_id long, split string, y int, a double, noise double, empty double")
    fitted, scored = model.train_boosted(df, ("a", "noise", "empty"), trees=10)
    told = evaluate.prob_metrics(scored.where("split = 'test'"), "y", "p_raw").first()
    assert told.auc > 0.8 and told.logloss < 0.6 and scored.count() == 600
    top = model.importances(df, fitted, ("a", "noise", "empty")).orderBy(F.desc("importance")).collect()
    assert top[0].feature == "a" and [r.importance for r in top if r.feature == "empty"] == [0.0]


def test_linked_sides_are_cleaned_once(spark):
    results = spark.createDataFrame(
        [(1, "2024-01-01", "Ana Bel", "Cyd Dor", "Wien", "Hard", "F"), (2, "2024-01-01", "Eva Fox", "", "Wien", "Hard", "F")],
        "match_id long, date_tourney string, winner_name string, loser_name string, tourney_name string, surface string, round string",
    ).withColumn("date_tourney", F.to_date("date_tourney"))
    odds = spark.createDataFrame(
        [(7, "2024-01-03", "Bel A.", "Dor C.", "Vienna", "h", "Final", 1.5)],
        "right_id long, Date_dt string, Winner string, Loser string, Location string, Surface string, Round string, PSW double",
    ).withColumn("Date_dt", F.to_date("Date_dt"))
    found = workloads.linked(results, odds)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "translate(" not in plan and "regexp" not in plan  # both sides are read from their stage tables
    rows = {r.match_id: (r.td_right_id, r.stage, r.td_PSW, r.key_city_players) for r in found.collect()}
    assert rows == {1: (7, "strict", 1.5, "vienna_hard__a bel__c dor"), 2: (None, None, None, None)}
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"  # changed only while a stage table is written


def test_last_initials_of_short_and_many_tokens(spark):
    names = ["Bel A.", "Bel A.B.", "A B", "A B C", "A Bel", "Bel", "De La Bel A.", "B", "", "Bel  A", "X Bel A.-B."]
    told = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.last_initials_key(F.col("n")).alias("k")).collect()]
    assert told == ["a bel", "a bel", "a", "a", "a bel", "bel", "a de la bel", "b", "", "a bel", "a x bel"]


def test_first_trees_are_those_of_a_shorter_fit(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i % 7), float(i % 11), float((i * i) % 13), float((i % 7) + (i % 3) > 4)) for i in range(400)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features").transform(spark.createDataFrame(rows, "a double, b double, c double, _label double").coalesce(1)).cache()
    booster = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=6, maxDepth=2, seed=3, subsamplingRate=0.8)
    cut, short = model.first_trees(booster.fit(df), 2), booster.copy({booster.maxIter: 2}).fit(df)
    told = [[r.probability for r in m.transform(df).collect()] for m in (cut, short)]
    assert cut.getNumTrees == 2 and told[0] == told[1]
    names = ["a", "b", "c", "unused"]
    assert [r.feature for r in model.importances(df, cut, names).collect()] == names


def test_fit_reads_vectors_from_a_stage_table(spark, monkeypatch):
    """Every pass of the fit scans the written vectors of the train rows, which are deleted then."""
    from pyspark.ml.classification import GBTClassifier

    rows = [(i, ("train", "val")[i % 2], i % 3 % 2, float(i % 7) if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "match_id long, split string, y int, a double")
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: seen.append((data.columns, data.inputFiles(), data.count())) or fit(self, data))
    with StageTables(spark) as stages:
        base = stages.base
        model.train_boosted(df, ("a",), trees=2, stages=stages)
        (columns, files, n), = seen
        assert columns == ["_features", "_label"] and n == 100 and files and all("vectors-" in f for f in files)
        assert not [p for p in os.listdir(base.removeprefix("file://")) if p.startswith("vectors")]


def test_permuted_scores_and_predictions_are_written_once(spark, monkeypatch):
    """Metrics of permuted targets read the scores from a stage table; both jobs keep the fit's vectors among their own tables."""
    from pyspark.ml.classification import GBTClassifier

    rows = [(i, D(2019 + i % 3, 1, 1), ("train", "val", "test")[i % 3], i % 5 % 2, 0.5, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "match_id long, match_date date, split string, y int, p_book_A double, a double")
    read, fitted = [], []
    metrics, fit = evaluate.prob_metrics, GBTClassifier.fit
    monkeypatch.setattr(evaluate, "prob_metrics", lambda df, *a, **k: read.append(df.inputFiles()) or metrics(df, *a, **k))
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: fitted.append(data.inputFiles()) or fit(self, data))
    with StageTables(spark) as stages:
        assert workloads.permuted_refit(df, ("a",), stages, trees=2).first().n == 100
        _, calibrated = workloads._fitted(df, ("a",), stages, trees=2)
        assert model.predictions(calibrated).count() == 200
        own = stages.base.rsplit("/", 1)[1]
    assert len(read) == 1 and read[0] and all("/blind-" in f for f in read[0])
    assert len(fitted) == 2 and all(files and all(f"{own}/vectors-" in f for f in files) for files in fitted)


def test_medians_only_of_columns_with_nulls(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(dataset, "exact_medians", lambda df, cols: asked.append(list(cols)) or {c: 5.0 for c in cols})
    df = spark.createDataFrame([("train", 1.0, 2.0), ("val", 3.0, None)], "split string, a double, b double")
    assert [(r.a, r.b) for r in dataset.impute_train_median(df, ("a", "b")).orderBy("a").collect()] == [(1.0, 2.0), (3.0, 5.0)]
    assert asked == [["b"]]


def test_permuted_target_orders_ids_alone(spark):
    df = spark.range(100).select(F.col("id").alias("match_id"), (F.col("id") % 2).alias("y"), (F.col("id") * 3).alias("payload"))
    out = evaluate.permute_target(df, "y", "match_id", 5)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i in [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Window ")]:
        below = [x for x, d in zip(lines[i:], deep[i:]) if d >= deep[i]]
        assert not any("payload" in x for x in below[: 1 + next((k for k, d in enumerate(deep[i + 1 :]) if d <= deep[i]), len(below))])
    rows = out.collect()
    assert len(rows) == 100 and sum(r.y for r in rows) == 50 and all(r.payload == 3 * r.match_id for r in rows)


def test_feature_tasks_sort_so_many_rows_at_most(spark, monkeypatch):
    df = spark.range(90).select(
        F.col("id").alias("match_id"), F.expr("date'2024-01-01'").alias("match_date"), F.lit("p").alias("w"), F.lit("q").alias("l"), F.lit("hard").alias("surface"),
        F.lit(1).alias("level_ord"), F.lit(1).alias("round_ord"), F.lit(3).alias("best_of"), F.lit(1.5).alias("PSW"), F.lit(2.5).alias("PSL"), F.lit(1.0).alias("w_rank"), F.lit(2.0).alias("l_rank"),
    )
    monkeypatch.setattr(workloads, "_TASK_ROWS", 10)
    plan = workloads.feature_table(df, pool=("surface",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 4 and all(", 18), REPARTITION_BY_NUM" in x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x)
