import pytest
from pyspark.sql import functions as F

from prematch.functions import text

# Names as results list them, and the keys that belong to them.
GOLDEN = [
    ("Brisbane", "Hard", "R32", "Rafael Nadal", "Alexandr Dolgopolov", "brisbane_hard", "brisbane", "r nadal", "a dolgopolov"),
    ("Brisbane", "Hard", "F", "Grigor Dimitrov", "Kei Nishikori", "brisbane_hard", "brisbane", "g dimitrov", "k nishikori"),
    ("Australian Open", "Hard", "QF", "Jo-Wilfried Tsonga", "Stan Wawrinka", "melbourne_hard", "melbourne", "j tsonga", "s wawrinka"),
]


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("  São Paulo ", "sao paulo"), ("St. Petersburg", "st petersburg"), ("Queen's  Club", "queen s club"), ("Straße–Æon/ß", "strasse aeon ss"), ("(O'Neil) & \"Łódź\"", "o neil lodz")],
)
def test_clean_text(spark, raw, want):
    assert _one(spark, raw, text.clean_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Nadal R.", "r nadal"), ("Del Potro J.M.", "j del potro"), ("Nadal", "nadal"), ("A. B.", "a"), ("Rafael Nadal", "r nadal"), ("", ""), ("Tsonga J.W.", "j tsonga"), (None, "")],
)
def test_last_initials_key(spark, raw, want):
    assert _one(spark, raw, text.last_initials_key) == want


@pytest.mark.parametrize(("mode", "want"), [("initial", "n"), ("name", "n nadal")])
def test_single_token(spark, mode, want):
    assert _one(spark, "Nadal", lambda c: text.initial_last(c, mode)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2017-01-02", "2017-01-02"), ("20170102", "2017-01-02"), ("05/01/2017", "2017-01-05"), ("01/25/2017", "2017-01-25"), ("2017-01-02 10:00:00", "2017-01-02"), ("x", None), (None, None)],
)
def test_dates(spark, raw, want):
    got = _one(spark, raw, text.parse_date_multi)
    assert (None if got is None else str(got)) == want


def test_level(spark):
    rows = [("Masters 1000", "g", "US Open", "M1000"), ("", "g", "x", "GS"), (None, None, "US Open", "GS"), ("odd", "", "Houston", "ATP250"), ("", "z", "", "Z")]
    df = spark.createDataFrame(rows, "s string, c string, n string, want string")
    got = df.select("want", text.infer_level(F.col("s"), F.col("c"), [F.col("n")]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def _keys(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, r string, w string, l string")
    players = spark.createDataFrame([("Jo-Wilfried", "Tsonga"), (None, None), ("", "Cher")], "name_first string, name_last string")
    df = text.initial_last_key(text.initial_last_key(df, "w", "w_key", players), "l", "l_key", players)
    return text.link_keys(df, "t", "s", "r", "w_key", "l_key").orderBy("i").collect()


def test_golden_keys(spark):
    for want, got in zip(GOLDEN, _keys(spark, [g[:5] for g in GOLDEN])):
        assert (got.tkey_city, got.city_key, got.w_key, got.l_key) == want[5:]
        pair = "__".join(sorted(want[7:]))
        assert got.players_sorted == pair
        assert got.key_city_round_players == f"{want[5]}__{want[2]}__{pair}"


# Fixed values, which the keys must equal: place, surface, round | winner | loser | city | pair of keys.
KNOWN = """
Brisbane Hard R32 | Rafael Nadal | Alexandr Dolgopolov | brisbane | a dolgopolov__r nadal
Brisbane Hard F | Grigor Dimitrov | Kei Nishikori | brisbane | g dimitrov__k nishikori
Chennai Hard R16 | Albert Ramos | Steve Darcis | chennai | a ramos__s darcis
Chennai Hard QF | Dudi Sela | Albert Ramos | chennai | a ramos__d sela
Chennai Hard F | Roberto Bautista Agut | Daniil Medvedev | chennai | d medvedev__r bautista agut
Doha Hard R32 | Jo-Wilfried Tsonga | Andrey Kuznetsov | doha | a kuznetsov__j tsonga
Doha Hard F | Novak Djokovic | Andy Murray | doha | a murray__n djokovic
Auckland Hard R32 | Joao Sousa | Albert Ramos | auckland | a ramos__j sousa
Auckland Hard F | Jack Sock | Joao Sousa | auckland | j sock__j sousa
Sydney Hard SF | Daniel Evans | Andrey Kuznetsov | sydney | a kuznetsov__d evans
Sydney Hard R32 | Gilles Muller | Alexandr Dolgopolov | sydney | a dolgopolov__g muller
Sydney Hard R32 | Andrey Kuznetsov | Martin Klizan | sydney | a kuznetsov__m klizan
Sydney Hard R32 | Gastao Elias | Christopher Oconnell | sydney | c oconnell__g elias
Sydney Hard R16 | Andrey Kuznetsov | Alex De Minaur | sydney | a de minaur__a kuznetsov
Sydney Hard QF | Andrey Kuznetsov | Pablo Carreno Busta | sydney | a kuznetsov__p carreno busta
Sydney Hard F | Gilles Muller | Daniel Evans | sydney | d evans__g muller
Australian Open Hard R128 | Lukas Lacko | Albert Ramos | melbourne | a ramos__l lacko
Australian Open Hard R128 | Kei Nishikori | Andrey Kuznetsov | melbourne | a kuznetsov__k nishikori
Australian Open Hard R128 | Victor Estrella | Aljaz Bedene | melbourne | a bedene__v estrella
Australian Open Hard R128 | Alexandr Dolgopolov | Borna Coric | melbourne | a dolgopolov__b coric
Australian Open Hard R128 | Grigor Dimitrov | Christopher Oconnell | melbourne | c oconnell__g dimitrov
Australian Open Hard R64 | Bernard Tomic | Victor Estrella | melbourne | b tomic__v estrella
Australian Open Hard R64 | Gael Monfils | Alexandr Dolgopolov | melbourne | a dolgopolov__g monfils
Australian Open Hard R16 | Mischa Zverev | Andy Murray | melbourne | a murray__m zverev
Australian Open Hard R16 | Roger Federer | Kei Nishikori | melbourne | k nishikori__r federer
Australian Open Hard R16 | Stan Wawrinka | Andreas Seppi | melbourne | a seppi__s wawrinka
Australian Open Hard R16 | Jo-Wilfried Tsonga | Daniel Evans | melbourne | d evans__j tsonga
Australian Open Hard R16 | Rafael Nadal | Gael Monfils | melbourne | g monfils__r nadal
Australian Open Hard R16 | Milos Raonic | Roberto Bautista Agut | melbourne | m raonic__r bautista agut
Australian Open Hard R16 | David Goffin | Dominic Thiem | melbourne | d goffin__d thiem
"""


def test_known_keys(spark):
    rows = [[x.strip() for x in line.split("|")] for line in KNOWN.strip().splitlines()]
    for (where, _, _, city, pair), got in zip(rows, _keys(spark, [(*r[0].rsplit(" ", 2), r[1], r[2]) for r in rows])):
        assert (got.tkey_city, got.city_key, got.players_sorted) == (f"{city}_hard", city, pair)
        assert got.key_cityonly_round_players == f"{city}__{where.split()[-1]}__{pair}"


def test_blank_names_have_no_pair(spark):
    got = _keys(spark, [("Rome", "Clay", "F", "", "Novak Djokovic"), ("Rome", "Clay", "F", None, None), ("Rome", "Clay", "F", " . ", "x y")])
    assert [(r.players_sorted, r.key_city_players) for r in got] == [(None, None)] * 3


@pytest.mark.parametrize(("raw", "want"), [("5", 5), ("5.0", 5), (" 5 ", 5), ("five", 3), ("", 3), (None, 3), ("nan", 3), ("1e99", 3)])
def test_numeric_default(spark, raw, want):
    assert _one(spark, raw, text.numeric_default) == want


def test_numeric_default_of_numbers(spark):
    df = spark.createDataFrame([(5.0, 3), (None, None), (float("nan"), 5)], "d double, i int")
    got = df.select(text.numeric_default(F.col("d")).alias("d"), text.numeric_default(F.col("i")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(5, 3), (3, 3), (3, 5)]


def test_plain_words_take_the_short_way(spark):
    # What needs no translation is only lowered; line ends, outer and double blanks still go, and no text passes a lambda.
    rows = ["", "Abc", "US Open 2", " Abc", "Abc ", "Abc\n", "A  b", "A\tB", "a-b", "é", "İ", "a" * 300 + "  B", "½ x", "x　y"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c string").select("i", text.clean_text(F.col("c")).alias("x"))
    want = ["", "abc", "us open 2", "abc", "abc", "abc", "a b", "a b", "a b", "e", "i", "a" * 300 + " b", "½ x", "x　y"]
    assert [r.x for r in df.orderBy("i").collect()] == want
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
