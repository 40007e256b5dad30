"""Cleaning of names and dates, and the keys built from them. Built-in expressions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon


def _folded_letters() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letter under each; other scripts stay as they are."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked + list("øØłŁđĐ")), "".join(plain + list("oOlLdD"))


_MARKED, _PLAIN = _folded_letters()
_PAIRS = {"ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th"}
_TRAILING_INITIALS = r"((?:(?:^| )\S)+)$"
#: Marks and white space that count as a blank.
_BLANKS = " \t\n\x0b\f\r.,'\"()-–&/"
#: Texts that cleaning only lowers: ASCII letters and digits with single blanks between, or nothing.
_WORDS = r"\A(?:[A-Za-z0-9]++(?: [A-Za-z0-9]++)*+)?\z"


def clean_text(c: Column) -> Column:
    """ASCII letters where Latin has marks, lower case, marks like ``.,'-/`` as blanks, single blanks; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    folded = c
    for letter, pair in _PAIRS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    # Letters with marks take more than one byte.
    ascii_ = F.octet_length(c) == F.char_length(c)
    blank = " " * len(_BLANKS)
    # Most texts are plain words already: a regular expression tells, which costs less than to translate.
    plain = F.lower(c)
    marked = F.when(ascii_, F.translate(c, _BLANKS, blank)).otherwise(F.translate(folded, _MARKED + _BLANKS, _PLAIN + blank))
    return F.when(c.rlike(_WORDS), plain).otherwise(F.trim(F.regexp_replace(F.lower(marked), "  +", " ")))


def lookup(c: Column, mapping: Mapping[str, object], default: Column) -> Column:
    """``mapping[c]``, or ``default``."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), default)


def with_clean(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds ``out: clean_text(source)`` for each pair, in one projection that later ones refer to.

    Keys refer to a cleaned text several times. The optimiser does not repeat
    an expression that costs something in such a place, so each source column
    is cleaned once a row.
    """
    return df.withColumns({out: clean_text(F.col(c)) for out, c in columns.items()})


def settled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; filters and joins on ``columns`` take their values and do not repeat how they are computed.

    They come out of a generator of one row, which the optimiser does not push
    filters through.
    """
    others = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*columns))).alias("_settled")
    return df.select(*others, one).select(*others, *[F.col(f"_settled.{c}") for c in columns])


def _mapped(cleaned: Column, mapping: Mapping[str, str], upper_miss: bool = False) -> Column:
    return lookup(cleaned, mapping, F.upper(cleaned) if upper_miss else cleaned)


def canonical_map(c: Column, mapping: Mapping[str, str] = lexicon.SURFACES, upper_miss: bool = False) -> Column:
    """The cleaned text's entry; without one the cleaned text, in upper case if asked."""
    return _mapped(clean_text(c), mapping, upper_miss)


def canonical_round(c: Column, mapping: Mapping[str, str] = lexicon.ROUNDS) -> Column:
    return canonical_map(c, mapping, upper_miss=True)


def alias_city(c: Column, aliases: Mapping[str, str] = lexicon.CITY_ALIASES) -> Column:
    return canonical_map(c, aliases)


def _place(city: Column, surface: Column) -> Column:
    return F.btrim(F.concat(city, F.lit("_"), surface), F.lit("_"))


def place_surface_key(city: Column, surface: Column) -> Column:
    """``city_surface`` of canonical names, without underscores at the ends."""
    return _place(alias_city(city), canonical_map(surface))


def _first_initial(cleaned: Column, single_token: str) -> Column:
    blank = F.instr(cleaned, " ")
    others = F.when(blank > 0, cleaned.substr(blank + 1, F.char_length(cleaned))).otherwise("")
    initial = F.trim(F.concat(F.substring(cleaned, 1, 1), F.lit(" "), others))
    if single_token == "initial":
        return initial
    if single_token != "name":
        raise ValueError("single_token is 'initial' or 'name'")
    return F.when(F.instr(cleaned, " ") > 0, initial).otherwise(
        F.trim(F.concat(F.substring(cleaned, 1, 1), F.lit(" "), cleaned))
    )


def initial_last(c: Column, single_token: str = "initial") -> Column:
    """``First Last`` to ``f last``; of one token the initial alone, or with the token (``single_token='name'``)."""
    return _first_initial(clean_text(c), single_token)


def player_names(players: DataFrame) -> DataFrame:
    """``(full, key)``: cleaned full names of ``players(name_first, name_last)`` and their keys.

    One row a full name; of names that clean to the same the largest key stays.
    Rows without a last name go.
    """
    known = with_clean(players, {"_first": "name_first", "_last": "name_last"}).where("_last <> ''")
    full = F.trim(F.concat("_first", F.lit(" "), "_last"))
    key = F.trim(F.concat(F.substring("_first", 1, 1), F.lit(" "), "_last"))
    return known.groupBy(full.alias("full")).agg(F.max(key).alias("key"))


def initial_last_key(
    df: DataFrame, name: str, out: str, players: DataFrame | None = None, single_token: str = "initial", names: DataFrame | None = None
) -> DataFrame:
    """Adds ``out``: the key of a full name, from ``players(name_first, name_last)`` if it is there, else by the first token.

    ``names``: :func:`player_names` of the players, where several columns use them.
    """
    df = with_clean(df, {"_name": name})
    rule = _first_initial(F.col("_name"), single_token)
    if players is None and names is None:
        return df.withColumn(out, rule).drop("_name")
    known = (player_names(players) if names is None else names).select(F.col("full").alias("_full"), F.col("key").alias("_key"))
    joined = df.join(known, F.col("_name") == F.col("_full"), "left")
    return joined.withColumn(out, F.coalesce("_key", rule)).drop("_full", "_key", "_name")


def _last_initials(s: Column) -> Column:
    # One initial after a longer token is the usual case; the regular expression finds several, or a name of initials alone.
    length = F.char_length(s)
    one = (length >= 4) & (F.substring(s, -4, 1) != " ")
    initials = F.regexp_extract(s, _TRAILING_INITIALS, 1)
    last = s.substr(F.lit(1), length - F.char_length(initials))
    return (
        F.when(F.instr(s, " ") == 0, s)
        .when(F.substring(s, -2, 1) != " ", _first_initial(s, "initial"))
        .when(one, F.concat(F.substring(s, -1, 1), F.lit(" "), s.substr(F.lit(1), length - 2)))
        .otherwise(F.trim(F.concat(F.substring(F.trim(initials), 1, 1), F.lit(" "), last)))
    )


def last_initials_key(c: Column) -> Column:
    """``Last F.M.`` to ``f last``: one-letter tokens at the end are initials, the first of them counts."""
    return _last_initials(clean_text(c))


def last_initials_keys(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds ``out: last_initials_key(source)`` for each pair; each source is cleaned once."""
    df = with_clean(df, {f"_{out}": c for out, c in columns.items()})
    df = df.withColumns({out: _last_initials(F.col(f"_{out}")) for out in columns})
    return df.drop(*[f"_{out}" for out in columns])


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a); null if a side is blank, so blank names link with nothing."""
    return F.when((a != "") & (b != ""), F.concat_ws("__", F.least(a, b), F.greatest(a, b)))


def link_keys(df: DataFrame, city: str, surface: str, round_: str, a: str, b: str) -> DataFrame:
    """Adds ``tkey_city, city_key, rnd_canon, players_sorted`` and the four composite keys of a source row.

    ``a`` and ``b`` are columns of player keys. Joins use the parts; the
    composite strings are for export and null where a player is blank.
    """
    df = with_clean(df, {"_city": city, "_surface": surface, "_round": round_})
    df = df.withColumns(
        {
            "city_key": _mapped(F.col("_city"), lexicon.CITY_ALIASES),
            "_surface": _mapped(F.col("_surface"), lexicon.SURFACES),
            "rnd_canon": _mapped(F.col("_round"), lexicon.ROUNDS, upper_miss=True),
            "players_sorted": pair_key(F.col(a), F.col(b)),
        }
    )
    df = df.withColumn("tkey_city", _place(F.col("city_key"), F.col("_surface"))).drop("_city", "_surface", "_round")
    return composite_keys(settled(df, (a, b, "tkey_city", "city_key", "rnd_canon", "players_sorted")))


COMPOSITE_KEYS = {
    "key_city_players": ("tkey_city", "players_sorted"),
    "key_city_round_players": ("tkey_city", "rnd_canon", "players_sorted"),
    "key_cityonly_players": ("city_key", "players_sorted"),
    "key_cityonly_round_players": ("city_key", "rnd_canon", "players_sorted"),
}


def composite_keys(df: DataFrame) -> DataFrame:
    """Adds the four composite keys made of the parts that :func:`link_keys` adds."""
    join = lambda parts: F.concat(*[x for p in parts for x in (F.lit("__"), F.col(p))][1:])
    return df.withColumns({name: join(parts) for name, parts in COMPOSITE_KEYS.items()})


def parse_date_multi(c: Column, formats: Sequence[str] = ("yyyyMMdd", "dd/MM/yyyy", "MM/dd/yyyy")) -> Column:
    """ISO first, then each format; null if none fits."""
    c = F.trim(c.cast("string"))
    iso = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring_index(F.substring_index(c, " ", 1), "T", 1), "yyyy-M-d"))
    return F.coalesce(iso, *[F.try_to_date(c, f) for f in formats])


def coalesce_choice(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def ordinal_encode(c: Column, mapping: Mapping[str, int] = lexicon.ROUND_ORDER, default: int = 0) -> Column:
    return lookup(c, mapping, F.lit(default))


def one_hot(df: DataFrame, c: str, values: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column for each value; null is 0 everywhere."""
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in values})


def numeric_default(c: Column, kind: str = "int", default: float = 3) -> Column:
    """The number that a text or number says, cut to ``kind`` (5.0, "5.0" and " 5 " are 5); else the default."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x).try_cast(kind), F.lit(default).cast(kind))


def _named(names: Sequence[Column]) -> Column:
    return F.coalesce(*[F.when(n != "", n) for n in names], F.lit(""))


def _level(series: Column, code: Column, name: Column) -> Column:
    by_series = by_name = F.lit(None).cast("string")
    for part, level in reversed(lexicon.LEVEL_SERIES):
        by_series = F.when(series.contains(part), F.lit(level)).otherwise(by_series)
    for part, level in reversed(lexicon.LEVEL_NAMES):
        by_name = F.when(name.contains(part), F.lit(level)).otherwise(by_name)
    by_code = F.when(code != "", lookup(F.upper(code), lexicon.LEVEL_CODES, F.upper(code)))
    return F.coalesce(by_series, by_code, by_name, F.lit(lexicon.LEVEL_DEFAULT))


def infer_level(series: Column, code: Column, names: Sequence[Column]) -> Column:
    """Level by series text, else by code, else by the first name given, else the default."""
    return _level(clean_text(series), code, clean_text(_named(names)))


def with_level(df: DataFrame, out: str, series: Column, code: Column, names: Sequence[Column]) -> DataFrame:
    """Adds ``out``: :func:`infer_level`, with each text cleaned once a row."""
    df = df.withColumns({"_series": clean_text(series), "_code": code, "_name": clean_text(_named(names))})
    return df.withColumn(out, _level(F.col("_series"), F.col("_code"), F.col("_name"))).drop("_series", "_code", "_name")


def with_canonical(df: DataFrame, columns: Mapping[str, tuple[Column, Mapping[str, str], bool]]) -> DataFrame:
    """Adds ``out: canonical_map(source, mapping, upper_miss)`` for each entry, with each text cleaned once a row."""
    df = df.withColumns({f"_{out}": clean_text(c) for out, (c, _, _) in columns.items()})
    df = df.withColumns({out: _mapped(F.col(f"_{out}"), mapping, upper) for out, (_, mapping, upper) in columns.items()})
    return df.drop(*[f"_{out}" for out in columns])
