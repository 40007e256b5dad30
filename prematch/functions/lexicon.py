"""Lookup tables for place, surface, round and level names."""

# Names of places as sources spell them, after cleaning, and the place they mean.
CITY_ALIASES = {
    "paris bercy": "paris",
    "bercy": "paris",
    "roland garros": "paris",
    "miami gardens": "miami",
    "roma": "rome",
    "abn amro": "rotterdam",
    "qatar": "doha",
    "dubai duty free": "dubai",
    "mexico": "acapulco",
    "citi open": "washington",
    "moselle": "metz",
    "st petersburg": "saint petersburg",
    "kitzbuhel": "kitzbuehel",
    "s hertogenbosch": "den bosch",
    "hertogenbosch": "den bosch",
    "antwerpen": "antwerp",
    "rio": "rio de janeiro",
    "wien": "vienna",
    "londres": "london",
    "australian open": "melbourne",
    "wimbledon": "london",
    "us open": "new york",
    "indian wells masters": "indian wells",
    "miami masters": "miami",
    "rome masters": "rome",
    "madrid masters": "madrid",
    "cincinnati masters": "cincinnati",
    "paris masters": "paris",
    "monte carlo masters": "monte carlo",
    "queen s club": "london",
    "queens club": "london",
    "shanghai masters": "shanghai",
    "great ocean road open": "melbourne",
    "adelaide 1": "adelaide",
    "nur sultan": "astana",
}

# Surfaces after cleaning.
SURFACES = {
    "hard": "hard",
    "h": "hard",
    "i hard": "hard",
    "indoor hard": "hard",
    "clay": "clay",
    "c": "clay",
    "red clay": "clay",
    "grass": "grass",
    "g": "grass",
    "carpet": "carpet",
    "i carpet": "carpet",
    "indoor carpet": "carpet",
}

# Rounds after cleaning; other names are taken in upper case.
ROUNDS = {
    "first round": "R64",
    "1st round": "R64",
    "second round": "R32",
    "2nd round": "R32",
    "third round": "R16",
    "3rd round": "R16",
    "round of 64": "R64",
    "round of 32": "R32",
    "round of 16": "R16",
    "quarterfinal": "QF",
    "quarterfinals": "QF",
    "semifinal": "SF",
    "semifinals": "SF",
    "final": "F",
    "finals": "F",
}
MAIN_ROUNDS = ("R128", "R64", "R32", "R16", "QF", "SF", "F")
ROUND_ORDER = {name: i for i, name in enumerate(MAIN_ROUNDS, 1)}

# Levels by series text, by code, by name, and their order.
LEVEL_SERIES = (
    ("grand slam", "GS"),
    ("masters", "M1000"),
    ("1000", "M1000"),
    ("500", "ATP500"),
    ("250", "ATP250"),
    ("olymp", "Olympics"),
    ("davis", "Davis"),
)
LEVEL_CODES = {"G": "GS", "M": "M1000", "A": "ATP500", "B": "ATP250", "D": "Davis", "O": "Olympics", "F": "Finals"}
LEVEL_NAMES = (
    ("australian open", "GS"),
    ("roland garros", "GS"),
    ("french open", "GS"),
    ("wimbledon", "GS"),
    ("us open", "GS"),
    ("indian wells", "M1000"),
    ("miami", "M1000"),
    ("monte carlo", "M1000"),
    ("madrid", "M1000"),
    ("rome", "M1000"),
    ("canada", "M1000"),
    ("cincinnati", "M1000"),
    ("shanghai", "M1000"),
    ("paris", "M1000"),
    ("olymp", "Olympics"),
    ("davis", "Davis"),
)
LEVEL_DEFAULT = "ATP250"
LEVEL_ORDER = {"ATP250": 1, "ATP500": 2, "M1000": 3, "GS": 4, "Davis": 3, "Olympics": 3, "Finals": 3}

# Columns that a source may spell in other ways (case and outer blanks aside).
ODDS_COLUMNS = {
    "date": "Date",
    "tournament": "Tournament",
    "tourney": "Tournament",
    "event": "Tournament",
    "surface": "Surface",
    "round": "Round",
    "rnd": "Round",
    "winner": "Winner",
    "player 1": "Winner",
    "p1": "Winner",
    "loser": "Loser",
    "player 2": "Loser",
    "p2": "Loser",
    "location": "Location",
}
