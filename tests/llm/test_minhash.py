import random
import re

import pytest

from prematch.llm.minhash import near_duplicates

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _set(text):
    w = _WORD.findall(_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [(_set(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if d is not None and low.get(r) is None else min(low[r], d) if d is not None else low.get(r)
    return sorted(
        ((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr
    )


def _rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(200)] + ["É", "ß", "THE", "the"]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 40, 120, 300]))]
        for _ in range(6):
            w = list(words)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows), " \t\n".replace("\t", rnd.choice("\t\x0b ")).join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    return rows


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_a_bucket_of_different_documents_is_settled(spark):
    """With one row a band nearly all documents meet in one bucket; no link is lost, with long bands or without."""
    rnd = random.Random(8)
    rows = []
    for base in range(30):
        words = [f"b{base}-{i}" for i in range(60)]
        for k in range(3):
            w = ["same"] * 40 + words
            w[60 + k] = f"changed{k}"
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for bands, coordinates in ((60, 480), (60, 60)):
        got = sorted(map(tuple, near_duplicates(df, bands=bands, rows=1, coordinates=coordinates).collect()), key=repr)
        assert got == want


def test_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x y z"), (3, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, band int, fp string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 1, None, True), (3, 0, 3, True)], key=repr
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_very_long_text(spark, n):
    text = " ".join(f"t{i % 7919}" for i in range(60_000))
    df = spark.createDataFrame([(i, text + f" x{i}") for i in range(n)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df).collect()} == {0}
