import random
import re
from collections import Counter

import pytest

from prematch.llm._session import scoped
from prematch.llm.phrases import collocations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n int, w1 string, phrase string"


def brute(rows, least, top, max_n=4, inside=80):
    f, total = {}, Counter()
    for _, text, lang in rows:
        count = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, n in often.items():
            for k in range(2, len(q)):
                gone.update(s for i in range(len(q) - k + 1) if 100 * n >= inside * often[s := q[i : i + k]])
        best = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations(df, **how).collect()))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["the", "of", "The", "a\x01", "a", "é", "É", "\x00", "x y", "zz", "b", "c", "d"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randrange(40)):
            text += rnd.choice(["of the ", "the the ", "New\tYork City ", "one two three four five "]) if rnd.random() < 0.4 else rnd.choice(vocab)
            text += rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", ";", "!?"])
        rows.append((i, text, rnd.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, None, "en"), (1, "", None), (2, " . ", "fr"), (3, "one two " * 40, "fr")]


@pytest.mark.parametrize("most_codes", [1 << 21, 3, 0])
def test_equals_brute_force(spark, most_codes):
    rows = corpus(1, 150)
    want = brute(rows, 8, 40)
    assert len(want) > 45
    assert run(spark, rows, least=8, top=40, most_codes=most_codes) == want


@pytest.mark.parametrize("max_n, inside", [(2, 80), (3, 100), (5, 50)])
def test_other_lengths(spark, max_n, inside):
    rows = corpus(2, 80)
    assert run(spark, rows, least=5, top=10_000, max_n=max_n, inside=inside) == brute(rows, 5, 10_000, max_n, inside)


def test_hot_prefixes_go_over_many_partitions(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"hot {rnd.choice('abcdef')} {rnd.choice('gh')}" for _ in range(300)), "en") for i in range(20)]
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with scoped(spark, conf):
        assert run(spark, rows, least=10, top=500) == brute(rows, 10, 500)


def test_ties_go_by_phrase(spark):
    rows = [(i, "q a. q b. z a. z b. q a", "en") for i in range(10)]
    assert run(spark, rows, least=5, top=3) == brute(rows, 5, 3)


def test_a_very_long_text(spark):
    rows = [(1, " ".join(f"w{i % 700}" for i in range(200_000)), "en"), (2, "w1 w2 " * 50, "en")]
    assert run(spark, rows, least=30, top=50) == brute(rows, 30, 50)


def test_empty_table(spark):
    assert run(spark, []) == []
