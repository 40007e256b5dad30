import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from prematch.llm.lexical import impacts, search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id int, score string", "item_id long, text string, rank int, item string"


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, df = sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in docs:
            m = 75 + 25 * n * len(docs) // total
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1, "x") for r in items], ITEMS)
    return sorted(map(tuple, search(d, i, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß-x", "O'Neil", "_a_", "\x00z"]
    text = lambda n: " ".join(rnd.choice(vocab[: rnd.choice((5, 20, 65))]) for _ in range(n))
    docs = [(i * 3, text(rnd.choice((1, 5, 40, 200)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " .,!"), (None, docs[4][1]), (9, docs[4][1]), docs[7], docs[7], (503, "W1 w1 Àw1")]
    items = [(i, text(rnd.choice((1, 4, 30)))) for i in range(12)] + [(20, None), (21, ""), (22, "absent"), (None, "w1 W1 w2"), (3, "w1"), (3, "w2")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"item_terms": 40, "doc_bytes": 500}])
def test_equals_brute_force(spark, tables, how):
    docs, items = tables
    assert run(spark, docs, items, k=5, **how) == brute(docs, items, 5)


def test_ties_and_copies(spark):
    docs = [(i, "same words here") for i in range(70, 0, -1)] + [(200 + i, f"other {i}") for i in range(200)]
    got = run(spark, docs, [(1, "words")], k=20, doc_bytes=200)
    assert sorted((r[1], r[2]) for r in got) == [(i, i) for i in range(1, 21)]
    assert got == brute(docs, [(1, "words")], 20)


def test_a_very_long_text(spark):
    docs = [(1, " ".join(f"w{i % 5000}" for i in range(150_000))), (2, "w1 w2"), (3, "w7")]
    items = [(1, "w1 w2 w3"), (2, " ".join(f"w{i}" for i in range(3000)))]
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_wide_products():
    sizes = np.array([10**12], np.int64)
    got = impacts(np.array([5], np.int64), sizes, 10**9, 10**15)
    assert got.tolist() == [5 * 10**9 // (5000 + 12 * (75 + 25 * 10**6))]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []
