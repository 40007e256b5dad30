import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from prematch.llm.substrings import COVERS, cover_for, remove_repeats

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [_WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(spark, rows, window):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, places string, sum long")
    out = remove_repeats(df, window=window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out), key=repr)


@pytest.mark.parametrize("period", list(COVERS))
def test_covers_have_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_production_cover():
    assert cover_for(35) == (21, COVERS[21], 15)


@pytest.mark.parametrize("window", [35, 14])
def test_equals_brute_force(spark, window):
    rnd = random.Random(window)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß"]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (window - 1, window, window + 1, 60, 150)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [rnd.choice(vocab) for _ in range(rnd.randrange(50))]
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                w += p[a : a + rnd.randrange(len(p) + 1)] if rnd.random() < 0.5 else p
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    same = "aa " * 100
    rows += [(100, None), (101, ""), (102, " "), (103, same), (None, "x " + rows[7][1]), (7, rows[9][1]), rows[5], rows[5]]
    assert _got(spark, rows, window) == brute(rows, window)


def _clash(long_, rnd):
    """Another text of the same crc32: words of 32 letters that flip the right bits."""
    want = zlib.crc32(long_.encode())
    head = " ".join(f"c{rnd.randrange(10**6)}" for _ in range(3)) + " "
    base = zlib.crc32(head.encode() + b"@" * 32)
    flips = []  # crc32 is affine: each letter's lowest bit adds its own difference
    for i in range(32):
        word = bytearray(b"@" * 32)
        word[i] ^= 1
        flips.append(zlib.crc32(head.encode() + bytes(word)) ^ base)
    rows, target = [(d, 1 << i) for i, d in enumerate(flips)], base ^ want
    pick = 0
    for bit in range(32):
        at = next((k for k, (d, _) in enumerate(rows) if d >> bit & 1), None)
        if at is None:
            continue
        d, m = rows.pop(at)
        rows = [(x ^ d, y ^ m) if x >> bit & 1 else (x, y) for x, y in rows]
        if target >> bit & 1:
            target, pick = target ^ d, pick ^ m
    if target:
        return None
    return head + "".join("A" if pick >> i & 1 else "@" for i in range(32))


@pytest.mark.parametrize("ids", [(None, None), (7, 7)])
def test_texts_of_one_checksum(spark, ids):
    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(40))
    long_ = " ".join(f"u{i}" for i in range(161)) + " " + passage
    short = next(s for s in (_clash(long_, rnd) for _ in range(99)) if s)
    assert zlib.crc32(short.encode()) == zlib.crc32(long_.encode()) and short != long_
    rows = [(ids[0], long_), (ids[1], short), (1, passage), (2, passage), (ids[0], long_ + " x"), (ids[0], passage), (ids[0], passage)]
    assert _got(spark, rows, 35) == brute(rows, 35)


def test_very_many_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(None, text)] * 300 + [(5, text)] * 300 + [(6, "w1 w2")]
    assert _got(spark, rows, 35) == brute(rows, 35)


def test_empty_table(spark):
    assert _got(spark, [], 35) == []


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(80_000))
    rows = [(1, text), (2, " ".join(str(i) for i in range(500, 600)))]
    assert _got(spark, rows, 35) == brute(rows, 35)
