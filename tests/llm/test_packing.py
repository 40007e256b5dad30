import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prematch.llm.packing import pack, supersteps, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\x85", "\x1c", "a", "b.", "1", "!", "'s", "'ll", "é", "ß", " \n", "\r\n", "日本", "x y", "**", "ª", "Ⅷ", "\u3000", "\U0001f600", "\u0301", "<|endoftext|>", "<|end", "\x00"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tok):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14))) for _ in range(5000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x2000, 0x3000), rnd.randrange(0x20, 0x7F)])) for _ in range(40)) for _ in range(500)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [list(token_ids(t, PATH)) for t in texts] == want


def test_ids_of_very_long_texts_equal_the_tokenizers(tok):
    rnd = random.Random(5)
    for words in (["wort", "Straße,", "the", "of \n", "<|endoftext|>"], ["no-blank", "\n"], ["a" * 3000]):
        text = (" " if words[0] == "wort" else "").join(rnd.choice(words) for _ in range(400_000 // len(words[0])))
        assert list(token_ids(text, PATH)) == tok.encode(text, add_special_tokens=False).ids


def _best_fit_decreasing(sizes, capacity):
    bins: list[int] = []
    for x in sorted(sizes, reverse=True):
        fits = [b for b, gap in enumerate(bins) if gap >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


@pytest.mark.parametrize("capacity, ranges", [(8, 8), (64, 4), (1024, 4), (1024, 1)])
def test_supersteps_pack_like_best_fit(spark, capacity, ranges):
    rnd = random.Random(capacity)
    for most in (capacity, capacity // 4):
        sizes = [rnd.randrange(1, most + 1) for _ in range(rnd.randrange(100, 400))]
        placed: dict[int, list] = {}
        ranks: dict[int, list] = {}
        counts = spark.createDataFrame(list(Counter(sizes).items()), "length int, n long")
        for length, low, per, n, first, at in supersteps(counts, capacity, ranges).collect():
            ranks.setdefault(length, []).extend(range(low, low + n * per))
            for i in range(n):
                placed.setdefault(first + i, []).extend((at + j * length, length) for j in range(per))
        assert len(placed) <= 1.01 * _best_fit_decreasing(sizes, capacity) + 1
        for row in placed.values():
            end = 0
            for at, length in sorted(row):
                assert at == end
                end += length
            assert end <= capacity
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(sizes.count(x))) for x in sizes}


def test_every_id_is_placed_once(spark, tok):
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice(["wort", "Straße", "the", "of,"]) for _ in range(rnd.randrange(120)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "lang " * 400), (103, "a<|endoftext|> b"), (None, "no id"), docs[3], docs[3]]
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, length long, salt string")
    rows = pack(df, PATH, capacity=64).collect()
    want = []
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for row in by.values():
        end = 0
        for at, n in sorted(row):
            assert at == end
            end += n
        assert end <= 64
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 64 + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
