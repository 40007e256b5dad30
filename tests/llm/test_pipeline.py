"""The pipeline's stages against plain Python versions, each on the stage's own input."""

import hashlib
import os
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import test_minhash
import test_substrings
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from prematch.llm import queries
from prematch.llm._session import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
EXTRA = {"score": 1.5, "kept_text": "x", "lang_pred": "y", "length": 7, "component_id": 3}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(
        [(90001, None, "en", "src1", 0), (90002, "", None, None, 0), (90003, "12 34", "de", "src2", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    out = [docs.unionByName(odd).withColumns({k: F.lit(v) for k, v in EXTRA.items()})]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), name))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def _ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_all_but_the_last_keep_the_columns(stages):
    assert all(c == COLUMNS for c in stages[1][:-1])


def test_language_stage_rejects_texts_without_letters_only(stages):
    before, after = stages[0][:2]
    gone = set(_ids(before)) - set(_ids(after))
    assert {90001, 90002, 90003} <= gone
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in before if r["doc_id"] in gone)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][1:3]
    sets = {r["doc_id"]: test_minhash._set(r["text"]) for r in before}
    ids = sorted(sets)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert _ids(after) == [i for i in ids if find(i) == i]


def test_repeats_go(stages):
    before, after = stages[0][2:4]
    want = {d: (n, gone, sha) for d, n, gone, sha in test_substrings.brute([(r["doc_id"], r["text"]) for r in before], 35)}
    assert _ids(after) == sorted(d for d, (n, gone, _) in want.items() if not n or gone < n)
    text = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        _, gone, sha = want[r["doc_id"]]
        if gone:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == text[r["doc_id"]]


def _water(budget, children):
    """children: name -> (weight, capacity). Exact shares, before rounding."""
    share, open_ = {}, dict(children)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if Fraction(c, w) <= Fraction(budget) / weight}
        if not full:
            return share | {n: Fraction(budget) * w / weight for n, (w, c) in open_.items()}
        for n in full:
            share[n] = Fraction(open_.pop(n)[1])
            budget -= share[n]
    return share


def test_mix_follows_the_weights(stages):
    before, after = stages[0][3:5]
    tokens = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    leaf = {r["doc_id"]: (f"d{int(r['source'][3:]) % queries.MIX_DOMAINS}", r["lang"], r["source"]) for r in before}
    total = sum(tokens.values())
    budget = total * corpus_pipeline.MIX_SHARE[0] // corpus_pipeline.MIX_SHARE[1]
    cap = lambda *at: sum(n for d, n in tokens.items() if leaf[d][: len(at)] == at)
    weight = lambda level, n: queries.MIX_WEIGHTS.get(level, {}).get(n, 1)
    want = {}
    for d, b in _water(budget, {x[0]: (weight("domain", x[0]), cap(x[0])) for x in leaf.values()}).items():
        for lang, b2 in _water(b, {x[1]: (weight("lang", x[1]), cap(*x[:2])) for x in leaf.values() if x[0] == d}).items():
            for s, b3 in _water(b2, {x[2]: (1, cap(*x)) for x in leaf.values() if x[:2] == (d, lang)}).items():
                want[d, lang, s] = b3
    kept = set(_ids(after))
    for at, b in want.items():
        order = lambda d: int(hashlib.md5(f"{queries.MIX_SEED}:0:{d}".encode()).hexdigest()[:15], 16)
        have = sum(tokens[d] for d in kept if leaf[d] == at)
        last = [d for d in sorted((d for d in kept if leaf[d] == at), key=order)][-1:]
        assert have >= b - 3 and (not last or have - tokens[last[0]] < b + 3)
        if b < cap(*at):
            ranked = sorted((d for d in tokens if leaf[d] == at and tokens[d]), key=order)
            assert [d in kept for d in ranked] == sorted((d in kept for d in ranked), reverse=True)


def test_packing_places_every_token(stages):
    before, after = stages[0][4:6]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = {}
    for r in after:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(got) == _ids(before)
    for r in before:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(got[r["doc_id"]])
        assert sum(p[2] for p in parts) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in parts)
    lengths = {}
    for r in after:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= 1024


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_run(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0


def _prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))


def _odd_ids(spark):
    """Null ids, one id with two texts, equal rows."""
    near = _prose(1) + " " + _prose(2, 1)
    rows = [
        (None, _prose(3)), (None, _prose(4)), (None, _prose(4)), (None, None), (None, "  "), (None, _prose(1)),
        (5, near), (7, near), (7, _prose(5)), (7, _prose(6)), (7, _prose(6)), (9, _prose(7)),
    ]
    return spark.createDataFrame([(d, t, "en", "src1", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies_by_row_not_by_id(spark):
    got = _pairs(corpus_pipeline.minhash_near_dedup(spark, _odd_ids(spark), DATA))
    near = _prose(1) + " " + _prose(2, 1)
    want = [
        (None, _prose(3)), (None, _prose(4)), (None, None), (None, "  "), (5, near), (7, _prose(5)), (7, _prose(6)), (9, _prose(7)),
    ]
    assert got == sorted(want, key=str)


def test_repeats_by_row_not_by_id(spark):
    shared = _prose(8, 40)
    rows = [
        (None, f"{shared} {_prose(11, 3)}"), (None, f"{_prose(12, 3)}  {shared}"), (None, "a  b"), (None, None), (None, shared),
        (7, f"{_prose(13, 3)} {shared}"), (7, "c  d"), (7, "c  d"),
    ]
    docs = spark.createDataFrame([(t, d, len(t or "")) for d, t in rows], "text string, doc_id long, n_chars long")
    out = corpus_pipeline.substring_dedup(spark, docs, DATA)
    want = [(None, _prose(11, 3)), (None, _prose(12, 3)), (None, "a  b"), (None, None), (7, _prose(13, 3)), (7, "c  d"), (7, "c  d")]
    assert out.columns == docs.columns and _pairs(out) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_language_stage_rejects_unlearned_languages_short_and_long(spark):
    """Foreign texts of both scripts go at any length that tells; clean short ones stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    russian = "Рано утром старый рыбак спускался в порт с сетью на плечах и смотрел на море под облаками, оно было серым."
    italian = "La mattina il vecchio pescatore scendeva verso il porto con la rete sulle spalle e guardava il mare che cambiava colore sotto le nuvole. "
    finnish = "Varhain aamulla vanha kalastaja laskeutui satamaan verkko olkapaillaan ja katseli merta, joka vaihtoi variaan pilvien alla. "
    foreign = [russian[:99], russian * 4, italian * 4, finnish * 4]
    long = max((r.text or "" for r in docs.where("lang = 'en'").collect()), key=len)
    clean = [" ".join(long.split()[:n]) for n in (2, 5, 20, 100)]
    planted = [(800000 + i, t) for i, t in enumerate(foreign)] + [(900000 + i, t) for i, t in enumerate(clean)]
    rows = spark.createDataFrame([(d, t, None, "src1", len(t)) for d, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language_id(spark, docs.unionByName(rows, allowMissingColumns=True), DATA)
    assert [d for d in _ids(r.asDict() for r in out.collect()) if d >= 800000] == [900000 + i for i in range(len(clean))]


def test_mix_reaches_the_targets_to_the_word(spark):
    """Domains of equal size, null and repeated ids: token shares are the weights', cut documents included."""
    rows = []
    for k in range(480):
        d = None if k % 5 == 0 else k // 2
        lang = ("en", "de", "fr", "es")[k // 4 % 4]
        rows.append((d, f" {k}\n" + " ".join(f"w{i}" for i in range(29)), lang, f"src{k % 4}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    total = 480 * 30 * corpus_pipeline.MIX_SHARE[0] // corpus_pipeline.MIX_SHARE[1]
    for k, w in enumerate((4, 3, 2, 1)):
        assert abs(sum(len(r.text.split()) for r in out if r.source == f"src{k}") - total * w / 10) <= 1
    texts = {r[1] for r in rows}
    part = [r for r in out if r.text not in texts]
    assert len(part) <= 16 and all(r.n_chars == len(r.text) for r in part)
    assert all(any(" ".join(t.split()).startswith(r.text + " ") for t in texts) for r in part)
    assert len({r.text.split()[0] for r in out}) == len(out)


def _edges(spark):
    """Nulls everywhere, empty and very long texts, equal rows, ties, and columns named like the operators' own."""
    long = " ".join(f"{_prose(10_000 + i, 40)}," for i in range(4000))
    texts = [None, "", " \n", "one", "12 !", _prose(1), _prose(1), long, long + " tail", _prose(2, 900), _prose(3), "é" * 40_000]
    rows = [(None if i % 4 == 0 else i // 2, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else "src2", None) for i, t in enumerate(texts)]
    names = ("score", "salt", "band", "key", "fp", "place", "rank", "length", "n_words", "kept", "domain", "component_id", "doc_ID2", "t", "v")
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit(None).cast("int") if i % 2 else F.lit("x") for i, n in enumerate(names)})


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = _edges(spark)
    out = stage(spark, docs, DATA)
    got = out.collect()
    before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    after = _pairs(out) if name != "best_fit_packing" else None
    if name == "language_id":
        # Texts without a letter go, and what is learned from these few texts rejects no other.
        assert after == [r for r in before if any(c.isalpha() for c in r[1] or "")]
    elif name == "minhash_near_dedup":
        gone = [t for _, t in before]
        for _, t in after:
            gone.remove(t)
        assert sorted(t[:60] for t in gone) == sorted([_prose(1)[:60]] * 3 + [_prose(10_000, 40)[:60]])
    elif name == "substring_dedup":
        assert {t for _, t in after} == {t for _, t in before if t is None or len(t) < 60 or t == _prose(3) or "é" in t or t == _prose(2, 900)} | {"tail"}
    elif name == "mix_sources":
        words = lambda rows: sum(len((t or "").split()) for _, t in rows)
        assert words(after) == words(before) // 3 and out.columns == docs.columns
    else:
        assert {r.doc_id for r in got} == {d for d, _ in before} and sum(r.length for r in got if r.doc_id == 0) >= 1
    if name != "best_fit_packing":
        assert out.schema.names == docs.schema.names


def test_stages_on_an_empty_table(spark):
    docs = _edges(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
