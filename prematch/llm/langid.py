"""Language identification by bit-sliced Bloom filters of byte n-grams.

One filter holds all languages: a slot is a bitmask with one bit for each
language, so the AND of an n-gram's slots gives every language that contains
it. A text's n-grams are counted for each language, counts are corrected for
the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._words import text_chunks

_GRAM = 4
_PIECE = 1 << 18
_HASHES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_FOLD[~_LETTER & (_FOLD == np.arange(256))] = 32
UNDETERMINED = "und"


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts as 32-bit numbers, and the n-gram offsets of each text.

    Bytes are lower-cased, all but letters become blanks. n-grams with more
    than one blank, or across two texts, are left out.
    """
    n = len(buf) - _GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    x = _FOLD[buf]
    blank = (x == 32).astype(np.uint8)
    v = x[:n].astype(np.uint32)
    blanks = blank[:n].copy()
    for i in range(1, _GRAM):
        v |= x[i : n + i].astype(np.uint32) << np.uint32(8 * i)
        blanks += blank[i : n + i]
    good = blanks <= 1
    for border in offs[1:-1]:
        good[max(0, border - _GRAM + 1) : border] = False
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(good, dtype=np.int64)])
    return v[good], at[np.minimum(offs, n)]


def _blocks(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts; one long text comes in pieces that overlap by an n-gram, so memory does not follow its length."""
    if len(offs) > 2 or len(buf) <= _PIECE:
        yield buf, offs
        return
    for a in range(0, max(1, len(buf) - _GRAM + 1), _PIECE):
        piece = buf[a : a + _PIECE + _GRAM - 1]
        yield piece, np.array([0, len(piece)])


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # [slot, word of up to 64 languages]
    false_positive: np.ndarray  # of each language

    def masks(self, grams: np.ndarray, word: int) -> np.ndarray:
        shift = np.uint32(32 - (len(self.slots).bit_length() - 1))
        column = self.slots[:, word]
        out = None
        for c in _HASHES:
            h = grams * np.uint32(c)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            got = column[h >> shift]
            out = got if out is None else out & got
        return out

    def shares(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's n-grams in each language, and the n-grams' number."""
        n, hits = np.zeros(len(offs) - 1, np.int64), np.zeros((len(offs) - 1, len(self.languages)))
        for piece, cuts in _blocks(buf, offs):
            grams, at = _grams(piece, cuts)
            n += np.diff(at)
            for i in range(len(self.languages)):
                if i % 64 == 0:
                    masks = self.masks(grams, i // 64)
                bit = (masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(bit, dtype=np.int64)])
                hits[:, i] += total[at[1:]] - total[at[:-1]]
        fp = self.false_positive
        return np.maximum(0, (hits / np.maximum(n, 1)[:, None] - fp) / (1 - fp)), n


def _filter(languages: list[str], rows: list[tuple[int, int]], fill: float) -> LanguageFilter:
    """rows: (language, n-gram)."""
    per = max([1, *np.bincount([i for i, _ in rows], minlength=1)])
    slots = 1 << max(10, int(np.ceil(np.log2(len(_HASHES) * per / fill))))
    bits = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.iinfo(t).bits), np.uint64)
    out = LanguageFilter(
        languages, np.zeros((slots, max(1, -(-len(languages) // 64))), bits), np.zeros(len(languages))
    )
    shift = np.uint32(32 - (slots.bit_length() - 1))
    for i in range(len(languages)):
        grams = np.array([g for j, g in rows if j == i], np.uint32)
        for c in _HASHES:
            h = grams * np.uint32(c)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.slots[h >> shift, i // 64] |= bits(1 << (i % 64))
        full = ((out.slots[:, i // 64] >> bits(i % 64)) & bits(1)).mean()
        out.false_positive[i] = min(0.99, full ** len(_HASHES))
    return out


def train(
    labelled: DataFrame,
    *,
    per_language: int = 500,
    min_share: float = 0.02,
    fill: float = 0.2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageFilter:
    """Learn from at most ``per_language`` texts of each language, those of the smallest hash of their id and text.

    An n-gram belongs to a language if at least ``min_share`` of its sampled
    texts contain it, so a language's set is bounded by the texts' mean number
    of distinct n-grams over ``min_share``, whatever the corpus's size.
    """
    spot = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11)
    rows = labelled.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), spot.alias("spot")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return _filter([], [], fill)
    by_lang = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])[F.col("lang")]
    # Three times as many as are wanted lie below this bound, so only they are ranked, not a language's whole rows.
    low = rows.where(F.col("spot") < by_lang({k: int(min(1.0, 3 * per_language / n) * 2.0**53) for k, n in totals.items()}))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    cuts = low.select("lang", "spot").distinct().withColumn("k", place).where(F.col("k") <= per_language)
    cuts = {r.lang: (r.spot, r.n) for r in cuts.groupBy("lang").agg(F.max("spot").alias("spot"), F.count("*").alias("n")).collect()}
    sizes = {k: n for k, (_, n) in cuts.items()}
    sample = rows.where(F.col("lang").isin(list(sizes)) & (F.col("spot") <= by_lang({k: c for k, (c, _) in cuts.items()})))
    sample = sample.dropDuplicates(["lang", "spot"])

    def grams(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, buf, offs in text_chunks(batch.column("text")):
                if hi - lo == 1:
                    parts = [np.unique(np.concatenate([np.unique(_grams(*piece)[0]) for piece in _blocks(buf, offs)]))]
                else:
                    g, at = _grams(buf, offs)
                    parts = [np.unique(g[at[i] : at[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for i, p in enumerate(parts) for x in [langs[lo + i]] * len(p)], pa.string()),
                        pa.array(np.concatenate(parts).astype(np.int64)),
                    ],
                    ["lang", "gram"],
                )

    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    found = sample.select("lang", "text").mapInArrow(grams, "lang string, gram long")
    found = found.groupBy("lang", "gram").count()
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, max(1.0, min_share * sizes[k]))])
    found = found.where(F.col("count") >= least[F.col("lang")])
    at = {k: i for i, k in enumerate(languages)}
    return _filter(languages, [(at[r.lang], r.gram) for r in found.select("lang", "gram").collect()], fill)


def judged(text: Column, model: LanguageFilter) -> Column:
    """A struct ``(lang_pred, score, coverage, n_grams)`` for each text; only texts travel to Python, other columns stay.

    See :func:`predict` for the values.
    """
    names = model.languages

    @F.arrow_udf("lang_pred string, score double, coverage double, n_grams long")
    def judge(texts: pa.Array, letters: pa.Array) -> pa.Array:
        n = len(texts)
        ok = np.asarray(letters.to_pylist(), bool)
        best, score, cover, grams = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for lo, hi, buf, offs in text_chunks(texts) if names else ():
            shares, grams[lo:hi] = model.shares(buf, offs)
            best[lo:hi] = np.where(ok[lo:hi], shares.argmax(1), -1)
            top = np.where(ok[lo:hi], shares.max(1), 0)
            score[lo:hi], cover[lo:hi] = top / np.maximum(shares.sum(1), 1e-12), top
        said = pa.array([names[i] if i >= 0 else UNDETERMINED for i in best], pa.string())
        return pa.StructArray.from_arrays([said, pa.array(score), pa.array(cover), pa.array(grams)], ["lang_pred", "score", "coverage", "n_grams"])

    text = text.cast("string")
    # Non-deterministic for the optimiser: a filter on its result is not pushed below it, which would run it twice.
    return judge.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def predict(
    docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """``(doc_id, .., lang_pred, score, coverage)`` for each row.

    ``score`` is the winner's part of all languages' shares (0 to 1),
    ``coverage`` the winner's share of the text's n-grams. Texts that are null
    or have no letter are ``und`` with score 0; texts with letters but without
    a known n-gram get the first language with score 0. Ties go to the
    language with more training texts, then by name. Without any training
    text all is ``und``. Whole texts count, however long; ids may be null or
    repeat; other columns are ignored. ``keep`` passes further columns.
    """
    said = judged(F.col(text_col), model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in (keep or {}).items()], said.alias("_said"))
    return rows.select("doc_id", *(keep or {}), "_said.lang_pred", "_said.score", "_said.coverage")


def least_coverage(
    held_out: DataFrame,
    model: LanguageFilter,
    n_grams: Column,
    *,
    quantile: float = 0.01,
    margin: float = 2 / 3,
    pool: int = 300,
    least_grams: int = 32,
    text_col: str = "text",
    lang_col: str = "lang",
) -> Column:
    """The least coverage of a text in a learned language, by ``n_grams``; learned from texts the model has not seen.

    The held-out texts that get their own label are pooled by octaves of their
    n-grams' number, from the longest down, at least ``pool`` texts a pool; a
    pool's rate is a low quantile of its coverages, and no pool is stricter
    than a longer one. Fewer than ``pool`` texts in all lower the rate in
    proportion to the quantile's relative error. ``margin`` of the rate is
    asked for, so rare texts in a learned language (lists, capitals, mixed
    languages) stay. A text's bound is that less the same quantile of a binomial share: a byte takes part in as many
    n-grams as they have bytes, so only so many are independent. So bounds
    widen as texts get shorter, down to none. Without held-out texts it is 0.
    """
    said = held_out.select(F.col(lang_col).alias("said"), judged(F.col(text_col), model).alias("j")).select("said", "j.*")
    said = said.where((F.col("said") == F.col("lang_pred")) & (F.col("n_grams") >= least_grams))
    steps = 200
    found = said.groupBy(F.floor(F.log2("n_grams")).alias("octave"), F.floor(F.col("coverage") * steps).alias("c")).count().collect()
    by = {}
    for r in found:
        by.setdefault(r.octave, np.zeros(steps + 1, np.int64))[min(r.c, steps)] += r["count"]
    rates, hist, rate = {}, np.zeros(steps + 1, np.int64), 1.0
    total = sum(int(h.sum()) for h in by.values())
    pool = min(pool, total)
    for octave in sorted(by, reverse=True):
        hist = hist + by[octave]
        if hist.sum() >= pool:
            low = int(np.searchsorted(np.cumsum(hist), quantile * hist.sum(), "right")) / steps
            rate = min(rate, margin * low * (1 - 1 / np.sqrt(hist.sum())))
            hist = np.zeros(steps + 1, np.int64)
        rates[octave] = rate
    if not rates:
        return F.lit(0.0)
    # Octaves before the first full pool, longer than any of it, share its rate; shorter ones have the last rate.
    full = [rates[o] for o in sorted(rates, reverse=True) if rates[o] < 1]
    z = NormalDist().inv_cdf(1 - quantile)
    here = F.lit(float(min(rates.values())))
    for octave in sorted(rates):
        r = rates[octave] if rates[octave] < 1 or not full else full[0]
        here = F.when(n_grams >= F.lit(2**octave), F.lit(float(r))).otherwise(here)
    return F.greatest(F.lit(0.0), here - z * F.sqrt(here * (1 - here) * _GRAM / F.greatest(n_grams, F.lit(1))))
