"""Phrase collocations by suffix sorting (the Suffix-sigma method of Berberich and Bedathur, 2013).

Every word position gives one suffix of at most ``max_n`` words. Suffixes are
added up in their task, shuffled by ranges of language and first word, sorted
in reverse lexicographic order, and one pass with a stack of open prefixes
counts all phrases of all lengths; the parts of a phrase are joined afterwards.
A very frequent first word, pair or triple is cut between ranges by the words
that follow it; only prefixes open at a range's ends have to be added up. As in
the paper, suffixes end before words that are too rare to be in any phrase.

Words travel as numbers: the most frequent ones as short codes, all others as
62-bit hashes of language and word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import discard, written
from ._words import byte_set, mix64, text_chunks, word_hashes, words

BLANKS = byte_set((0x09, 0x09), (0x20, 0x20))
BREAKS = byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
UNKNOWN = "und"
#: Most words with a short code, and suffixes that a task sorts at once.
MOST_CODES, CHUNK = 1 << 21, 1 << 20
_HASHED = np.int64(1 << 62)
_TEXT_BYTES = 4 << 20


def _language(name: str | None) -> np.uint64:
    return np.frombuffer(hashlib.blake2b((name or UNKNOWN).encode(), digest_size=8).digest(), np.uint64)[0]


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For some MB of texts: bytes, word starts and ends, number of the piece of each word, its text's row, 62-bit hash with the language."""
    langs = batch.column("lang").dictionary_encode()
    salts = np.array([_language(x) for x in langs.dictionary.to_pylist()] + [_language(None)], np.uint64)
    lang = langs.indices.fill_null(len(salts) - 1).to_numpy()
    for lo, hi, buf, offs in text_chunks(batch.column("text"), _TEXT_BYTES):
        starts, ends, woffs = words(buf, offs, BLANKS | BREAKS)
        row = np.repeat(np.arange(lo, hi), np.diff(woffs))
        piece = np.cumsum(BREAKS[buf], dtype=np.int64)[starts] if len(starts) else starts
        with np.errstate(over="ignore"):
            h = mix64(word_hashes(buf, starts, ends, lower=True) + salts[lang[row]])
        yield buf, starts, ends, piece, row, (h >> np.uint64(2)).view(np.int64) | _HASHED


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, word, hash, n)``; a row without a word holds a language's occurrences of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, starts, ends, _, row, h in _tokens(batch):
                found, at, n = np.unique(h, return_index=True, return_counts=True)
                lang = batch.column("lang").take(pa.array(row[at]))
                raw = buf.tobytes()
                text = [raw[a:b].lower() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                names = ["lang", "word", "hash", "n"]
                yield pa.RecordBatch.from_arrays([lang, pa.array(text, pa.binary()).cast(pa.string()), pa.array(found), pa.array(n)], names)
                each = pa.RecordBatch.from_arrays([lang, pa.array(n)], ["lang", "n"])
                each = pa.Table.from_batches([each]).group_by("lang").aggregate([("n", "sum")]).combine_chunks()
                none = [pa.nulls(len(each), t) for t in (pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*_flat(each["lang"]), *none, *_flat(each["n_sum"])], names)

    found = rows.mapInArrow(count, "lang string, word string, hash long, n long")
    return found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _flat(column: pa.ChunkedArray) -> list[pa.Array]:
    return [column.combine_chunks()]


def _frequent(known: DataFrame, most: int) -> tuple[np.ndarray, bool]:
    """Hashes, in order, of the most frequent words, at most ``most``; and whether these are all of ``known``.

    The bound on the count comes from the numbers of words by the power of two of their counts.
    """
    by = known.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()
    least, total = 0, 0
    for r in sorted(by, key=lambda r: -r.p):
        total += r.k
        if total > most:
            least = 2 ** (r.p + 1)
            break
    told = known.where(F.col("n") >= least).select("hash").toArrow()
    return np.sort(told["hash"].to_numpy()), least == 0


def _codes(h: np.ndarray, frequent: np.ndarray, all_: bool) -> np.ndarray:
    """A frequent word's place from 1; of others 0 (too rare, so no part of a phrase) or, where not all are known, the hash."""
    if not len(frequent):
        return np.zeros(len(h), np.int64) if all_ else h
    at = np.searchsorted(frequent, h)
    at[at == len(frequent)] = 0
    return np.where(frequent[at] == h, at + 1, 0 if all_ else h)


def _suffixes(rows: DataFrame, frequent: np.ndarray, all_: bool, max_n: int) -> DataFrame:
    """``(w1 .., n)``: suffixes of at least two words with their counts in a task's chunk."""
    names = [f"w{k + 1}" for k in range(max_n)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            w = np.concatenate(held, axis=1)
            held.clear()
            w = w[:, np.lexsort(w[::-1])]
            first = np.flatnonzero(np.append(True, (w[:, 1:] != w[:, :-1]).any(axis=0)))
            n = np.diff(np.append(first, w.shape[1])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*w[:, first], n)], [*names, "n"])

        size = 0
        for batch in batches:
            for _, _, _, piece, row, h in _tokens(batch):
                w = np.zeros((max_n, len(h)), np.int64)
                w[0] = _codes(h, frequent, all_)
                near = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
                for k in range(1, max_n):
                    w[k, :-1] = np.where(near, w[k - 1, 1:], 0)
                    w[k, w[k - 1] == 0] = 0
                w = w[:, w[1] != 0]  # one word alone is counted already
                if w.shape[1]:
                    held.append(w)
                    size += w.shape[1]
                if size >= CHUNK:
                    yield added()
                    size = 0
        if held:
            yield added()

    return rows.mapInArrow(cut, ", ".join(f"{c} long" for c in names) + ", n long")


def _prefixes(suffixes: DataFrame, max_n: int, least: int) -> DataFrame:
    """``(w1 .., n)``: counts of all prefixes of at least two words of sorted suffixes, each partition on its own.

    One stack holds the occurrences of the open prefixes, longest on top; a row
    that leaves a prefix closes it and all longer ones. A batch of sorted rows
    does this at once for each length: prefixes that open and close in it are
    runs of rows, the one open at its end stays on the stack. A closed prefix
    is complete, and dropped below ``least``, unless it is the first or the
    last of its partition: those go on in the neighbouring ones.
    """
    names = [f"w{k + 1}" for k in range(max_n)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stack = np.zeros((max_n, 1), np.int64), np.zeros(max_n, np.int64)
        runs = [0] * max_n  # closed so far; the first is that of no words, before all rows

        def closed(k: int, w: np.ndarray, n: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            good = (w[k] != 0) & ((n >= least) | edge)
            w = np.where(np.arange(max_n)[:, None] <= k, w[:, good], 0)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*w, n[good])], [*names, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            w, n = np.stack([batch.column(c).to_numpy() for c in names]), batch.column("n").to_numpy()
            left = np.logical_or.accumulate(w != np.concatenate([last, w[:, :-1]], axis=1), axis=0)
            for k in range(max_n - 1, 0, -1):
                first = np.flatnonzero(left[k])
                if not len(first):
                    stack[k] += n.sum()
                    continue
                new = np.add.reduceat(n, first)
                done = np.append(stack[k] + n[: first[0]].sum(), new[:-1])
                yield closed(k, np.concatenate([last, w[:, first[:-1]]], axis=1), done, runs[k] + np.arange(len(done)) <= 1)
                runs[k] += len(done)
                stack[k] = new[-1]
            last = w[:, -1:]
        for k in range(max_n - 1, 0, -1):
            yield closed(k, last, stack[k : k + 1], np.ones(1, bool))

    return suffixes.mapInArrow(count, ", ".join(f"{c} long" for c in names) + ", n long")


def _slice(names: list[str], start: int, length: int) -> list[Column]:
    return [(F.col(names[start + i]) if i < length else F.lit(0).cast("long")).alias(c) for i, c in enumerate(names)]


def _not_inside(phrases: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Phrases that no longer phrase holds with at least ``percent`` % of their occurrences; one shuffle."""
    max_n, parts = len(names), []
    for length in range(2, max_n):
        for start in range(max_n - length + 1):
            there = F.col(names[start + length] if start == 0 else names[start + length - 1]) != 0
            parts.append(F.when(there, F.struct(*_slice(names, start, length))))
    longer = phrases.select(F.explode(F.array_compact(F.array(*parts))).alias("part"), "n") if parts else phrases.where("false").select(
        F.struct(*names).alias("part"), "n"
    )
    both = phrases.select(*names, F.col("n").alias("a"), F.lit(None).cast("long").alias("longer")).unionByName(
        longer.select("part.*", F.lit(None).cast("long").alias("a"), F.col("n").alias("longer"))
    )
    found = both.groupBy(*names).agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    wide = [F.col(c).cast("decimal(20,0)") for c in ("longer", "a")]
    return found.where(F.col("a").isNotNull() & (F.col("longer").isNull() | (100 * wide[0] < percent * wide[1]))).drop("longer")


def _cuts(phrases: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """``(w1 .., a, l, r, score)`` at each phrase's lowest-scoring cut, ties to the smallest number of words before it."""
    max_n, parts = len(names), []
    for k in range(1, max_n):
        for side, (start, length) in enumerate(((0, k), (k, max_n - k))):
            part = F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.struct(*_slice(names, start, length)).alias("part"))
            parts.append(F.when(F.col(names[k]) != 0, part))
    each = phrases.select(*names, "a", F.explode(F.array_compact(F.array(*parts))).alias("e"))
    each = each.select(*names, "a", "e.k", "e.side", *[F.col(f"e.part.{c}").alias(f"p{c}") for c in names])
    of = counts.select(*[F.col(c).alias(f"p{c}") for c in names], F.col("n").alias("f"))
    sides = {f"f{k}_{s}": F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))) for k in range(1, max_n) for s in (0, 1)}
    found = each.join(of, [f"p{c}" for c in names]).groupBy(*names, "a").agg(*[c.alias(x) for x, c in sides.items()])
    scores = [
        F.when(
            F.col(names[k]) != 0,
            F.struct(
                F.expr(f"(2000000 * cast(a AS decimal(20,0))) div (cast(f{k}_0 AS decimal(20,0)) + f{k}_1)").alias("score"),
                F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"),
            ),
        )
        for k in range(1, max_n)
    ]
    return found.select(*names, "a", F.array_min(F.array_compact(F.array(*scores))).alias("s")).select(*names, "a", "s.l", "s.r", "s.score")


def collocations(
    docs: DataFrame,
    *,
    max_n: int = 4,
    least: int = 30,
    inside: int = 80,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    most_codes: int = MOST_CODES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``max_n`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends
    and into words at blanks and tabs; phrases lie in one piece. ``a`` counts a
    phrase's occurrences, overlaps included, ``n`` all words of its language.
    Phrases of at least ``least`` occurrences are candidates; a candidate inside
    a longer one with ``inside`` % of its occurrences or more goes. A cut into
    two parts of ``l`` and ``r`` occurrences scores floor(2000000 a / (l + r)),
    in decimals; the lowest-scoring cut counts. Order: score, then ``a``, both
    descending, then the phrase.

    Null and empty texts have no words; a null language is ``und``, one with
    documents of that name. Repeated rows count each time, other columns are
    ignored, an empty table gives no rows. Words are told apart by 62-bit
    hashes. At most ``most_codes`` words pass through the driver, as numbers;
    beyond them the words' hashes travel and rare words are not left out early.
    """
    names = [f"w{k + 1}" for k in range(max_n)]
    rows = _rows(docs, text_col, lang_col)
    counted = written(word_counts(rows).where((F.col("n") >= least) | F.col("hash").isNull()), "words")
    total, known = counted.where("hash IS NULL").select("lang", "n"), counted.where("hash IS NOT NULL")
    frequent, all_ = _frequent(known, most_codes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = pa.array(_codes(b.column("hash").to_numpy(), frequent, all_))
            yield pa.RecordBatch.from_arrays([code, *(b.column(c) for c in ("lang", "word", "n"))], ["code", "lang", "word", "f"])

    known = written(known.mapInArrow(coded, "code long, lang string, word string, f long"), "coded")
    suffixes = written(_suffixes(rows, frequent, all_, max_n), "suffixes")  # range bounds are found in a first reading
    order = [F.desc(c) for c in names]
    sorted_ = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    phrases = written(_prefixes(sorted_, max_n, least).groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    discard(suffixes)

    single = known.select(F.col("code").alias(names[0]), *[F.lit(0).cast("long").alias(c) for c in names[1:]], F.col("f").alias("n"))
    scored = _cuts(_not_inside(phrases, names, inside), phrases.unionByName(single), names)
    first = known.select(F.col("code").alias(names[0]), "lang")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = written(scored.join(first, names[0]).withColumn("k", F.rank().over(by)).where(F.col("k") <= top).drop("k"), "best")
    discard(phrases)
    word = best.select(*names, F.posexplode(F.array_compact(F.array(*[F.when(F.col(c) != 0, F.col(c)) for c in names]))).alias("at", "code"))
    text = word.join(known.select("code", "word"), "code").groupBy(*names).agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase")
    )
    ranked = best.join(text, names).join(total, "lang").withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(docs: str = "documents", max_n: int = 4, least: int = 30, inside: int = 80, top: int = 2000) -> str:
    """DuckDB SQL for the rows of :func:`collocations`."""
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    grams = "\n    UNION ALL ".join(
        f"SELECT lang, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})"
        for k in range(1, max_n + 1)
    )
    return f"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM {docs} WHERE text IS NOT NULL)
), f AS MATERIALIZED (
    SELECT lang, p, count(*) AS n FROM (
    {grams})
    GROUP BY ALL
), total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang
), often AS MATERIALIZED (SELECT * FROM f WHERE n >= {least}
), parts AS MATERIALIZED (
    SELECT DISTINCT lang, n, p[i:i + k - 1] AS p
    FROM (SELECT *, unnest(range(2, len(p) - i + 2)) AS k FROM (SELECT *, unnest(range(1, len(p))) AS i FROM often WHERE len(p) > 2))
    WHERE k < len(p)
), inner_ AS MATERIALIZED (
    SELECT lang, p, max(n) AS longer FROM parts GROUP BY ALL
), cut AS (
    SELECT c.lang, c.p, c.n AS a, k, l.n AS l, r.n AS r, ((2000000::HUGEINT * c.n) // (l.n + r.n))::BIGINT AS score
    FROM (
        SELECT o.*, unnest(range(1, len(o.p))) AS k FROM often o LEFT JOIN inner_ i ON i.lang = o.lang AND i.p = o.p
        WHERE len(o.p) > 1 AND (i.p IS NULL OR 100::HUGEINT * i.longer < {inside}::HUGEINT * o.n)
    ) c
    JOIN often l ON l.lang = c.lang AND l.p = c.p[:k] JOIN often r ON r.lang = c.lang AND r.p = c.p[k + 1:]
), lowest AS (
    SELECT *, array_to_string(p, ' ') AS phrase FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN total USING (lang) QUALIFY rank <= {top}"""
