"""Ranked lexical search as a blocked sparse matrix product.

The items' matrix holds each term's multiplicity, the documents' matrix the
integer impact of each term in each document. Documents come in blocks (some
MB of text), kept as compressed rows by term; a task multiplies a block of
items with its blocks of documents, item by item: the rows of the item's terms,
scaled, are merged into one int64 accumulator (Gustavson). What a task keeps
between blocks is each item's best ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import discard, written
from ._words import byte_set, text_chunks, word_hashes, words

#: ASCII bytes that are neither letters nor digits (terms are what lies between).
GAPS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Most terms of a block of items (one longer item is a block of its own), and bytes of a block of documents.
ITEM_TERMS, DOC_BYTES = 1 << 18, 4 << 20
#: A task's best are merged in so many groups an item first.
_SALTS = 16
_POSTINGS = "ids array<long>, sizes array<long>, n_terms long, terms array<int>, starts array<int>, docs array<int>, counts array<int>"


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, terms, counts)`` of items that have a term; ``item`` numbers the rows."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch.column("text")):
                starts, ends, woffs = words(buf, offs, GAPS)
                h = word_hashes(buf, starts, ends, lower=True).view(np.int64)
                found = [np.unique(h[a:b], return_counts=True) for a, b in zip(woffs[:-1], woffs[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").slice(lo, hi - lo),
                        pa.array([t for t, _ in found], pa.list_(pa.int64())),
                        pa.array([c for _, c in found], pa.list_(pa.int64())),
                    ],
                    ["item_id", "terms", "counts"],
                )

    split_ = rows.mapInArrow(split, "item_id long, terms array<long>, counts array<long>").where("size(terms) > 0")
    return split_.withColumn("item", F.monotonically_increasing_id())


def _row(values: np.ndarray | pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays([0, len(values)], values if isinstance(values, pa.Array) else pa.array(values))


def _postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray, doc_bytes: int) -> DataFrame:
    """Blocks of documents in order of id (null last), as compressed rows by term of the vocabulary."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch.column("text"), doc_bytes):
                starts, ends, woffs = words(buf, offs, GAPS)
                sizes = np.diff(woffs)
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                ids = batch.column("id").slice(lo, hi - lo)
                order = some[np.lexsort((ids.fill_null(0).to_numpy()[some], ids.is_null().to_numpy(False)[some]))]
                place = np.zeros(hi - lo, np.int64)
                place[order] = np.arange(len(order))
                h = word_hashes(buf, starts, ends, lower=True).view(np.int64)
                term = np.searchsorted(vocabulary, h)
                term[term == len(vocabulary)] = 0
                known = vocabulary[term] == h
                doc = np.repeat(place, sizes)
                cell, n = np.unique(term[known] * len(order) + doc[known], return_counts=True)
                terms, first = np.unique(cell // len(order), return_index=True)
                cells = [x.astype(np.int32) for x in (terms, np.append(first, len(cell)), cell % len(order), n)]
                yield pa.RecordBatch.from_arrays(
                    [_row(ids.take(pa.array(order))), _row(sizes[order]), pa.array([len(h)], pa.int64()), *map(_row, cells)],
                    ["ids", "sizes", "n_terms", "terms", "starts", "docs", "counts"],
                )

    return rows.mapInArrow(block, _POSTINGS)


def _frequencies(postings: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of ``n`` terms is; tasks add up their blocks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                total[terms.values.to_numpy()] += np.diff(starts.values.to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = postings.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n, np.int64)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return df


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L."""
    if len(sizes) and 25 * int(sizes.max()) * n_docs >= 1 << 63:
        m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in sizes])
    else:
        m = 75 + 25 * sizes * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest positive scores; of equal ones the first."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        found = scores[at]
        last = np.partition(found, len(at) - k)[len(at) - k]
        above = at[found > last]
        at = np.concatenate([above, at[found == last][: k - len(above)]])
    return at


def _scored(postings: DataFrame, rows: dict, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: of each task, the best ``k`` documents of each item of the block."""
    starts, terms, counts = rows["starts"], rows["at"], rows["counts"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(starts) - 1
        best = [np.zeros((3, 0), np.int64)] * n  # score, whether the id is null, id
        for batch in batches:
            for b in range(batch.num_rows):
                ids, sizes, have, first, docs, tf = (
                    batch.column(c)[b].values for c in ("ids", "sizes", "terms", "starts", "docs", "counts")
                )
                null = ids.is_null().to_numpy(False).astype(np.int64)
                ids, sizes, have, first, docs, tf = ids.fill_null(0).to_numpy(), *(x.to_numpy() for x in (sizes, have, first, docs, tf))
                impact = impacts(tf.astype(np.int64), sizes[docs], n_docs, n_terms)
                row = np.full(len(weights), -1, np.int64)
                row[have] = np.arange(len(have))
                for i in range(n):
                    total = np.zeros(len(ids), np.int64)
                    for t, c in zip(terms[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]):
                        if (r := row[t]) >= 0 and (w := c * weights[t]):
                            part = slice(first[r], first[r + 1])
                            total[docs[part]] += w * impact[part]
                    old = best[i]
                    if old.shape[1] == k:
                        total[total < old[0, -1]] = 0
                    at = _best(total, k)
                    if len(at):
                        new = np.concatenate([old, np.stack([total[at], null[at], ids[at]])], axis=1)
                        best[i] = new[:, np.lexsort((new[2], new[1], -new[0]))[:k]]
        for lo in range(0, n, 1024):
            found = best[lo : lo + 1024]
            each = np.repeat(np.arange(lo, lo + len(found)), [x.shape[1] for x in found])
            score, null, ids = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["item"][each]), rows["item_id"].take(pa.array(each)), pa.array(ids, mask=null.astype(bool)), pa.array(score)],
                ["item", "item_id", "doc_id", "score"],
            )

    return postings.select("ids", "sizes", "terms", "starts", "docs", "counts").mapInArrow(
        multiply, "item long, item_id long, doc_id long, score long"
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_terms: int = ITEM_TERMS,
    doc_bytes: int = DOC_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0, equal scores by smaller id.

    Terms are runs of ASCII letters and digits and all bytes beyond ASCII, with
    A-Z lower-cased. A document's score sums, over the item's terms with their
    repeats, the term's weight floor(1000 ln((2N+2)/(2df+1))) times its impact;
    all but the logarithm is 64-bit integers. Terms are told apart by 64-bit
    hashes. Items come in blocks of at most ``item_terms`` distinct terms; only
    one block's terms and frequencies pass through the driver at a time, and
    for each block the documents are read once and their matching postings
    written to the shared folder.

    Texts that are null, empty or without terms: such a document is no part of
    N and is never found, such an item has no rows. Null ids come after all
    others; repeated ids are documents of their own, repeated items too. Other
    columns are ignored. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    known = written(_item_terms(items, item_col, item_text_col), "items")
    total = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total * 2 // item_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = []
    for b in range(blocks if total else 0):
        told = known.where(block == b).orderBy("item").toArrow()
        if not told.num_rows:
            continue
        terms = told["terms"].combine_chunks()
        vocabulary, at = np.unique(terms.values.to_numpy(), return_inverse=True)
        rows = {
            "item": told["item"].to_numpy(),
            "item_id": told["item_id"].combine_chunks(),
            "starts": terms.offsets.to_numpy(),
            "at": at,
            "counts": told["counts"].combine_chunks().values.to_numpy(),
        }
        postings = written(_postings(docs, id_col, text_col, vocabulary, doc_bytes), "postings")
        n_docs, n_terms = postings.agg(F.sum(F.size("ids")), F.sum("n_terms")).first()
        if n_docs:
            df = _frequencies(postings, len(vocabulary))
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            found.append(written(_scored(postings, rows, weights, n_docs, n_terms, k), "best"))
        discard(postings)
    best = reduce(DataFrame.unionAll, found, spark.createDataFrame([], "item long, item_id long, doc_id long, score long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "salt"], ["item"]):
        if keys[-1] == "salt":
            best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def search_sql(docs: str = "documents", items: str = "benchmark", k: int = 20) -> str:
    """DuckDB SQL for the rows of :func:`search`."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({lower}, '{term}') AS terms FROM {docs} WHERE text IS NOT NULL
), sized AS (SELECT doc, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (SELECT count(*)::HUGEINT AS nn, sum(n)::HUGEINT AS ll FROM sized
), post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY ALL
), weight AS (
    SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY term, nn
), q AS (
    SELECT item, item_id, term, count(*) AS c
    FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM {items} WHERE text IS NOT NULL)
    GROUP BY ALL
), scored AS (
    SELECT item, item_id, doc, doc_id,
        sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * nn) // ll)))))::BIGINT AS score
    FROM q JOIN weight USING (term) JOIN post USING (term) JOIN sized USING (doc), total
    GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= {k}"""
