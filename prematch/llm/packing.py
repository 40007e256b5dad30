"""Best-fit packing of tokenized documents, in bulk-synchronous supersteps.

Documents and gaps are tables of runs: equal lengths with their ranks, equal
gaps with their sequences. Both are sorted into ranges of sizes. In a superstep
every range, a task of its own, sweeps its documents and gaps from the largest
down: each run of documents finds its successor, the smallest gap of the range
that is large enough. Conflicts are settled by rank, longer documents first.
What finds nothing is handed to the next larger range, shrunk gaps go to the
range of their new size, and the next superstep follows; documents that have
passed all ranges start again from their own. When no gap is large enough for
any document, new sequences open for the longest ones. The number of steps
follows the capacity and the ranges, not the documents (some 25 to 35 at 1024
and 4). Each document finds its place by its rank among equals, which is
computed in salted ranges, with one shuffle of the pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import discard, written

END = 2
#: At least so many rank ranges of one length, and one for so many pieces.
_SALTS, _SALT_ROWS = 256, 100_000
#: New sequences open for this part of the open documents' volume at once, for all of it below ``_FEW`` sequences.
_OPEN, _FEW = (3, 4), 32
#: How byte-level BPE cuts a text before merging (a fixed value of these vocabularies).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: One blank between two characters that no Unicode version calls white space: tokens never cross its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 1 << 18
_encoders: dict[str, tuple] = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE's letter of each byte: printable ones are themselves, the others follow from 256."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return {chr(b if b in plain else next(others)): b for b in range(256)}


def _encoder(path: str) -> tuple:
    """The merging engine of a byte-level BPE file and the strings of its added tokens; one a Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            told = json.load(f)
        vocab, added = told["model"]["vocab"], {t["content"]: t["id"] for t in told["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        if told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["normalizer"] or ids != sorted(ids):
            raise ValueError(f"{path} is no byte-level BPE whose ids follow its merges")
        byte = _byte_of_letter()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added), list(added)
    return _encoders[path]


def _parts(text: str) -> Iterator[str]:
    """The text; a long one in parts between which no token lies."""
    at = 0
    while len(text) - at > _LONG and (cut := _CUT.search(text, at + _LONG)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers; the vocabulary's added tokens are recognised in it."""
    engine, added = _encoder(path)
    ids = []
    for part in _parts(text):
        allowed = {a for a in added if a in part}
        ids.append(engine.encode_to_numpy(part, allowed_special=allowed, disallowed_special=()))
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and end id, cut only beyond ``capacity``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    raw = token_ids(text.as_py(), tokenizer).astype("<u4").tobytes() + END.to_bytes(4, "little")
                    n, start = len(raw) // 4, 0
                    for k in range(-(-n // capacity)):
                        end = n % capacity or capacity if k == 0 else start + capacity
                        out.append((doc_id, k, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Rows of the runs' table. kind 0, gaps: ``n`` sequences from ``first`` with ``size`` free. kind 1, open documents: ``n`` of
#: length ``size``, ranks from ``lo``. kind 2, placed: ``per`` documents of length ``size``, ranks from ``lo``, at ``place`` of
#: each of ``n`` sequences from ``first``. ``seek``: the range of sizes in which the row is swept next.
_RUNS = "kind int, seek int, size long, n long, lo long, per long, first long, place long"
_NAMES = ("kind", "seek", "size", "n", "lo", "per", "first", "place")


def _opened(docs: DataFrame, capacity: int, most: int, sequences: int, width: int) -> DataFrame:
    """New sequences for the longest documents: ``most`` in all, and one for each document of more than half of them.

    A run of documents fills whole sequences with as many as they hold; what
    is left over waits for gaps. A window over the runs, one row a length.
    """
    down = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    x = docs.select("size", "n", "lo").withColumn("per", F.least(F.col("n"), F.expr(f"{capacity} div size")))
    x = x.withColumn("need", F.expr("n div per")).withColumn("left", F.lit(most) - F.coalesce(F.sum("need").over(down), F.lit(0)))
    long_ = 2 * F.col("size") > capacity
    x = x.withColumn("count", F.when(long_, F.col("need")).otherwise(F.least("need", F.greatest("left", F.lit(0)))))
    x = x.withColumn("first", F.lit(sequences) + F.coalesce(F.sum("count").over(down), F.lit(0)))

    def row(when: str, **values: str) -> Column:
        told = {"lo": "0L", "per": "0L", "first": "0L", "place": "0L"} | values
        told["seek"] = f"int(({told['size']} - 1) div {width})"
        return F.when(F.expr(when), F.struct(*[F.expr(told[c]).alias(c) for c in _NAMES]))

    rest = f"{capacity} - per * size"
    rows = F.array(
        row("count > 0", kind="2", size="size", n="count", lo="lo", per="per", first="first"),
        row(f"count > 0 AND {rest} > 0", kind="0", size=rest, n="count", first="first"),
        row("n > count * per", kind="1", size="size", n="n - count * per", lo="lo + count * per"),
    )
    return x.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def _swept(runs: DataFrame, capacity: int, width: int) -> DataFrame:
    """One superstep over gaps and documents: the same rows, and those that it has placed.

    A range's sweep goes down the sizes and keeps the gaps seen so far that
    are still free, the smallest on top. So a run of documents finds its
    successor on top and goes there in bundles of as many as the gap holds.
    Longer documents come first, so they win a conflict, and the losers take
    the next larger gap in the same sweep. Documents from smaller ranges stand
    at the range's lower end.
    """

    def sweep(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "seek", "size", "n", "lo", "first"))))
        floor = rows[0][1] * width + 1
        # Larger first; at one size gaps before documents, longer documents first, then by rank or sequence.
        rows.sort(key=lambda r: (-max(r[2], floor if r[0] else 0), r[0], -r[2], r[4], r[5]))
        free: list[list[int]] = []
        out: list[tuple] = []
        for kind, seek, size, n, lo, first in rows:
            if kind == 0:
                free.append([size, n, first])
                continue
            while n and free:
                gap, there, at = free[-1]
                per = min(n, gap // size)
                count = min(there, n // per)
                out.append((2, 0, size, count, lo, per, at, capacity - gap))
                if rest := gap - per * size:
                    out.append((0, (rest - 1) // width, rest, count, 0, 0, at, 0))
                n, lo = n - per * count, lo + per * count
                free[-1] = [gap, there - count, at + count]
                if there == count:
                    free.pop()
            if n:
                out.append((1, seek + 1, size, n, lo, 0, 0, 0))
        out += [(0, (size - 1) // width, size, n, 0, 0, first, 0) for size, n, first in free]
        columns = list(zip(*out)) if out else [[]] * len(_NAMES)
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (len(_NAMES) - 2)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], list(_NAMES))

    return runs.groupBy("seek").applyInArrow(sweep, _RUNS)


def supersteps(counts: DataFrame, capacity: int, ranges: int = 4) -> DataFrame:
    """Packs ``counts(length, n)``; ``(size, lo, per, n, first, place)``: runs of ranks of a length, in how many sequences from which.

    The runs live in a table of the shared folder, written by each step; the
    driver sees totals by range.
    """
    width = -(-capacity // ranges)
    zero = F.lit(0).cast("long")
    runs = counts.select(
        F.lit(1).alias("kind"), F.lit(ranges).alias("seek"), F.col("length").cast("long").alias("size"), F.col("n").cast("long").alias("n"),
        *[zero.alias(c) for c in ("lo", "per", "first", "place")],
    )
    runs, sequences = written(runs, "runs"), 0
    while True:
        told = runs.groupBy("kind", "seek").agg(
            F.min("size").alias("low"), F.max("size").alias("high"), F.sum(F.col("size") * F.col("n")).alias("volume"), F.max(F.col("first") + F.col("n")).alias("end")
        ).collect()
        docs = [r for r in told if r.kind == 1]
        if not docs:
            return runs.where("kind = 2").select("size", "lo", "per", "n", "first", "place")
        sequences = max([sequences, *[r.end for r in told if r.kind != 1]])
        shortest, largest = min(r.low for r in docs), max((r.high for r in told if r.kind == 0), default=0)
        gaps = runs.where(f"kind = 0 AND size >= {shortest}")
        if shortest <= largest:
            left = runs.where("kind = 1")
            if not any(max(r.low, r.seek * width + 1) <= largest for r in docs):  # all have passed: another round from their own ranges
                left = left.withColumn("seek", F.expr(f"int((size - 1) div {width})"))
            new = _swept(gaps.unionByName(left), capacity, width)
        else:
            volume = sum(r.volume for r in docs)
            part = _OPEN if volume > _FEW * capacity else (1, 1)
            most = max(1, -(-volume * part[0] // (capacity * part[1])))
            new = gaps.unionByName(_opened(runs.where("kind = 1"), capacity, most, sequences, width))
        old, runs = runs, written(new.unionByName(runs.where("kind = 2")), "runs")
        discard(old)


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 1024, ranges: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row a piece.

    A document is its text's ids and the end id; only one longer than
    ``capacity`` is cut, into pieces of ``capacity`` with the odd piece first.
    Strings of the vocabulary's added tokens (``<|endoftext|>``) in a text are
    those tokens, as the tokenizer itself reads them. Sizes are swept in
    ``ranges`` ranges at once; only totals by range reach the driver.
    Null and empty texts are the end id alone. Repeated rows and null ids are
    documents of their own. Ties (equal lengths) go by a hash of id and piece,
    then by both; equal rows are interchangeable. An empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer, capacity=capacity, id_col=id_col, text_col=text_col), "pack")
    counts = written(cut.groupBy("length").agg(F.count("*").alias("n")), "pack")
    total = counts.agg(F.sum("n")).first()[0] or 0
    salts = max(_SALTS, total // _SALT_ROWS)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    ranges_ = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    plan = supersteps(counts, capacity, ranges)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranges_ = ranges_.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.withColumn(
        "k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ).join(ranges_, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k") - 1)
    # The plan has some rows for each length up to ``capacity``, whatever the number of documents.
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("per") * plan["n"])
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("first + (rank - lo) div per").alias("sequence_id"),
        F.expr("place + (rank - lo) % per * length").alias("offset"),
    )
