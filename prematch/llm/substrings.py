"""Removal of repeated word sequences by difference-cover anchors.

Anchors are hashed only at word positions whose residue modulo a period is in
a difference cover: for any two positions some common shift below the period
brings both onto the cover. So two equal windows of ``window`` words always
share an anchor of ``window - period + 1`` words at one aligned place, and
only windows around anchors that occur twice need to be looked at whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import discard, written
from ._words import text_chunks, window_hashes, windows_inside, word_hashes, words

#: Perfect difference sets (fixed values): every residue modulo the period is a difference of two members.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
}
_SHORTEST_ANCHOR = 12
_ANCHOR_BASE = 0xC2B2AE3D27D4EB4F
_WINDOW_BASES = (0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length): the sparsest cover that leaves anchors long enough to be rare."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= _SHORTEST_ANCHOR)
    return period, COVERS[period], window - period + 1


def remove_repeats(
    docs: DataFrame,
    *,
    window: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    as_is: bool = False,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, ..)``, one row for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it starts, word for
    word, anywhere else, in another document or in the same one; windows are
    judged on the input. ``kept_text`` is the rest, joined by one space.
    Windows are told apart by 96-bit hashes. Anchors are counted before they
    are joined, so a passage that very many documents share is combined before
    its shuffle and joined as a skewed key.

    Null texts have no words. Texts of fewer than ``window`` words lose
    nothing. Repeated rows are copies: all their windows repeat. Ids may be
    null or repeat, since a row is known by 96 bits of hashes of its id and its
    text. Other columns are ignored; ``keep`` passes further columns with their
    rows. With ``as_is`` a text that loses nothing keeps its white space too.
    """
    period, cover, size = cover_for(window)
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True
    kept_names = list(keep or {})
    kept_rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[c.alias(n) for n, c in (keep or {}).items()],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kept_rows = kept_rows.withColumns(
        {"key": F.xxhash64("doc_id", "text"), "sum": F.shiftrightunsigned(F.xxhash64(F.lit("sum"), "doc_id", "text"), 32)}
    )
    rows = kept_rows.select("key", "text", "sum")

    def anchors(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("sum").to_numpy()
            for lo, hi, buf, offs in text_chunks(batch.column("text")):
                starts, ends, woffs = words(buf, offs)
                h = window_hashes(word_hashes(buf, starts, ends), size, _ANCHOR_BASE)
                if not len(h):
                    continue
                lengths = np.diff(woffs)
                doc = np.repeat(np.arange(hi - lo), lengths)[: len(h)]
                at = np.arange(len(h)) - woffs[doc]
                good = on_cover[at % period] & windows_inside(woffs, size) & (lengths[doc] >= window)
                doc, at = doc[good] + lo, at[good]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(doc)),
                        pa.array(h[good].view(np.int64)),
                        pa.array((sums[doc] << 32) | at),
                    ],
                    ["key", "anchor", "place"],
                )

    found = rows.mapInArrow(anchors, "key long, anchor long, place long")
    twice = written(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeats")
    near = found.join(twice, "anchor").select("key", "place")
    # Rows of equal id and text have one entry: a set, so that very many of them are no long list.
    near = near.groupBy("key", F.shiftrightunsigned("place", 32).alias("sum")).agg(
        F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")).alias("places")
    )
    # A short number for each such text: its windows carry it instead of both hashes.
    near = written(near.withColumn("slot", F.monotonically_increasing_id()), "repeats")
    discard(twice)

    def candidates(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, places = batch.column("slot"), batch.column("places")
            for lo, hi, buf, offs in text_chunks(batch.column("text")):
                starts, ends, woffs = words(buf, offs)
                if woffs[-1] < window:
                    continue
                mark = np.zeros(woffs[-1] + window + 1, np.int32)
                for i in range(lo, hi):
                    p = np.asarray(places[i].values) + woffs[i - lo]
                    np.add.at(mark, np.maximum(p - period + 1, woffs[i - lo]), 1)
                    np.add.at(mark, p + 1, -1)
                word = word_hashes(buf, starts, ends)
                h = [window_hashes(word, window, b) for b in _WINDOW_BASES]
                good = (np.cumsum(mark)[: len(h[0])] > 0) & windows_inside(woffs, window)
                doc = np.repeat(np.arange(hi - lo), np.diff(woffs))[: len(good)][good]
                at = np.flatnonzero(good) - woffs[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        slots.take(pa.array(doc + lo)),
                        pa.array(h[0][good].view(np.int64)),
                        pa.array((h[1][good] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(at.astype(np.int32)),
                    ],
                    ["slot", "a", "b", "start"],
                )

    keyed = rows.join(near, ["key", "sum"]).select("slot", "text", "places")
    found = written(keyed.mapInArrow(candidates, "slot long, a long, b int, start int"), "repeats")
    twice = written(found.groupBy("a", "b").count().where("count > 1").select("a", "b"), "repeats")
    starts = found.join(twice, ["a", "b"]).groupBy("slot").agg(F.collect_set("start").alias("places"))
    gone = written(starts.join(near.select("slot", "key", "sum"), "slot").drop("slot"), "repeats")
    discard(found)
    discard(twice)

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, n_words, n_removed, kept = batch.column("places"), [], [], []
            for i, t in enumerate(batch.column("text")):
                w = t.as_py().encode().split()
                n_words.append(len(w))
                if places[i].is_valid:
                    mark = np.zeros(len(w) + 1, np.int32)
                    p = np.unique(np.asarray(places[i].values))
                    mark[p] += 1
                    mark[p + window] -= 1
                    w = [w[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(w))
                kept.append(t.as_py() if as_is and not n_removed[-1] else b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()), *[batch.column(c) for c in kept_names],
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", *kept_names],
            )

    marked = kept_rows.alias("d").join(gone.alias("n"), F.expr("d.key = n.key AND d.sum = n.sum"), "left")
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_rows.schema if f.name in kept_names)
    return marked.select("d.doc_id", "d.text", "n.places", *[f"d.{c}" for c in kept_names]).mapInArrow(
        cut, f"doc_id long, n_words long, n_removed long, kept_text string{kinds}"
    )
