"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: ``sigma`` scatters the shingles
once, and ``pi``, circularly shifted by 1, 2, 3 ..., gives one coordinate for
each shift (C-MinHash). Coordinates are banded; documents of a band's bucket
are candidates, and exact Jaccard similarity of the full shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import connected_components, discard, written
from ._words import mix64, text_chunks, window_hashes, windows_inside, word_hashes, words

_SHINGLE_BASE = 0xD6E8FEB86659FD93
_FINGERPRINT = np.uint64(0xA0761D6478BD642F)
#: Most probability that a pair at the threshold shares none of the longer bands.
_MISS = 1e-6


def _sigma(x: np.ndarray) -> np.ndarray:
    """First permutation, of the 2**32 shingle slots: scatters the structure of the set."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _pi(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 2**32 slots; its argument is shifted, circularly, for each coordinate."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, all sets' hashes one after another, their offsets): distinct sorted shingle hashes of each text."""
    for lo, hi, buf, offs in text_chunks(column):
        starts, ends, woffs = words(buf, offs)
        h = word_hashes(buf, starts, ends, lower=True)
        s = window_hashes(h, size, _SHINGLE_BASE)
        out, ends_at = [], [0]
        for i in range(hi - lo):
            a, b = int(woffs[i]), int(woffs[i + 1])
            if b - a >= size:
                x = np.sort(s[a : b - size + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            elif b > a:
                x = window_hashes(h[a:b], b - a, _SHINGLE_BASE) + np.uint64(b - a)
            else:
                x = h[:0]
            out.append(x)
            ends_at.append(ends_at[-1] + len(x))
        yield lo, (np.concatenate(out) if out else h[:0]), np.asarray(ends_at)


def _fingerprints(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes that tell equal sets from different ones."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets))])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ _FINGERPRINT))])
    both = np.stack([a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]]], 1)
    return [row.tobytes() for row in both]


def signatures(sets: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each non-empty set, one row a set (rows of empty sets are 0)."""
    out = np.zeros((len(at) - 1, coordinates), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    x = _sigma(mix64(sets))
    lo = 0
    while lo < len(full):  # about 64k shingles at a time stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(at[full], at[full[lo]] + (1 << 16))))
        part, begin = full[lo:hi], at[full[lo]]
        piece, cuts = x[begin : at[full[hi - 1] + 1]], at[part] - begin
        if len(part) == 1:  # one set, of any size
            for a in range(0, len(piece), 1 << 16):
                block = piece[a : a + (1 << 16)]
                low = np.array([_pi(block + np.uint32(k + 1)).min() for k in range(coordinates)])
                out[part[0]] = low if a == 0 else np.minimum(out[part[0]], low)
        else:
            for k in range(coordinates):
                out[part, k] = np.minimum.reduceat(_pi(piece + np.uint32(k + 1)), cuts)
        lo = hi
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 85,
    bands: int = 30,
    rows: int = 5,
    coordinates: int = 480,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, ..)``, one row for each row of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their
    sets of distinct word shingles (A-Z lower-cased). Steps: equal sets become
    one class, by a 128-bit fingerprint; each class's band keys (of the first
    ``bands * rows`` coordinates) meet in buckets; every member is compared
    with its bucket's hub, the member of the largest buckets, which is linear
    in the bucket and settles almost all groups. Buckets whose members are still
    in different components are left open; their members meet again in longer
    bands of the coordinates not used so far, so a bucket that chance or
    boilerplate fills is not paired whole, and of those pairs only documents
    of fitting sizes are taken whose ``coordinates`` agree well enough (5
    standard deviations below the threshold). At 0.85 similarity 30 bands of 5
    miss a pair with probability 2.3e-8, the longer bands (47 of 7) one with
    1.3e-8 and that test one with 3e-7.

    Nulls: a null text is empty; an empty text has no shingles, links with
    nothing and is its own component. A null id stays null. Texts of fewer
    than ``shingle`` words are one shingle. Repeated rows are copies of each
    other (one component under their id; each is ``kept`` by the rule id =
    component). Other columns are ignored; ``keep`` passes further columns.
    """
    spark = docs.sparkSession
    kept = list(keep or {})
    kept_rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[c.alias(n) for n, c in (keep or {}).items()],
        F.col(text_col).cast("string").alias("text"),
    )
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_rows.schema if f.name in kept)
    docs = kept_rows.select("doc_id", "text")
    if coordinates < bands * rows:
        raise ValueError("the bands need bands * rows coordinates")

    def features(batches):
        for batch in batches:
            for lo, sets, at in _sets(batch.column("text"), shingle):
                n = np.diff(at)
                sig = signatures(sets, at, coordinates)
                key = np.zeros((len(n), bands), np.uint64)
                for j in range(rows):
                    key = mix64(key * np.uint64(0x9FB21C651E98DF25) + sig[:, j : bands * rows : rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, len(n)) for c in ("doc_id", *kept)],
                        pa.array(n, pa.int64()),
                        pa.array(_fingerprints(sets, at), pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.view(np.int64).ravel())
                        ),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, sig.size + 1, coordinates), pa.int32()),
                            pa.array(sig.astype(np.uint8).view(np.int8).ravel()),
                        ),
                    ],
                    ["doc_id", *kept, "n_shingles", "fp", "bands", "sig"],
                )

    feats = written(
        kept_rows.mapInArrow(
            features, f"doc_id long{kinds}, n_shingles long, fp binary, bands array<long>, sig array<tinyint>"
        ),
        "minhash",
    )
    full = feats.where("n_shingles > 0")
    # The signature is a function of the set: the row of the smallest id stands for its class.
    reps = full.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    banded = full.groupBy("fp").agg(F.first("bands").alias("bands"))
    banded = banded.select("fp", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(buckets.select("band", "key", "n"), ["band", "key"]), "minhash")

    wanted = members.select("fp").distinct()

    def sets_of(batches):
        for batch in batches:
            for _, sets, at in _sets(batch.column("text"), shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_fingerprints(sets, at), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64))),
                    ],
                    ["fp", "shingles"],
                )

    chosen = reps.join(wanted, "fp", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")
    sets = texts.mapInArrow(sets_of, "fp binary, shingles array<long>").join(wanted, "fp", "left_semi")
    sets = written(sets, "minhash")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
        x = x.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        x = x.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u"))
        return x.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")

    # First every member against its bucket's hub, then what that leaves open.
    degree = members.groupBy("fp").agg(F.sum("n").alias("degree"))
    hub = members.join(degree, "fp").groupBy("band", "key").agg(F.max(F.struct("degree", "fp")).alias("hub"))
    star = members.join(hub, ["band", "key"]).select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"))
    star = star.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(confirmed(star), "minhash")
    part = connected_components(links)

    at = members.join(part.withColumnRenamed("id", "fp"), "fp", "left").select(
        "band", "key", "fp", F.coalesce("component", "fp").alias("part")
    )
    mixed = at.groupBy("band", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    open_ = written(at.join(mixed.select("band", "key"), ["band", "key"]), "minhash")
    # Bands of the coordinates that the buckets have not used, as long as pairs at the threshold all but surely share one.
    least, spare = percent / 100, coordinates - bands * rows
    long_ = max((r for r in range(1, spare + 1) if (1 - least**r) ** (spare // r) <= _MISS), default=0)
    cuts = [F.xxhash64(F.lit(i), F.slice("sig", bands * rows + i * long_ + 1, long_)) for i in range(spare // max(1, long_))]
    sig = full.groupBy("fp").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    sig = sig.join(open_.select("fp").distinct(), "fp", "left_semi")
    # Too few coordinates left: the buckets themselves.
    sig = written(sig.select("fp", "sig", "n", (F.array(*cuts) if long_ else F.col("bands")).alias("keys")), "minhash")
    placed = part.select(F.col("id").alias("fp"), "component")
    side = sig.select("fp", F.posexplode("keys").alias("i", "key")).join(placed, "fp", "left")
    side = side.select("fp", "i", "key", F.coalesce("component", "fp").alias("part"))
    mixed = side.groupBy("i", "key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    side = side.join(mixed.select("i", "key"), ["i", "key"], "left_semi").join(sig, "fp")
    # A pair is taken at the first key that it shares.
    first = F.expr("array_position(zip_with(x.keys, y.keys, (s, t) -> s = t), true) = x.i + 1")
    agree = F.expr("aggregate(zip_with(x.sig, y.sig, (s, t) -> int(s = t)), 0, (s, t) -> s + t)")
    floor = int(coordinates * least - 5 * (coordinates * least * (1 - least)) ** 0.5)
    pairs = side.alias("x").join(
        side.alias("y"),
        F.expr("x.key = y.key AND x.i = y.i AND x.part <> y.part AND x.fp < y.fp")
        & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        & first
        & (agree >= floor),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    more = written(confirmed(pairs), "minhash")
    part = connected_components(links.unionByName(more)) if more.limit(1).count() else part
    for table in (members, sets, open_, sig, links, more):
        discard(table)

    classes = reps.join(part.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("part")
    )
    lowest = classes.groupBy("part").agg(F.min("rep").alias("component_id"))
    classes = classes.join(lowest, "part").select("fp", "component_id")
    out = feats.select("doc_id", *kept, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp"))
    out = out.join(classes, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *kept
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *kept
    )
