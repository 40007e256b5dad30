"""Quality of documents by a byte-level convolutional network in numpy.

Bytes are embedded, filters of 8 bytes with stride 4 run over the whole text,
their activations are max-pooled in overlapping chunks, and the chunks' mean
and maximum are combined into one probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import written
from ._words import text_chunks

_STRIDE, _EMBED = 4, 8
#: Filter positions of a chunk, and from one chunk's start to the next's.
_CHUNK, _STEP = 128, 112
#: Chunks whose activations are in memory at once, however long a text is.
_PART = 1024
Weights = dict[str, np.ndarray]


def start_weights(filters: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    wide = _STRIDE * _EMBED
    return {
        "embed": rng.normal(0, 0.5, (256, _EMBED)).astype(np.float32),
        "conv": rng.normal(0, (2 * wide) ** -0.5, (wide, 2 * filters)).astype(np.float32),
        "bias": np.zeros(filters, np.float32),
        "out": rng.normal(0, 0.1, 2 * filters).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }


def _blocks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole strides, two at least, and their offsets in strides."""
    n = np.maximum(2, -(-np.diff(offs) // _STRIDE))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    out = np.zeros(at[-1] * _STRIDE, np.uint8)
    shift = np.repeat(at[:-1] * _STRIDE - offs[:-1], np.diff(offs))
    out[np.arange(len(buf)) + shift] = buf
    return out, at


def _chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past last filter position of each chunk, and each text's offset among the chunks."""
    n = np.diff(at) - 1  # filters span two strides
    k = np.maximum(1, -(-(n - (_CHUNK - _STEP)) // _STEP))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(k)])
    doc = np.repeat(np.arange(len(n)), k)
    lo = at[doc] + (np.arange(first[-1]) - first[doc]) * _STEP
    return lo, np.minimum(lo + _CHUNK, at[doc] + n[doc]), first


def _responses(w: Weights, blocks: np.ndarray) -> np.ndarray:
    f = len(w["bias"])
    x = w["embed"][blocks].reshape(-1, _STRIDE * _EMBED) @ w["conv"]
    y = x[:, :f]
    y[:-1] += x[1:, f:]
    return y


def _pooled(w: Weights, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest activation of each filter in each chunk."""
    out = np.empty((len(lo), len(w["bias"])), w["conv"].dtype)
    for c in range(0, len(lo), _PART):
        a, z = lo[c : c + _PART], hi[c : c + _PART]
        y = _responses(w, blocks[a[0] * _STRIDE : (z[-1] + 1) * _STRIDE])
        cuts = np.stack([a, z], 1).ravel() - a[0]
        out[c : c + _PART] = np.maximum.reduceat(y, cuts, 0)[::2]
    return out


def logits(w: Weights, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One number a text; a text is scored whole and without regard to its neighbours."""
    blocks, at = _blocks(buf, offs)
    lo, hi, first = _chunks(at)
    pooled = np.maximum(_pooled(w, blocks, lo, hi) + w["bias"], 0)
    f = len(w["bias"])
    mean = np.add.reduceat(pooled, first[:-1], 0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(pooled, first[:-1], 0)
    return mean @ w["out"][:f] + most @ w["out"][f:] + w["shift"][0]


def _gradients(w: Weights, texts: list[np.ndarray], y: np.ndarray) -> Weights:
    buf = np.concatenate(texts)
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts])])
    blocks, at = _blocks(buf, offs)
    lo, hi, first = _chunks(at)
    f, n = len(w["bias"]), len(texts)
    pooled, place = np.empty((len(lo), f), w["conv"].dtype), np.empty((len(lo), f), np.int64)
    for c in range(0, len(lo), _PART):
        a, z = lo[c : c + _PART], hi[c : c + _PART]
        spot = np.minimum(a[:, None] + np.arange(_CHUNK), z[:, None] - 1)
        r = _responses(w, blocks[a[0] * _STRIDE : (z[-1] + 1) * _STRIDE])[spot - a[0]]
        best = r.argmax(1)
        pooled[c : c + _PART] = np.take_along_axis(r, best[:, None], 1)[:, 0]
        place[c : c + _PART] = np.take_along_axis(spot, best, 1)
    pooled += w["bias"]
    live = pooled > 0
    pooled = np.maximum(pooled, 0)
    doc, count = np.repeat(np.arange(n), np.diff(first)), np.diff(first)
    mean = np.add.reduceat(pooled, first[:-1], 0) / count[:, None]
    most = np.maximum.reduceat(pooled, first[:-1], 0)
    z = mean @ w["out"][:f] + most @ w["out"][f:] + w["shift"][0]
    g = (1 / (1 + np.exp(-z)) - y) / n
    top = (pooled == most[doc]) & live
    top = top / np.maximum(1, np.add.reduceat(top, first[:-1], 0, dtype=np.int64))[doc]
    back = g[doc, None] * (w["out"][:f] / count[doc, None] + w["out"][f:] * top) * live
    out = {"out": np.concatenate([g @ mean, g @ most]), "shift": g.sum()[None], "bias": back.sum(0)}
    conv, embed = np.zeros_like(w["conv"]), np.zeros_like(w["embed"])
    strides = blocks.reshape(-1, _STRIDE)
    for part in range(0, len(lo), _PART):
        here = back[part : part + _PART]
        c, k = np.nonzero(here)
        if not len(c):
            continue
        v, p = here[c, k].astype(np.float32), place[part : part + _PART][c, k]
        a = int(p.min())
        strip = strides[a : int(p.max()) + 2]
        x = w["embed"][strip].reshape(-1, _STRIDE * _EMBED)
        dx = np.zeros_like(x)
        for filt, step in ((k, 0), (k + f, 1)):
            np.add.at(conv.T, filt, v[:, None] * x[p - a + step])
            np.add.at(dx, p - a + step, v[:, None] * w["conv"].T[filt])
        hit = np.flatnonzero(dx.any(1))
        np.add.at(embed, strip[hit].ravel(), dx[hit].reshape(-1, _EMBED))
    return out | {"conv": conv, "embed": embed}


def fit(texts: list[bytes], y: np.ndarray, *, filters: int = 24, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Weights:
    """Adam on log loss; both classes weigh the same."""
    w, rng = start_weights(filters, seed), np.random.default_rng(seed)
    rows = [np.frombuffer(t, np.uint8) for t in texts]
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            part = order[lo : lo + batch]
            step += 1
            for k, g in _gradients(w, [rows[i] for i in part], y[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                move = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
                w[k] = (w[k] - move).astype(np.float32)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    per_class: int = 1000,
    most_bytes: int = 16 << 20,
    filters: int = 24,
    epochs: int = 14,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Weights | None:
    """Fit on a bounded sample of labelled documents, whole texts.

    It is the ``per_class`` documents of each label (0 and 1) of the smallest
    hash of their id, or fewer: a label's sample ends with the document that
    brings it to ``most_bytes`` bytes. Ids are chosen from ``labels`` alone and
    sent to the documents, so no text is shuffled but the sample's. The labels'
    true shares set the threshold. Null ids and ids without a text are left
    out; null texts are empty. Without texts of both labels there is no model
    (None).
    """
    told = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    sizes = {r.y: r["count"] for r in told.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    told = told.distinct()
    few = [told.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # Bounded: per_class rows of each label.
    chosen = written(few[0].unionByName(few[1]), "quality")
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = written(sample.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "y", "text"), "quality")
    order = Window.partitionBy("y").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)
    sizes_before = sample.select("h", "t", "y", F.octet_length("text").cast("long").alias("bytes")).distinct()
    sizes_before = sizes_before.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("before") < most_bytes)
    sample = sample.dropDuplicates(["h", "t", "y"]).join(sizes_before.select("h", "t", "y"), ["h", "t", "y"], "left_semi")

    def learn(batches) -> Iterator[pa.RecordBatch]:
        got = sorted((h, t.encode(), y) for b in batches for h, y, t in zip(*(b.column(c).to_pylist() for c in ("h", "y", "text"))))
        if {r[2] for r in got} == {0, 1}:
            y = np.array([r[2] for r in got], np.float32)
            w = fit([r[1] for r in got], y, filters=filters, epochs=epochs)
            w["shift"] = w["shift"] - np.float32(np.log(max(1, y.sum()) / max(1, (1 - y).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(w)], pa.binary())], ["w"])

    found = sample.repartition(1).mapInArrow(learn, "w binary").collect()
    if not found:
        return None
    w = pickle.loads(found[0].w)
    w["shift"] = w["shift"] + np.float32(np.log(sizes[1] / sizes[0]))
    return w


def score(docs: DataFrame, w: Weights | None, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, .., score, predicted)`` for each row; ``keep`` passes further columns.

    Null and empty texts are scored as the empty text. Whole texts count,
    however long. Ids may be null or repeat; equal texts get equal scores.
    Other columns are ignored. Without a model every score is 0.5.
    """
    kept = list(keep or {})
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in (keep or {}).items()], F.col(text_col).cast("string").alias("text")
    )

    def judge(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if w is not None:
                for lo, hi, buf, offs in text_chunks(batch.column("text"), 1 << 18):
                    # Six decimals: what rounding in the matrix products leaves alone.
                    p[lo:hi] = np.round(1 / (1 + np.exp(-logits(w, buf, offs).astype(np.float64))), 6)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("doc_id", *kept)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", *kept, "score", "predicted"],
            )

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(judge, f"doc_id long{kinds}, score double, predicted int")
