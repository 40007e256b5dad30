"""Scoring of texts by a gated recurrent language model in numpy.

The output is factored: a softmax over word classes (by a word's last two
bytes), then a softmax over the class's frequent words and one place for all
its other words, which share that place by their counts. The counts are those
of all training documents; the recurrent weights come from truncated
backpropagation over all of them too, each once, so training grows with the corpus.
A document's state is carried from window to window, so its score is the
log-likelihood of the whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import discard, written
from ._words import mix64, text_chunks, word_hashes, words

_CLASSES = 48  # at most 64: a word's key ends in its class
_MEMBERS = 32  # of a class: frequent words, and the last place for the others
_HIDDEN = 32
_WINDOW = 32
_END_TAIL = 0xFFFF  # the end of a text as a word: no word ends in two bytes 0xFF
_END_HASH = np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task reads before it trains on them, in at most so many parallel streams.
_CHUNK, _STREAMS = 1 << 18, 64
#: Texts that are scored side by side: their states stay in a core's cache.
_TEXTS = 512
#: Weights that Adam changes at once.
_BLOCK = 1 << 13
#: Partial results that one task averages.
_FAN_IN = 8
_NO_WORD = -30.0
State = dict[str, np.ndarray]


def _keep_pages() -> None:
    """Let freed memory stay with the process: glibc returns none below a size that the largest freed block sets.

    Otherwise the temporaries of each window are new pages, which cost as much as the arithmetic.
    """
    np.empty(1 << 24, np.uint8)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, past last row, word hashes, last two bytes, token offsets): words in lower case, then an end."""
    _keep_pages()
    for lo, hi, buf, offs in text_chunks(column):
        starts, ends, woffs = words(buf, offs)
        h = word_hashes(buf, starts, ends, lower=True)
        last = buf[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        fold = lambda x: x + 32 * ((x >= 65) & (x <= 90))
        tail = fold(before) << 8 | fold(last)
        at = woffs + np.arange(hi - lo + 1)
        h = np.insert(h, woffs[1:], _END_HASH)
        yield lo, hi, h, np.insert(tail, woffs[1:], _END_TAIL), at


@dataclass
class Vocabulary:
    classes: np.ndarray  # class of each pair of last bytes
    slots: np.ndarray  # key of a frequent word, by the top bits of its hash
    counts: np.ndarray
    member: np.ndarray  # place in its class, or the last place
    rest: np.ndarray  # log10 of (count of the words without a place + reserve), by class
    reserve: np.ndarray  # log10 of what unknown words share, by class
    seen: np.ndarray  # [class, place]: count of its word, of all others in the last place; 0 where there is no word
    total: int
    distinct: int

    def keys(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls = self.classes[tail]
        return (h & np.uint64(0xFFFFFFFFFFFFFFC0)) | cls.astype(np.uint64), cls

    def places(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key, class, count (0 if not among the most frequent), and class * members + place of each word."""
        key, cls = self.keys(h, tail)
        slot = (key >> np.uint64(44)).astype(np.int64)
        hit = self.slots[slot] == key
        member = np.where(hit, self.member[slot], _MEMBERS - 1)
        return key, cls, np.where(hit, self.counts[slot], 0), cls.astype(np.int32) * _MEMBERS + member


def count_words(docs: DataFrame) -> DataFrame:
    """``(h, tail, c)`` for every word of ``docs(text)``; batches are counted before the shuffle."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(h, tail) for _, _, h, tail, _ in _tokens(batch.column("text"))]
            if not parts:
                continue
            h, tail = (np.concatenate(x) for x in zip(*parts))
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(tail[first].astype(np.int32)), pa.array(c)], ["h", "tail", "c"]
            )

    found = docs.select("text").mapInArrow(count, "h long, tail int, c long")
    return found.groupBy("h", "tail").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, known: int) -> Vocabulary:
    """Tables of bounded size: 65,536 pairs of last bytes, the ``known`` most frequent words."""
    tails = counts.groupBy("tail").agg(
        F.sum("c").alias("c"), F.count("*").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")
    ).collect()
    mass = np.zeros(1 << 16, np.int64)
    once = np.zeros(1 << 16, np.int64)
    for r in tails:
        mass[r.tail], once[r.tail] = r.c, r.once
    by_mass = np.argsort(-mass, kind="stable")[: _CLASSES - 1]
    classes = np.full(1 << 16, _CLASSES - 1, np.uint8)
    classes[by_mass[mass[by_mass] > 0]] = np.arange((mass[by_mass] > 0).sum())
    # The most frequent words, by a count that at most ``known`` words reach: no sort.
    octave = F.floor(F.log2("c") * 8).cast("int")
    left, least = known, None
    for r in sorted(counts.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r.o):
        left -= r["count"]
        if left < 0:
            break
        least = r.o
    top = sorted(counts.where(octave >= least).collect(), key=lambda r: (-r.c, r.h)) if least is not None else []
    out = Vocabulary(
        classes, np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int64), np.full(1 << 20, _MEMBERS - 1, np.int8),
        np.bincount(classes, mass, _CLASSES), np.bincount(classes, once, _CLASSES),
        np.zeros((_CLASSES, _MEMBERS)), int(mass.sum()), sum(r.n for r in tails),
    )
    placed = np.zeros(_CLASSES, np.int64)
    for r in top:
        key, cls = out.keys(np.array([r.h], np.int64).view(np.uint64), np.array([r.tail]))
        slot, cls = int(key[0] >> np.uint64(44)), int(cls[0])
        if out.counts[slot]:
            continue  # two words of one slot: the rarer one is looked up like all rare words
        out.slots[slot], out.counts[slot] = key[0], r.c
        if placed[cls] < _MEMBERS - 1:
            out.member[slot] = placed[cls]
            out.seen[cls, placed[cls]] = r.c
            placed[cls] += 1
            out.rest[cls] -= r.c
    reserve = np.maximum(1.0, out.reserve)
    out.seen[:, -1] = out.rest + 0.5
    out.rest, out.reserve = np.log10(out.rest + reserve), np.log10(reserve)
    return out


def _start(seed: int, seen: np.ndarray | None = None) -> State:
    """Small random weights; the biases alone give each word its share in ``seen`` (class, then place)."""
    rng = np.random.default_rng(seed)
    n = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    seen = np.ones((_CLASSES, _MEMBERS)) if seen is None else seen
    share = seen.sum(1) + 1.0
    with np.errstate(divide="ignore"):
        place = np.where(seen > 0, np.log(seen / seen.sum(1, keepdims=True)), _NO_WORD)
    return {
        "x": rng.normal(0, 0.3, (_CLASSES * _MEMBERS, 3 * _HIDDEN)).astype(np.float32),
        "u": n(_HIDDEN, 3 * _HIDDEN),
        "c": n(_HIDDEN, _CLASSES) * 0.1,
        "cb": np.log(share / share.sum()).astype(np.float32),
        "m": (n(_HIDDEN, _CLASSES, _MEMBERS) * 0.1).transpose(1, 0, 2).copy(),
        "mb": place.astype(np.float32),
    }


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Rows of three gates as three blocks of rows."""
    return x.reshape(len(x), 3, _HIDDEN).swapaxes(0, 1)


def _step(w: dict[str, np.ndarray], h: np.ndarray, x: np.ndarray, out=None, a=None, n=None) -> tuple[np.ndarray, ...]:
    """One gated step for rows or blocks ``x``: the new state, and what backpropagation needs, in the given arrays.

    That is 1 - z, 1 - r and the candidate's recurrent part as three blocks, and the candidate.
    """
    x = x if x.ndim == 3 else _by_gate(x)
    a = np.matmul(h, _by_gate(w["u"]), out=a)
    g, inner = a[:2], a[2]
    g += x[:2]
    np.exp(g, out=g)  # may overflow: a closed gate
    g += 1
    np.reciprocal(g, out=g)
    n = np.multiply(inner, g[1], out=n)
    np.subtract(inner, n, out=n)
    n += x[2]
    np.tanh(n, out=n)
    new = np.subtract(n, h, out=out)
    new *= g[0]
    new += h
    return new, a, n


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row, in place, and their sums; rows are shifted only where they could leave a float's range."""
    if len(x) and not -60 < x.min() <= x.max() < 60:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _by_class(cls: np.ndarray) -> list[tuple[int, slice]]:
    """Rows of each class that occurs; ``cls`` ascends."""
    cuts = np.searchsorted(cls, np.arange(_CLASSES + 1)).tolist()
    return [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]


def _output(w: dict[str, np.ndarray], h: np.ndarray, order: np.ndarray, cls: np.ndarray) -> tuple:
    """Both output layers for the states ``h[order]``, of ascending classes ``cls``.

    The states with a last column of 1, so that biases are the weights' last
    row; exponentials over classes and over places, each with their sums; the
    places' weights; rows by class.
    """
    hs = np.empty((len(order), _HIDDEN + 1), h.dtype)
    hs[:, :-1] = h.take(order, 0)
    hs[:, -1] = 1
    m = np.concatenate([w["m"], w["mb"][:, None]], 1)
    e, groups = np.empty((len(order), _MEMBERS), h.dtype), _by_class(cls)
    for k, rows in groups:
        np.matmul(hs[rows], m[k], out=e[rows])
    return hs, _shares(hs @ np.concatenate([w["c"], w["cb"][None]])), _shares(e), m, groups


def _log_prob(w: dict[str, np.ndarray], h: np.ndarray, cls: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Natural log of P(class | state) P(place | class, state) for each row."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cls, row = cls[order], np.arange(len(order))
    _, (d, total), (e, part), *_ = _output(w, h, order, cls)
    out = np.empty(len(order), d.dtype)
    out[order] = np.log(d[row, cls] / total) + np.log(e[row, member[order]] / part)
    return out


def gradients(w: State, part: np.ndarray, h: np.ndarray, end: int) -> tuple[dict, np.ndarray]:
    """Gradients of one window (step, stream) of places from the state ``h``, by stream, and the state after it.

    ``x`` has those of the places that occur: (places, gradients). Only what
    follows from step to step is computed step by step.
    """
    steps, streams = part.shape
    shape, at, ends = (steps, streams, _HIDDEN), part.ravel(), part == end
    x = np.ascontiguousarray(_by_gate(w["x"])).take(at, 1).reshape(3, *shape)
    states, n, a = np.empty((steps + 1, *shape[1:]), h.dtype), np.empty(shape, h.dtype), np.empty((steps, 3, *shape[1:]), h.dtype)
    states[0] = h
    with np.errstate(over="ignore"):
        for t, stop in enumerate(ends.any(1).tolist()):
            _step(w, states[t], x[:, t], states[t + 1], a[t], n[t])
            if stop:
                states[t + 1][ends[t]] = 0
    # Places in order: the rows of a place, and so of a class, lie together.
    order = np.argsort(at, kind="stable")
    here, row = at[order], np.arange(len(at))
    cls, flat = here // _MEMBERS, states[:-1].reshape(-1, _HIDDEN)
    hs, (d, total), (e, sums), m, groups = _output(w, flat, order, cls)
    d *= (1 / (streams * total))[:, None]
    d[row, cls] -= 1 / streams
    e *= (1 / (streams * sums))[:, None]
    e[row, here - cls * _MEMBERS] -= 1 / streams
    gc, gm, dm = (d.T @ hs).T, np.zeros_like(m), np.empty((len(at), _HIDDEN), h.dtype)
    mt = w["m"].swapaxes(1, 2).copy()
    for k, rows in groups:
        np.matmul(hs[rows].T, e[rows], out=gm[k])
        np.matmul(e[rows], mt[k], out=dm[rows])
    dm += d @ w["c"].T
    dh = np.empty(shape, h.dtype)
    dh.reshape(-1, _HIDDEN)[order] = dm
    # What a unit of the new state's gradient gives to the gates and to the state before; nothing where a text ends.
    cz, cr, inner = a[:, 0], a[:, 1], a[:, 2]
    z = 1 - cz
    dn = (1 - n * n) * cz
    z[ends] = dn[ends] = 0
    q = np.empty((steps, streams, 3, _HIDDEN), h.dtype)
    q[:, :, 0] = (states[:-1] - n) * cz * z
    q[:, :, 2] = last = dn * (1 - cr)
    q[:, :, 1] = last * cr * inner
    back, ut = np.zeros(shape, h.dtype), w["u"].T
    for t in range(steps - 1, -1, -1):
        q[t] *= back[t][:, None]
        if t:
            np.matmul(q[t].reshape(streams, -1), ut, out=back[t - 1])
            back[t - 1] += back[t] * z[t]
            back[t - 1] += dh[t]
    gates = q.reshape(len(at), 3 * _HIDDEN)
    g = {"u": (gates.T @ flat).T, "c": gc[:-1], "cb": gc[-1], "m": gm[:, :-1], "mb": gm[:, -1]}
    q[:, :, 2] = back * dn
    # Rows are added up by place: a class's rows times which of its places each one has.
    new = np.diff(here, prepend=-1) != 0
    place, gates = np.cumsum(new) - 1, gates.take(order, 0)
    gx, which = np.empty((int(new.sum()), gates.shape[1]), h.dtype), np.zeros((len(at), _MEMBERS), h.dtype)
    firsts = {k: int(place[rows.start]) for k, rows in groups}
    which[row, place - np.array([firsts.get(k, 0) for k in range(_CLASSES)])[cls]] = 1
    for k, rows in groups:
        lo, hi = firsts[k], int(place[rows.stop - 1]) + 1
        np.matmul(which[rows, : hi - lo].T, gates[rows], out=gx[lo:hi])
    g["x"] = here[new], gx
    return g, states[-1]


def _adam(w: np.ndarray, m1: np.ndarray, m2: np.ndarray, g: np.ndarray, pace: float, scale: float) -> None:
    """One step of Adam, in place; block by block, so that temporaries stay in a core's cache."""
    for lo in range(0, len(w), _BLOCK):
        w_, m1_, m2_, g_ = (v[lo : lo + _BLOCK] for v in (w, m1, m2, g))
        x = g_ * g_
        x -= m2_
        x *= 0.01
        m2_ += x
        np.subtract(g_, m1_, out=x)
        x *= 0.1
        m1_ += x
        d = m2_ * scale
        np.sqrt(d, out=d)
        d += 1e-8
        np.divide(m1_, d, out=x)
        x *= pace
        w_ -= x


def fit(ids: np.ndarray, w: State, end: int, *, rate: float) -> State:
    """Truncated backpropagation through time over ``ids`` (class * members + place), whole texts with their ends.

    Adam's moments start anew. The tokens are cut into parallel streams read
    window by window; the recurrent state goes on from window to window,
    gradients stop there, and a text's end clears it.
    """
    _keep_pages()
    none = w["mb"] <= _NO_WORD
    # All weights but those of places lie in one array, which one step changes at once.
    names = [k for k in w if k != "x"]
    dense = np.concatenate([w[k].ravel() for k in names])
    parts = np.split(dense, np.cumsum([w[k].size for k in names])[:-1])
    w = {k: v.reshape(w[k].shape) for k, v in zip(names, parts)} | {"x": w["x"].copy()}
    moments = np.zeros((2, *dense.shape), dense.dtype), np.zeros((2, *w["x"].shape), dense.dtype)
    streams = max(1, min(_STREAMS, len(ids) // (_WINDOW * 64)))
    length = -(-len(ids) // streams)
    grid = np.concatenate([ids, np.full(streams * length - len(ids), end, ids.dtype)]).reshape(streams, length).T
    h = np.zeros((streams, _HIDDEN), np.float32)
    for step, lo in enumerate(range(0, length, _WINDOW), 1):
        g, h = gradients(w, grid[lo : lo + _WINDOW], h, end)
        places, gx = g.pop("x")
        g = np.concatenate([g[k].ravel() for k in names])
        norm = float(g @ g + gx.ravel() @ gx.ravel()) ** 0.5
        pace = rate * min(1.0, step / 8) * min(1.0, 20.0 / (norm + 1e-9)) / (1 - 0.9**step)
        scale = 1 / (1 - 0.99**step)
        _adam(dense, *moments[0], g, pace, scale)
        rows = [v.take(places, 0) for v in (w["x"], *moments[1])]
        _adam(*(v.reshape(-1) for v in rows), gx.reshape(-1), pace, scale)
        for v, new in zip((w["x"], *moments[1]), rows):
            v[places] = new
        w["mb"][none] = _NO_WORD
    return w


def _averaged(parts: DataFrame) -> State | None:
    """The mean of ``parts(part, n, state)`` by weight ``n``, in a tree: a task reads a few, the driver one."""

    def mean(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        total: State = {}
        for k, data in zip(n, table.column("state")):
            for name, x in pickle.loads(data.as_py()).items():
                x = x.astype(np.float64) * (k / sum(n))
                total[name] = total[name] + x if name in total else x
        told = pickle.dumps({name: x.astype(np.float32) for name, x in total.items()})
        return pa.table({"part": table.column("part")[:1], "n": pa.array([sum(n)]), "state": pa.array([told], pa.binary())})

    rows, old = None, None
    while rows is None or len(rows) > 1:
        parts = parts.withColumn("part", F.expr(f"part div {_FAN_IN}")).groupBy("part").applyInArrow(mean, "part long, n long, state binary")
        parts = written(parts, "words")
        if old is not None:
            discard(old)
        old, rows = parts, parts.limit(2).collect()
    discard(parts)
    return pickle.loads(rows[0].state) if rows else None


def learned(places: DataFrame, rounds: int, state: State, end: int, *, rate: float = 0.01, part_tokens: int = 1 << 19) -> State:
    """Weights fitted on ``places(h, round, n, ids)``, one pass: a ``rounds``-th of the texts in each round.

    A round's texts are dealt by hash to partitions of about ``part_tokens``
    tokens and ordered by it, so the result does not depend on the cluster.
    """
    tokens = {r["round"]: r.n for r in places.groupBy("round").agg(F.sum("n").alias("n")).collect()}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, held, size = state, 0, [], 0
        for batch in batches:
            held.append(batch.column("ids").flatten().to_numpy())
            n, size = n + len(held[-1]), size + len(held[-1])
            while size >= _CHUNK:
                ids = np.concatenate(held)
                now, held, size = fit(ids[:_CHUNK], now, end, rate=pace), [ids[_CHUNK:]], size - _CHUNK
        if size:
            now = fit(np.concatenate(held), now, end, rate=pace)
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([pickle.dumps(now)], pa.binary())], ["part", "n", "state"])

    for r in range(rounds):
        pace = rate * (1 - r / (rounds + 1))
        here = places.where(F.col("round") == r).repartition(max(1, tokens.get(r, 0) // part_tokens), "h").sortWithinPartitions("h", "n")
        state = _averaged(here.select("ids").mapInArrow(learn, "part long, n long, state binary")) or state
    return state


def _likelihoods(w: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each text's places; texts run side by side, longest first."""
    _keep_pages()
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    starts, n = at[:-1][order], n[order]
    out = np.zeros(len(n))
    x = np.ascontiguousarray(_by_gate(w["x"]))
    for first in range(0, len(n), _TEXTS):
        begin, size = starts[first : first + _TEXTS], n[first : first + _TEXTS]
        h, told = np.zeros((len(begin), _HIDDEN), np.float32), out[first : first + _TEXTS]
        a, inner = np.empty((3, *h.shape), np.float32), np.empty_like(h)
        for lo in range(0, int(size[0]), _WINDOW):
            live = np.searchsorted(-size, -np.arange(lo, min(lo + _WINDOW, int(size[0]))), "left")  # texts longer than t
            cuts = np.append(0, np.cumsum(live))
            rows = np.arange(cuts[-1]) - np.repeat(cuts[:-1], live)
            seen = ids[begin[rows] + np.repeat(np.arange(lo, lo + len(live)), live)]
            states = np.empty((len(seen), _HIDDEN), np.float32)
            with np.errstate(over="ignore"):
                for k, here in zip(live, map(slice, cuts, cuts[1:])):
                    states[here] = h[:k]
                    _step(w, states[here], x.take(seen[here], 1), h[:k], a[:, :k], inner[:k])
            p = _log_prob(w, states, seen // _MEMBERS, seen % _MEMBERS)
            told += np.bincount(rows, p, len(told))
    back = np.empty(len(out))
    back[order] = out
    return back


def score(
    docs: DataFrame,
    held_out: Column,
    *,
    share: int = 1,
    rounds: int = 4,
    known: int = 131_072,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Tokens are words (A-Z lower-cased) and one end a text. All rows that are
    not held out are counted, whole; the recurrent weights are fitted on all of
    them, whole, dealt by a hash of id and text to ``rounds`` rounds (``share``
    above 1 would fit on one in so many). The ``known`` most frequent words travel with the model, the
    others' counts are joined, so nothing is cut off. Unknown words share, in
    each class, a reserve as large as its words seen once. Both scores are
    log10 probabilities.

    Null texts are empty: the end alone. Ids may be null (not held out) or
    repeat; every row is scored on its own. Other columns are ignored. Without
    training documents every word is unknown.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    train = docs.where("NOT held_out")
    counts = written(count_words(train), "words")
    voc = vocabulary(counts, known)

    def placed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, tail, at in _tokens(batch.column("text")):
                ids = pa.array(voc.places(h, tail)[3].astype(np.int16))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("h").slice(lo, hi - lo), batch.column("round").slice(lo, hi - lo),
                        pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids),
                    ],
                    ["h", "round", "n", "ids"],
                )

    spot = F.xxhash64("doc_id", "text")
    sample = train.select(spot.alias("h"), F.pmod(spot, F.lit(share * rounds)).cast("int").alias("round"), "text")
    sample = sample.where(F.col("round") < rounds).mapInArrow(placed, "h long, round int, n long, ids array<smallint>")
    end = int(voc.places(np.array([_END_HASH]), np.array([_END_TAIL]))[3][0])
    sample = written(sample, "words")
    weights = learned(sample, rounds, _start(3, voc.seen), end)
    discard(sample)
    carried = spark.sparkContext.broadcast((voc, weights))
    base = np.log10(voc.total + voc.distinct + 1)

    def judge(batches) -> Iterator[pa.RecordBatch]:
        table, w = carried.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            all_ids, at_all = [], [np.zeros(1, np.int64)]
            columns: list[list[np.ndarray]] = [[], [], [], []]
            rare, times, rare_at = [], [], [np.zeros(1, np.int64)]
            begin = 0
            for lo, hi, h, tail, at in _tokens(batch.column("text")):
                key, cls, c, ids = table.places(h, tail)
                sums = lambda x: np.add.reduceat(x, at[:-1])
                in_rest = ids % _MEMBERS == _MEMBERS - 1
                known_ = c > 0
                # What is known here: words with a count; the others' counts are joined.
                part = np.where(in_rest, np.where(known_, np.log10(np.maximum(c, 1)), 0) - table.rest[cls], 0)
                for column, x in zip(columns, (np.diff(at), sums(known_.astype(np.int64)), sums(np.where(known_, np.log10(c + 1.0), 0)), sums(part))):
                    column.append(x)
                # Once for each text and word, with its occurrences there.
                word, text = key[~known_], np.repeat(np.arange(hi - lo), np.diff(at))[~known_]
                order = np.lexsort((word, text))
                word, text = word[order], text[order]
                first = np.ones(len(word), bool)
                first[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
                rare.append(word[first])
                times.append(np.diff(np.flatnonzero(np.append(first, True))))
                rare_at.append(rare_at[-1][-1] + np.cumsum(np.bincount(text[first], minlength=hi - lo)))
                all_ids.append(ids)
                at_all.append(begin + at[1:])
                begin += at[-1]
            n_tokens, n_known, base_part, rest_part = (np.concatenate(x) for x in columns)
            neural = _likelihoods(w, np.concatenate(all_ids), np.concatenate(at_all)) / np.log(10)
            found = pa.StructArray.from_arrays([np.concatenate(rare).view(np.int64), np.concatenate(times)], ["key", "count"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(rare_at), pa.int32()), found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"),
                    pa.array(n_tokens), pa.array(n_known), pa.array(base_part), pa.array(neural + rest_part), lists,
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )
            row += batch.num_rows

    scored = docs.mapInArrow(
        judge,
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<key: long, count: long>>",
    )
    scored = written(scored, "words")
    # Rare words by key: a hash whose last six bits are the class, as in Vocabulary.keys.
    lookup = spark.createDataFrame([(i, int(c)) for i, c in enumerate(voc.classes) if c < _CLASSES - 1], "tail int, cls long")
    keyed = counts.join(F.broadcast(lookup), "tail", "left").select(
        F.col("h").bitwiseAND(-64).bitwiseOR(F.coalesce("cls", F.lit(_CLASSES - 1).cast("long"))).alias("key"), "c"
    )
    keyed = keyed.groupBy("key").agg(F.max("c").alias("c"))
    reserve = F.array(*[F.lit(float(x)) for x in voc.reserve])
    rare = scored.select("row", F.inline("rare")).join(keyed, "key", "left").select(
        "row", "count", "c", F.coalesce(F.log10("c"), reserve[F.col("key").bitwiseAND(63).cast("int")]).alias("lp")
    )
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("count"))).alias("more"),
        F.sum(F.col("count") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("base_more"),
        F.sum(F.col("count") * F.col("lp")).alias("score_more"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more") - F.col("n_tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("score") + zero("score_more")).alias("score"),
    )
