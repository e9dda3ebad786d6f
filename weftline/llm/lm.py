"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy or by compiled loops.

What the corpus gives grows with it: exact counts of all words of all training texts, and from them exact counts of all
subword ids and of pairs of them inside words. The counts fix the base score, the ids that are predicted one by one, the
distribution inside the classes that hold the other ids, a prior of the next class given the last subword, and a unigram
over all training words. The attention model, one layer with a feed-forward layer after it, corrects that prior from the
subwords before in its window. Its weights start from a fit on a sample (``SAMPLE_DOCS`` texts, at most
``SAMPLE_WINDOWS`` windows of each) and are then trained on every window of every training text: each task takes Adam
steps over all its windows, and the weights that tasks end with are averaged by their windows (``ROUNDS`` rounds), so
steps grow with the corpus. The same rows in the same partitions give the same weights.

Whole texts are scored in windows of ``WINDOW`` positions that overlap by ``OVERLAP``; each position is scored once, in
the first window that holds it, under a causal mask, many windows at a time: after a text's first window it sees the
``OVERLAP`` subwords before it at least and WINDOW - 1 at most. No place is computed twice. A word's probability is that of its subwords
and of its end; it is mixed with the word unigram (weight ``UNIGRAM``).

Words outside a broadcast head meet their counts, for the base score and for the unigram, in a join. The head holds at
most ``HEAD`` words of at most ``HEAD_BYTES`` bytes, and whatever the length the words, a thousand at most, that are a
thousandth of all tokens: so it takes all the hot keys out of that join. It changes no score.

Defined cases: null and empty texts are one end token; rows that share a doc_id are texts of their own; a null doc_id is
never held out; with no training text the base has N = V = 0 and the model is uniform; an empty table gives no rows;
texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import kernels
from weftline.llm.tokens import blocks, bounded_batches, default_path, encoder, grouped, releasing
from weftline.storage import materialise

WINDOW, OVERLAP, WIDTH, BATCH = 64, 32, 32, 48
SINGLE, GROUPS = 216, 4  # ids predicted one by one, and classes of other ids on either side of the space
INPUTS = 2048
SMOOTH = 5.0  # counts that a distribution over fewer conditions is worth
PART = 32  # windows whose gradients are computed at a time
MOST = 60.0  # of scores and logits that need no shift before they are exponentiated
HEAD, HEAD_BYTES, UNIGRAM = 200_000, 64, 0.1
SAMPLE_DOCS, SAMPLE_WINDOWS, STEPS, PASSES, RATE = 3000, 16, 3000, 8, 0.01
ROUNDS, ROUND_RATE = 1, 0.002  # passes over all training windows, and their rate
MEMO = 200_000  # encodings that a worker remembers at a time


# --- words ----------------------------------------------------------------------------------------------------------


def words_of(texts: pa.Array, made: kernels.Compiled | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of every token, distinct words, offsets of the rows) with A-Z lower-cased; null counts as empty."""
    library = kernels.loaded(made)
    if library is not None and texts.nbytes < 1 << 30:
        return kernels.words(library, texts)
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(low)
    flat, at = split.values, split.offsets.to_numpy().astype(np.int64)
    flat = flat.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    keep = pc.not_equal(flat, "")
    mask = keep.to_numpy(zero_copy_only=False)
    if not mask.all():
        at = np.concatenate([[0], np.cumsum(mask)])[at]
        flat = flat.filter(keep)
    coded = pc.dictionary_encode(flat)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()), at


def encoded(words: pa.Array, tokenizer: str, made: kernels.Compiled | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of words, each with a space before it: all ids, where each word's begin among them and how many they are.

    Compiled merges give the library's ids; the words that they leave, and all without them, are encoded by the library.
    """
    tok, library = encoder(tokenizer, MEMO), kernels.loaded(made)
    held = kernels.merges(tokenizer) if library is not None else None
    if held is None:
        return tok.words([w.decode() for w in words.to_pylist()])
    ids, starts, sizes = kernels.encode(library, held, words)
    left = np.flatnonzero(sizes < 0)
    if len(left):
        more, begin, size = tok.words([w.decode() for w in words.take(pa.array(left)).to_pylist()])
        starts[left], sizes[left] = begin + len(ids), size
        ids = np.concatenate([ids, more])
    return ids, starts, sizes


def _training(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) != 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all training texts, and their number under a null word. Counts meet in each block of texts first."""
    bounded_batches(docs.sparkSession)

    made = kernels.compiled()

    def per_batch(batches):
        texts = 0
        for batch in grouped(batches, 0, 8_000_000):
            for lo, hi in blocks(batch.column(0), size=8_000_000):
                index, words, _ = words_of(batch.column(0)[lo:hi], made)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)))], names=["word", "n"])
            texts += len(batch)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])

    rows = docs.filter(_training()).select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(per_batch), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_pairs(counts: DataFrame, tokenizer: str) -> DataFrame:
    """``before, after, n``: how often subword ids follow one another inside training words; -1 is a word's edge."""

    made = kernels.compiled()

    def pairs(batches):
        for batch in grouped(batches, 0, 1_000_000):
            held, starts, sizes = encoded(batch.column(0), tokenizer, made)
            held, _ = subwords(np.arange(len(sizes)), held, starts, sizes)
            step = word_pairs(held.astype(np.int64) + 1, sizes, len(held))
            key, n = np.unique(step[:, 0] << 32 | step[:, 1], return_inverse=True)
            total = np.bincount(n.reshape(-1), weights=np.repeat(batch.column(1).to_numpy(), sizes + 1), minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32) - 1), pa.array((key & 0xFFFFFFFF) - 1), pa.array(total.astype(np.int64))], names=["before", "after", "n"])

    rows = counts.filter("word is not null").mapInArrow(releasing(pairs), "before long, after long, n long")
    return rows.groupBy("before", "after").agg(F.sum("n").alias("n"))


def subword_counts(pairs: DataFrame, ids: int) -> np.ndarray:
    """How often every subword id occurs in the training texts; one row an id reaches the driver."""
    out = np.zeros(ids, np.int64)
    for r in pairs.filter("after >= 0").groupBy("after").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["after"]] = r["n"]
    return out


def pair_counts(pairs: DataFrame, v: Vocabulary) -> np.ndarray:
    """How often one input number follows another; 0 stands before a word and after it.

    The table is inputs x inputs whatever the corpus; each reduce task sends its part as one row of packed numbers.
    """
    held = pairs.sparkSession.sparkContext.broadcast(v)

    def numbered(batches):
        given, inputs = np.append(held.value.input, 0), held.value.inputs  # id -1 is the last entry
        for batch in batches:
            key = given[batch.column(0).to_numpy()] * inputs + given[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column(2)], names=["key", "n"])

    def packed(batches):
        got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(got, 1).astype("<i8").tobytes()], pa.binary())], names=["part"])

    rows = pairs.mapInArrow(numbered, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(packed, "part binary")
    out = np.zeros(v.inputs * v.inputs, np.int64)
    for r in rows.toLocalIterator():
        key, n = np.frombuffer(r["part"], "<i8").reshape(2, -1)
        out[key] = n
    return out.reshape(v.inputs, v.inputs)


def word_pairs(given: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Rows (before, after) for every step through words of ``sizes`` input numbers, from 0 to 0."""
    words = len(sizes)
    place = np.arange(n) + np.repeat(np.arange(words), sizes)  # each word has one step more than numbers
    before, after = np.zeros(n + words, np.int64), np.zeros(n + words, np.int64)
    after[place], before[place + 1] = given, given
    first = np.cumsum(sizes + 1) - (sizes + 1)
    before[first] = 0
    return np.stack([before, after], 1)


# --- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Tables:
    """What pair counts say, in natural logs; classes are predicted within their side, at a space or inside a word."""

    space: np.ndarray  # log odds of a space after an input number
    first: np.ndarray  # classes at a space
    prior: np.ndarray  # [input, class inside a word]
    inside: np.ndarray  # [class before, input number], natural log, for numbers of one id
    back: np.ndarray  # [class before, class]: what an id without a number multiplies its own share by
    single: np.ndarray  # id -> whether its input number is its alone

    @classmethod
    def of(cls, v: Vocabulary, pairs: np.ndarray, counts: np.ndarray, ends: int) -> Tables:
        # Class of an input number: an id's own, or the class that the number stands for.
        kind = np.zeros(v.inputs, np.int64)
        kind[1 : v.classes + 1] = np.arange(v.classes)
        kind[v.input] = v.output
        single = v.input > v.classes
        to = np.zeros((v.inputs, v.classes))
        np.add.at(to.T, kind[1:], pairs[:, 1:].T)
        follow, stop, start = to.copy(), pairs[:, 0].astype(float), to[0]
        follow[:, : v.inner] = 0
        follow[0] = 0
        # Inside words: shares of going on, smoothed by those of all words together.
        every = follow.sum(0) + 0.5 * (np.arange(v.classes) >= v.inner)
        goes = every.sum() / (every.sum() + stop[1:].sum() + 1)
        on = follow.sum(1) + SMOOTH * goes
        space = np.log((stop + SMOOTH * (1 - goes)) / on)
        prior = np.log((follow + SMOOTH * goes * every / every.sum())[:, v.inner :] / on[:, None])
        # At a space: the first subwords of words, or the end.
        first = (start + 0.5)[: v.inner]
        first[0] = ends + 0.5
        first = np.log(first / first.sum())
        # Inside classes, given the class before (0: a space).
        by = np.zeros((v.classes, v.inputs))
        np.add.at(by, kind, np.where(np.arange(v.inputs)[:, None] > 0, pairs, 0))
        by[0] = pairs[0]
        own = np.zeros(v.inputs)
        own[v.input[single]] = np.exp(v.inside[single])
        by = np.where(own > 0, by, 0)
        total = np.zeros((v.classes, v.classes))
        np.add.at(total.T, kind, by.T)
        inside = np.log((by + SMOOTH * own + 1e-30) / (total[:, kind] + SMOOTH))
        return cls(space.astype(np.float32), first.astype(np.float32), prior.astype(np.float32), inside, np.log(SMOOTH / (total + SMOOTH)), single)


@dataclass
class Vocabulary:
    """How ids are seen and predicted. Output class 0 is the end; classes from ``inner`` on go on with a word."""

    output: np.ndarray  # id -> class
    inside: np.ndarray  # id -> natural log of its share of its class
    input: np.ndarray  # id -> input number; 0 is the beginning
    inner: int
    classes: int
    inputs: int

    @classmethod
    def of(cls, counts: np.ndarray, spaced: np.ndarray) -> Vocabulary:
        output, inside, number = np.zeros(len(counts), np.int64), np.zeros(len(counts)), 1
        inner = 0
        order = np.argsort(-counts, kind="stable")
        single = np.zeros(len(counts), bool)
        single[order[:SINGLE]] = counts[order[:SINGLE]] > 0
        for side in (True, False):
            if not side:
                inner = number
            mine = order[spaced[order] == side]
            for i in mine[single[mine]]:
                output[i] = number
                number += 1
            rest = mine[~single[mine]]
            # Classes of about equal weight, from frequent to rare.
            weight = np.cumsum(counts[rest] + 0.5)
            group = np.minimum((weight - counts[rest] / 2 - 0.25) * GROUPS // weight[-1], GROUPS - 1).astype(int) if len(rest) else np.zeros(0, int)
            for g in range(GROUPS):
                ids = rest[group == g]
                if len(ids):
                    share = counts[ids] + 0.5
                    output[ids], inside[ids] = number, np.log(share / share.sum())
                    number += 1
        seen = order[: INPUTS - number - 1]
        given = 1 + output  # an id without a number of its own is seen as its class
        given[seen] = number + 1 + np.arange(len(seen))
        return cls(output, inside, given, inner, number, int(given.max()) + 1)


def init(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), WIDTH
    w = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"e": w(v.inputs, d) * np.float32(np.sqrt(v.inputs) * 0.3), "p": w(WINDOW, d), "qkv": w(d, 3 * d), "o": w(d, d), "u": w(d, 2 * d), "d": w(2 * d, d), "out": w(d, v.classes) * np.float32(0.1), "b": np.zeros(v.classes, np.float32), "s": np.zeros((d, 1), np.float32)}


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _weights(s: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Exponentials of masked scores, in place. A maximum is taken off first only where they would overflow."""
    if len(s) and s.max() > MOST:
        s -= np.where(mask > 0, s, -np.inf).max(2, keepdims=True)
        np.minimum(s, 0, out=s)
    np.exp(s, out=s)
    s *= mask
    return s


def gradients(m: dict, v: Vocabulary, t: Tables, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean loss over weighted positions of windows of input numbers (n x WINDOW), and its gradients.

    A position's loss is that of its side and of its class ``y`` within that side. Windows are taken ``PART`` at a time, so
    that what a part holds stays in a core's cache and no new memory is asked for; the gradients are sums over all parts.
    """
    d, w = WIDTH, (weight / max(weight.sum(), 1)).astype(np.float32)
    # Queries times keys and values times "o" are one product of weights each, so keys are the inputs themselves.
    asks, keys, values = m["qkv"][:, :d] * np.float32(d**-0.5), m["qkv"][:, d : 2 * d], m["qkv"][:, 2 * d :]
    both = np.concatenate([asks @ keys.T, values @ m["o"]], 1)
    outs = [np.ascontiguousarray(m["out"][:, : v.inner]), np.ascontiguousarray(m["out"][:, v.inner :])]
    g = {k: np.zeros_like(m[k]) for k in ("out", "b", "s", "d", "u", "p")}
    dboth, dh, loss = np.zeros_like(both), np.empty((*x.shape, d), m["e"].dtype), 0.0
    for lo in range(0, len(x), PART):
        part = slice(lo, lo + PART)
        loss += _gradients(m, v, t, both, outs, x[part], y[part].reshape(-1), w[part].reshape(-1), g, dboth, dh[part])
    g["d"] *= np.float32(0.5)
    g["qkv"] = np.concatenate([dboth[:, :d] @ keys * np.float32(d**-0.5), dboth[:, :d].T @ asks, dboth[:, d:] @ m["o"].T], 1)
    g["o"] = values.T @ dboth[:, d:]
    g["e"] = np.bincount((x.reshape(-1, 1) * d + np.arange(d)).reshape(-1), weights=dh.reshape(-1), minlength=m["e"].size).astype(m["e"].dtype).reshape(m["e"].shape)
    return float(loss), g


def _gradients(m: dict, v: Vocabulary, t: Tables, both: np.ndarray, outs: list, x: np.ndarray, y: np.ndarray, w: np.ndarray, g: dict, dboth: np.ndarray, dx: np.ndarray) -> float:
    """Loss of some windows with weights ``w``; their gradients are added to ``g`` and ``dboth``, those of the inputs written to ``dx``."""
    n, d = x.shape[0], WIDTH
    x = x.reshape(-1)
    h0 = m["e"].take(x, 0).reshape(n, WINDOW, d)
    h0 += m["p"]
    flat = h0.reshape(-1, d)
    qv = (flat @ both).reshape(n, WINDOW, 2 * d)
    q, vv = qv[..., :d], qv[..., d:]
    s = _weights(np.matmul(q, h0.transpose(0, 2, 1)), _MASK)
    part = 1 / (s @ np.ones((WINDOW, 1), s.dtype))  # rows of s are left unscaled: what they meet is scaled
    a = np.matmul(s, vv)
    a *= part
    h1 = flat + a.reshape(-1, d)
    u = h1 @ m["u"]
    u += np.abs(u)  # twice the rectified values
    h = u @ (m["d"] * np.float32(0.5))
    h += h1
    at_space = y < v.inner
    side = 1 / (1 + np.exp(-np.clip((h @ m["s"])[:, 0] + t.space[x], -30, 30)))
    loss = -np.dot(np.log(np.where(at_space, side, 1 - side) + 1e-30), w)
    ds = ((side - at_space) * w)[:, None].astype(h.dtype)
    g["s"] += h.T @ ds
    dh = ds * m["s"].T
    # Classes of one side only are asked for at a position.
    for which, lo, hi, out in ((at_space, 0, v.inner, outs[0]), (~at_space, v.inner, v.classes, outs[1])):
        rows = np.flatnonzero(which & (w > 0))
        if not len(rows):
            continue
        hr, wr = h.take(rows, 0), w[rows]
        p = hr @ out
        if lo == 0:
            p += m["b"][lo:hi] + t.first
        else:
            p += m["b"][lo:hi]
            p += t.prior.take(x[rows], 0)
        if p.max() > MOST:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total, at = p @ np.ones((hi - lo, 1), p.dtype), np.arange(len(rows)) * (hi - lo) + (y[rows] - lo)
        one = p.reshape(-1)
        loss -= np.dot(np.log(one[at] / total[:, 0] + 1e-30), wr)
        p *= wr[:, None] / total
        one[at] -= wr
        g["out"][:, lo:hi] += (p.T @ hr).T
        g["b"][lo:hi] += np.ones(len(rows), p.dtype) @ p
        dh[rows] += p @ out.T
    g["d"] += u.T @ dh
    du = dh @ m["d"].T
    du *= u > 0
    g["u"] += h1.T @ du
    dh += du @ m["u"].T
    da = dh.reshape(n, WINDOW, d)
    # What a row's weights share is the product of its output and that output's gradient.
    a *= da
    shared = a @ np.ones((d, 1), h.dtype)
    shared *= part
    da = da * part
    ds = np.matmul(da, vv.transpose(0, 2, 1))
    ds -= shared
    ds *= s
    dqv = np.empty_like(qv)
    dqv[..., :d] = np.matmul(ds, h0)
    dqv[..., d:] = np.matmul(s.transpose(0, 2, 1), da)
    dh += np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, d)
    dqv = dqv.reshape(-1, 2 * d)
    dboth += flat.T @ dqv
    dh += dqv @ both.T
    dx[...] = dh.reshape(n, WINDOW, d)
    g["p"] += dx.sum(0)
    return loss


class Hidden:
    """Hidden states for scoring. Queries, keys and values are sums of a part of the input number and one of the place."""

    def __init__(self, m: dict):
        d = WIDTH
        parts = [m["qkv"][:, :d] * np.float32(d**-0.5), m["qkv"][:, d : 2 * d], m["qkv"][:, 2 * d :] @ m["o"]]
        asks, holds = np.concatenate([parts[0], np.eye(d, dtype=m["e"].dtype)], 1), np.concatenate(parts[1:], 1)
        self.asks, self.holds = (m["e"] @ asks, m["p"] @ asks), (m["e"] @ holds, m["p"] @ holds)
        self.up, self.down = m["u"], m["d"] * np.float32(0.5)

    def __call__(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Of the places from ``first`` on of the first places of windows, given as input numbers (n x size): n x (size - first) x WIDTH."""
        n, size, d = *x.shape, WIDTH
        asks = self.asks[0].take(x[:, first:], 0)
        asks += self.asks[1][first:size]
        holds = self.holds[0].take(x, 0)
        holds += self.holds[1][:size]
        s = _weights(np.matmul(asks[..., :d], holds[..., :d].transpose(0, 2, 1)), _MASK[first:size, :size])
        h = np.matmul(s, holds[..., d:])
        h /= s @ np.ones((size, 1), s.dtype)
        h += asks[..., d:]
        h = h.reshape(-1, d)
        u = h @ self.up
        u += np.abs(u)  # twice the rectified values
        h += u @ self.down
        return h.reshape(n, size - first, d)


def fit(v: Vocabulary, t: Tables, windows: np.ndarray, steps: int | None = None, seed: int = 9, made: kernels.Compiled | None = None) -> dict:
    """Adam over windows of ids (n x WINDOW + 1): PASSES times over them, at most STEPS steps; ``made`` are compiled loops.

    The first id is what stands before the window: -1 for the beginning; -2 is the end, -3 nothing.
    """
    m, rng = init(v), np.random.default_rng(seed)
    steps = min(STEPS, PASSES * len(windows) // 64) if steps is None else steps
    adam = Adam(m, kernels.native(made, m, v, t, WINDOW, WIDTH, MOST))
    for i in range(1, steps + 1 if len(windows) else 1):
        adam.step(v, t, windows[rng.integers(0, len(windows), 64)], RATE * min(1, i / 50) * (1 - 0.98 * i / steps))
    return m


class Adam:
    """Steps that change the weights ``m`` in place, by compiled loops if there are any."""

    def __init__(self, m: dict, native: kernels.Native | None = None):
        self.m, self.i, self.native = m, 0, native
        self.first, self.second, *self.spare = ({k: np.zeros_like(x) for k, x in m.items()} for _ in range(4))

    def step(self, v: Vocabulary, t: Tables, windows: np.ndarray, rate: float) -> None:
        self.i += 1
        if self.native:
            self.native.step(self.m, windows, self.first, self.second, rate / (1 - 0.9**self.i), 1 - 0.99**self.i)
            return
        given = np.where(windows[:, :-1] >= 0, v.input[np.maximum(windows[:, :-1], 0)], 0)
        asked = np.where(windows[:, 1:] >= 0, v.output[np.maximum(windows[:, 1:], 0)], 0)
        weight = (windows[:, 1:] > -3).astype(np.float32)
        _, g = gradients(self.m, v, t, given, asked, weight)
        for k, x in g.items():
            first, second, move, by = self.first[k], self.second[k], *(spare[k] for spare in self.spare)
            np.subtract(x, first, out=move)
            move *= np.float32(0.1)
            first += move
            np.multiply(x, x, out=move)
            move -= second
            move *= np.float32(0.01)
            second += move
            np.divide(second, np.float32(1 - 0.99**self.i), out=by)
            np.sqrt(by, out=by)
            by += np.float32(1e-8)
            np.multiply(first, np.float32(rate / (1 - 0.9**self.i)), out=move)
            move /= by
            self.m[k] -= move


@dataclass
class Scorer:
    """Everything scoring needs; its size is bounded by the vocabulary and HEAD."""

    tokenizer: str
    vocabulary: Vocabulary
    tables: Tables
    weights: dict
    head: tuple[pa.Array, np.ndarray]  # words, and how often each occurs
    ends: int  # training texts, each of which has one end
    total: int  # N
    distinct: int  # V
    made: kernels.Compiled | None = None  # the loops that score, compiled

    def positions(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs at every position: of what stands there within its side, of a space, and of going on with a word.

        ``ids`` are the subwords of all texts, ``at`` their offsets; a text's end stands after its subwords.
        """
        v, m, t = self.vocabulary, self.weights, self.tables
        if self.native:
            each = np.arange(len(at))
            share, picked, space, on, _ = self.scored(each[:-1], each, ids, at[:-1], np.diff(at))
            return share + picked[: len(share)], space[: len(share)], on[: len(share)]
        shares, own, numbers, kinds = self.shares
        lengths = np.diff(at) + 1
        start = np.concatenate([[0], np.cumsum(lengths)])
        total = int(start[-1])
        # A window may reach beyond the last text; -1 asks for nothing.
        given, asked, lp, side = np.zeros(total + WINDOW, np.int32), np.full(total + WINDOW, -1, np.int32), np.zeros(total), np.zeros(total, np.float32)
        where = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), np.diff(at))
        number, kind = numbers.take(ids), kinds.take(ids)
        asked[start[1:] - 1] = 0
        asked[where], given[where + 1] = kind, number
        # A text's own beginning is 0, like the space before its first word.
        seen = np.concatenate([[0], kind])[: len(ids)]
        seen[kind < v.inner] = 0
        seen[at[:-1][np.diff(at) > 0]] = 0
        seen *= v.inputs
        seen += number
        lp[where] = shares.take(seen)
        lp[where] += own.take(ids)
        states, spans, each = Hidden(m), self.spans(start), np.arange(WINDOW)
        first, inner = m["b"][: v.inner] + t.first, t.prior + m["b"][v.inner :]
        outs = [np.ascontiguousarray(m["out"][:, : v.inner]), np.ascontiguousarray(m["out"][:, v.inner :])]
        ones = [np.ones((o.shape[1], 1), np.float32) for o in outs]
        for known, size, begin, end in spans:
            for lo in range(0, len(begin), BATCH):
                pos = begin[lo : lo + BATCH, None] + each[:size]
                x = given.take(pos)
                h = states(x, known).reshape(-1, WIDTH)
                pos, x = pos[:, known:], x[:, known:].reshape(-1)
                y = np.where(pos < end[lo : lo + BATCH, None], asked.take(pos), -1).reshape(-1)
                pos = pos.reshape(-1)
                go = (h @ m["s"])[:, 0]
                go += t.space.take(x)
                for lowest, rows, o, one in ((0, np.flatnonzero((y >= 0) & (y < v.inner)), outs[0], ones[0]), (v.inner, np.flatnonzero(y >= v.inner), outs[1], ones[1])):
                    q = pos.take(rows)
                    side[q] = go.take(rows)
                    z = h.take(rows, 0) @ o
                    z += inner.take(x.take(rows), 0) if lowest else first
                    if len(z) and z.max() > MOST:
                        z -= z.max(1, keepdims=True)
                    picked = z.reshape(-1).take(np.arange(len(q)) * o.shape[1] + (y.take(rows) - lowest))
                    np.exp(z, out=z)
                    picked -= np.log((z @ one)[:, 0])
                    lp[q] += picked
        return self.sides(lp, side)

    def scored(self, index: np.ndarray, at: np.ndarray, held: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """By compiled loops, at every place: the log of its share of its class, of its class, of a space and of going on; the texts' first places.

        Word i of a block has the ids ``held[starts[i]:][:sizes[i]]``, texts have the words ``index`` between successive ``at``.
        """
        given, asked, share, start = self.native.laid(self.shares, index, at, held, starts, sizes)
        side, picked, sums = self.native.scores(self.weights, self.hidden, given, asked, self.spans(start))
        self.native.logs(side, picked, sums)
        return share, picked, sums, side, start

    @staticmethod
    def spans(start: np.ndarray) -> tuple:
        """(first place asked for, size, begins, ends of texts) of windows over texts that begin at ``start``, the last number being all places.

        The first OVERLAP places of a text stand alone; a window then asks for its other places, and the part that is
        known gives keys and values only. So no place is computed twice.
        """
        step = WINDOW - OVERLAP
        n = -(-np.maximum(np.diff(start) - OVERLAP, 0) // step)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (0, OVERLAP, start[:-1], start[1:]), (OVERLAP, WINDOW, np.repeat(start[:-1], n) + nth * step, np.repeat(start[1:], n))

    @staticmethod
    def sides(lp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With ``lp`` the logs of both sides, from the odds."""
        space = np.minimum(side, 0) - np.log1p(np.exp(-np.abs(side)))
        return lp, space, space - side

    @cached_property
    def native(self) -> kernels.Native | None:
        return kernels.native(self.made, self.weights, self.vocabulary, self.tables, WINDOW, WIDTH, MOST)

    @cached_property
    def hidden(self) -> Hidden:
        return Hidden(self.weights)

    @cached_property
    def listed(self) -> kernels.Listed | None:
        """Places in the head."""
        library = kernels.loaded(self.made)
        return kernels.Listed(library, self.head[0]) if library is not None else None

    @cached_property
    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An id's share of its class, as a part by the class before and its input number and one of its own; input numbers and classes of ids."""
        v, t = self.vocabulary, self.tables
        by = t.inside.copy()
        by[:, 1 : v.classes + 1] = t.back  # ids without a number of their own are seen as 1 + their class
        return by.reshape(-1), np.where(t.single, 0, v.inside), v.input.astype(np.int32), v.output.astype(np.int32)

    def texts(self, texts: pa.Array) -> dict[str, list]:
        """Scores of a string column, and what its words outside the head still need for the base score."""
        index, words, at = words_of(texts, self.made)
        rows = len(texts)
        row = np.repeat(np.arange(rows), np.diff(at))
        held = encoded(words, self.tokenizer, self.made)
        if self.native:
            share, picked, space, on, _ = self.scored(index, at, *held)
            model, ending = self.native.summed(index, at, held[2], share, picked, space, on)
        else:
            ids, word_at = subwords(index, *held)
            lp, space, on = self.positions(ids.astype(np.int64), word_at[at])
            # Positions of a word's first subword and of what follows its last: every text before has one end.
            a, b = word_at[:-1] + row, word_at[1:] + row
            run = np.concatenate([[0.0], np.cumsum(lp + on)])
            model = run[b] - run[a] - on[a] + space[b]
            ending = lp[word_at[at[1:]] + np.arange(rows)]

        if self.listed:
            known = np.append(self.head[1], 0)[self.listed(words)]
        else:
            place = pc.index_in(words, value_set=self.head[0])
            known = np.append(self.head[1], 0)[pc.fill_null(place, len(self.head[1])).to_numpy(zero_copy_only=False)]
        share, got = np.log(UNIGRAM) + np.log(np.maximum(known / max(self.total, 1), 1e-300)), (known > 0)[index]
        mixed = np.logaddexp(model + np.log(1 - UNIGRAM), share[index])
        tail_end = np.log(UNIGRAM) + np.log(max(self.ends / max(self.total, 1), 1e-300))
        ended = np.logaddexp(ending + np.log(1 - UNIGRAM), tail_end)
        score = (np.bincount(row, weights=np.where(got, mixed, 0.0), minlength=rows) + ended) / np.log(10)

        floor = np.log10(self.total + 0.5 * (self.distinct + 1)) if self.total or self.distinct else np.log10(0.5)
        logs = np.where(known > 0, np.log10(known + 0.5), 0.0)[index]
        base = np.bincount(row, weights=logs, minlength=rows) + np.log10(self.ends + 0.5)
        tokens = np.diff(at) + 1
        # Words outside the head: (row, word) with how often, and the model's natural log at each of its places.
        out = np.flatnonzero(~got)
        pair, nth, times = np.unique(row[out] * max(len(words), 1) + index[out], return_inverse=True, return_counts=True)
        places = model[out][np.argsort(nth.reshape(-1), kind="stable")]
        pair_row, pair_word = np.divmod(pair, max(len(words), 1))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(pair_row.astype(np.int64), minlength=rows))]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32()), pa.array(places, pa.float64()))
        models = pa.ListArray.from_arrays(pa.array(offsets), each)
        tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words.take(pa.array(pair_word)), pa.array(times, pa.int64())], names=["word", "times"]))
        return {"n_tokens": pa.array(tokens, pa.int64()), "head_known": pa.array(np.bincount(row, weights=got, minlength=rows).astype(np.int64) + (self.ends > 0)), "head_log": pa.array(base), "floor": pa.array(np.full(rows, floor)), "score": pa.array(score), "tail": tail, "models": models}


_SCORED = "n_tokens long, head_known long, head_log double, floor double, score double, tail array<struct<word: binary, times: bigint>>, models array<array<double>>"


def subwords(index: np.ndarray, held: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each word's begin, and last their number): word i of a block has ``held[starts[i]:][:sizes[i]]``."""
    size = sizes[index]
    word_at = np.concatenate([[0], np.cumsum(size)])
    return held[np.repeat(starts[index] - word_at[:-1], size) + np.arange(word_at[-1])] if len(index) else held[:0], word_at


def windows_of(line: np.ndarray) -> np.ndarray:
    """All windows (n x WINDOW + 1) of a text's ids between -1 and -2: each id but the first is asked for once."""
    n = max(1, -(-(len(line) - 1) // WINDOW))
    padded = np.full(n * WINDOW + 1, -3, np.int32)
    padded[: len(line)] = line
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::WINDOW]


def text_windows(texts: pa.Array, tokenizer: str, made: kernels.Compiled | None = None):
    """The windows of each text of a string column."""
    index, words, at = words_of(texts, made)
    ids, word_at = subwords(index, *encoded(words, tokenizer, made))
    ends = word_at[at]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        line = np.empty(b - a + 2, np.int32)
        line[0], line[1:-1], line[-1] = -1, ids[a:b], -2
        yield windows_of(line)


def train(docs: DataFrame, tokenizer: str, v: Vocabulary, t: Tables, m: dict) -> tuple[dict, int]:
    """Weights after ROUNDS passes over all windows of all training texts from ``m``, and how many windows a pass has."""
    rows, spark = docs.filter(_training()).select(F.col("text").cast("string").alias("text")), docs.sparkSession
    names = list(m)
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((v, t, m, kernels.compiled()))

        def per_task(batches):
            v, t, m, made = held.value
            m = {k: x.copy() for k, x in m.items()}
            adam, seen, rng = Adam(m, kernels.native(made, m, v, t, WINDOW, WIDTH, MOST)), 0, np.random.default_rng(11)

            def steps(windows):
                for at in range(0, len(windows), 64):
                    adam.step(v, t, windows[at : at + 64], ROUND_RATE * min(1, (adam.i + 1) / 50))

            waiting, size = [], 0
            for batch in grouped(batches, 0, 1_000_000):
                for lo, hi in blocks(batch.column(0), 4096, 1_000_000):
                    for cut in text_windows(batch.column(0)[lo:hi], tokenizer, made):
                        waiting.append(cut)
                        size += len(cut)
                        if size >= 4096:
                            # In any order, and what does not fill a step waits for the next texts.
                            mixed = rng.permutation(np.concatenate(waiting))
                            full = size // 64 * 64
                            steps(mixed[:full])
                            waiting, seen, size = [mixed[full:]], seen + full, size - full
            if size:
                steps(rng.permutation(np.concatenate(waiting)))
                seen += size
            if seen:
                flat = np.concatenate([m[k].reshape(-1) for k in names]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "weights"])

        parts = materialise(rows.mapInArrow(releasing(per_task), "n long, weights binary"), "lm-weights")
        total, n = 0.0, 0
        for r in parts.toLocalIterator():
            total, n = total + np.frombuffer(r["weights"], "<f4").astype(float) * r["n"], n + r["n"]
        if not n:
            return m, 0
        ends = np.cumsum([m[k].size for k in names])
        m = {k: x.reshape(m[k].shape).astype(np.float32) for k, x in zip(names, np.split(total / n, ends[:-1]), strict=True)}
    return m, n


def sample_windows(docs: DataFrame, tokenizer: str) -> np.ndarray:
    """Windows of ids of a bounded sample of training texts, chosen by the hash of doc_id."""
    rows = docs.filter(_training() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id").limit(SAMPLE_DOCS).select(F.col("doc_id").alias("c_id"))

    made = kernels.compiled()

    def per_batch(batches):
        for batch in batches:
            out = []
            for lo, hi in blocks(batch.column(1)):
                for cut in text_windows(batch.column(1)[lo:hi], tokenizer, made):
                    out += [w.astype("<i4").tobytes() for w in cut[np.unique(np.linspace(0, len(cut) - 1, SAMPLE_WINDOWS).astype(int))]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["w"])

    # Of the texts that share an id the one with the least hash.
    met = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("c_id")).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    got = sorted(r[0] for r in met.mapInArrow(per_batch, "w binary").collect())
    return np.frombuffer(b"".join(got), "<i4").reshape(-1, WINDOW + 1)


def build(docs: DataFrame, tokenizer: str | None = None) -> tuple[Scorer, DataFrame]:
    """``(scorer, counts)``: the fitted model, and the table of all word counts."""
    path = tokenizer or default_path()
    counts = materialise(word_counts(docs), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends")).first()
    most = [(bytes(r["word"]), r["n"]) for r in head_words(counts, sums["n"]).toLocalIterator()]
    head = pa.array([w for w, _ in most], pa.binary()), np.array([n for _, n in most], np.int64)
    pairs = materialise(subword_pairs(counts, path), "subword-pairs")
    spaced = encoder(path).spaced
    ids = subword_counts(pairs, len(spaced))
    v = Vocabulary.of(ids, spaced)
    tables = Tables.of(v, pair_counts(pairs, v), ids, sums["ends"])
    weights, _ = train(docs, path, v, tables, fit(v, tables, sample_windows(docs, path), made=kernels.compiled()))
    return Scorer(path, v, tables, weights, head, sums["ends"], sums["n"], sums["v"], kernels.compiled()), counts


def head_words(counts: DataFrame, total: int) -> DataFrame:
    """At most HEAD of the most frequent words, cut at a count that a histogram of counts gives: nothing is sorted.

    They have at most HEAD_BYTES bytes, but for the words, a thousand at most, that are a thousandth of all tokens each.
    """
    words = counts.filter("word is not null")
    short, hot = F.octet_length("word") <= HEAD_BYTES, F.col("n") >= max(1.0, total / 1000)
    often = F.floor(F.log2("n") * 64).cast("int")
    least, held = None, 0
    for r in sorted(words.filter(short).groupBy(often.alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > HEAD:
            break
        least = r["b"]
    return words.filter(hot | (short & (often >= least)) if least is not None else hot)


def score_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scorer, counts = build(docs, tokenizer)
    held = spark.sparkContext.broadcast(scorer)

    def per_batch(batches):
        for batch in grouped(batches, 2, 1_500_000):
            for lo, hi in blocks(batch.column(2), 4096, 1_500_000):
                part = batch.slice(lo, hi - lo)
                got = held.value.texts(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *got.values()], names=["row", "doc_id", *got])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialise(rows.mapInArrow(releasing(per_batch), f"row long, doc_id long, {_SCORED}"), "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "models")).alias("t")).select("row", "t.tail.word", "t.tail.times", "t.models")
    known = counts.filter("word is not null").select(F.col("word").alias("w"), "n")
    # A word that no training text has keeps the model's share only.
    share = F.lit(UNIGRAM / max(scorer.total, 1)) * F.coalesce("n", F.lit(0))
    mixed = F.when(F.col("n").isNull(), F.aggregate("models", F.lit(0.0), lambda a, m: a + m + math.log(1 - UNIGRAM))).otherwise(
        F.aggregate("models", F.lit(0.0), lambda a, m: a + F.log(F.exp(m) * (1 - UNIGRAM) + share))
    )
    met = tail.join(known, F.col("word") == F.col("w"), "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        (F.sum(mixed) / math.log(10)).alias("mixed"),
    )
    met = met.withColumnRenamed("row", "t_row")
    both = scored.drop("tail", "models").join(met, F.col("row") == F.col("t_row"), "left")
    return both.select(
        "doc_id",
        (~_training()).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.col("floor")).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
