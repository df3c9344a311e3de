"""Linear-chain conditional random field over words, with exact batched forward-backward in numpy.

A sequence's score is the sum of word emissions (hashed affix, n-gram, shape and lexicon
features) and of label transitions. Sequences are cut into chunks that are walked side by side:
the product of a chunk's transfer matrices carries messages from chunk to chunk, so marginals
equal those of a plain forward-backward pass over the whole text, however long it is.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from zlib import crc32

import numpy as np

CHUNK = 64
#: Words whose messages are held at once while fitting.
TRAIN_WORDS = 100_000
RENORM = 8
CLIP = 40.0


class Chunks:
    """Layout of concatenated sequences as chunks, longest first."""

    def __init__(self, lengths: np.ndarray, chunk: int = CHUNK):
        lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        per = -(-lengths // chunk)
        seq = np.repeat(np.arange(len(lengths)), per)
        first = np.cumsum(per) - per
        nth = np.arange(len(seq)) - first[seq]
        begin = starts[seq] + nth * chunk
        size = np.minimum(chunk, lengths[seq] - nth * chunk)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.size, self.begin = size[order], begin[order]
        self.width = int(self.size[0]) if len(order) else 0
        self.active = [int(np.searchsorted(-self.size, -c, side="left")) for c in range(self.width)]
        # For messages between chunks: lanes of each sequence's j-th chunk, sequences with most chunks first.
        longest = np.argsort(-per, kind="stable")
        self.rounds = []
        for j in range(int(per.max()) if len(per) else 0):
            own = longest[: int(np.searchsorted(-per[longest], -j, side="left"))]
            self.rounds.append(place[first[own] + j])


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, full: bool = True) -> tuple:
    """emit (N, S) log scores of concatenated sequences; trans (S, S) and start (S,) log scores.

    Returns marginals (N, S), and per position the normalised forward message and emission times
    backward message, from which pairwise marginals follow (None each unless full).
    """
    n, s = emit.shape
    lay = Chunks(lengths)
    if not n:
        return np.zeros((0, s)), np.zeros((0, s)), np.zeros((0, s))
    flat = np.exp(np.maximum(emit.T - emit.max(axis=1), -CLIP))
    t, t0 = np.exp(trans), np.exp(start)
    tt = np.ascontiguousarray(t.T)
    lanes, width, active = len(lay.size), lay.width, lay.active
    at = np.minimum(lay.begin + np.arange(width)[:, None], n - 1)
    e = np.ascontiguousarray(flat[:, at].transpose(1, 0, 2))  # step, state, lane
    into = np.repeat(t0[:, None], lanes, axis=1)
    out = np.ones((s, lanes))
    if len(lay.rounds) > 1:
        # q[i, :, lane]: the message at a chunk's end if its first word stood in state i.
        q = np.zeros((s, s, lanes))
        for i in range(s):
            q[i, i] = e[0, i]
        for c in range(1, width):
            k = active[c]
            for i in range(s):
                q[i, :, :k] = (tt @ q[i, :, :k]) * e[c, :, :k]
            if c % RENORM == 0:
                q[:, :, :k] /= np.maximum(q[:, :, :k].max(axis=(0, 1)), 1e-300)
        q /= np.maximum(q.max(axis=(0, 1)), 1e-300)
        for here, after in zip(lay.rounds, lay.rounds[1:], strict=False):
            here = here[: len(after)]
            into[:, after] = tt @ _unit(np.einsum("sd,std->td", into[:, here], q[:, :, here]))
        for here, after in reversed(list(zip(lay.rounds, lay.rounds[1:], strict=False))):
            out[:, here[: len(after)]] = t @ _unit(np.einsum("std,td->sd", q[:, :, after], out[:, after]))
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    fwd[0] = into * e[0]
    for c in range(1, width):
        k = active[c]
        a = (tt @ fwd[c - 1, :, :k]) * e[c, :, :k]
        fwd[c, :, :k] = _unit(a) if c % RENORM == 0 else a
    for c in range(width - 1, -1, -1):
        if c + 1 < width:
            j = active[c + 1]
            b = t @ (e[c + 1, :, :j] * out[:, :j])
            out[:, :j] = _unit(b) if c % RENORM == 0 else b
        bwd[c, :, : active[c]] = out[:, : active[c]]
    real = np.arange(width)[:, None] < lay.size
    place = at[real]

    def back(x: np.ndarray) -> np.ndarray:
        y = np.empty((s, n))
        for i in range(s):
            y[i, place] = x[:, i][real]
        return _unit(y).T

    if not full:
        return back(fwd * bwd), None, None
    return back(fwd * bwd), back(fwd), back(e * bwd)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=0), 1e-300)


def pair_marginals(fwd: np.ndarray, emit_bwd: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected transition counts (S, S), summed over all sequences."""
    last = np.zeros(len(fwd), bool)
    last[np.cumsum(lengths)[np.asarray(lengths) > 0] - 1] = True
    x = fwd[:-1][~last[:-1], :, None] * np.exp(trans) * emit_bwd[1:][~last[:-1], None, :]
    return (x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)


class CRF:
    """Weights of hashed word features for each state, transitions and start scores."""

    def __init__(self, states: list, buckets: int, features: Callable[[str], list[int]], cache: int = 300_000):
        self.states, self.features, self.cache = list(states), features, cache
        s = len(self.states)
        self.w = np.zeros((buckets, s), np.float32)
        self.trans, self.start = np.zeros((s, s)), np.zeros(s)
        self._known: dict[str, int] = {}
        self._table = np.zeros((1024, s), np.float32)

    def __getstate__(self):
        return {"states": self.states, "features": self.features, "cache": self.cache, "w": self.w.astype(np.float16), "trans": self.trans, "start": self.start}

    def __setstate__(self, x):
        self.__dict__.update(x)
        self.w = x["w"].astype(np.float32)
        self._known, self._table = {}, np.zeros((1024, len(self.states)), np.float32)

    def word_scores(self, words: Iterable[str]) -> np.ndarray:
        """Emission scores (N, S) of words; each distinct word's sum is kept until the cache is full."""
        known = self._known
        if len(known) > self.cache:
            known.clear()
        get = known.get
        ids = [get(w) for w in words]
        if None in ids:
            fresh = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i is None))
            base = len(known)
            ptr, idx = self.index(fresh)
            while len(self._table) < base + len(fresh):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[base : base + len(fresh)] = self._sums(self.w, ptr, idx)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            ids = [known[w] for w in words]
        return self._table[np.array(ids, dtype=np.int64)].astype(np.float64)

    def index(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature lists as (offsets, concatenated indices)."""
        ptr, idx = np.zeros(len(words) + 1, np.int64), array("i")
        for k, w in enumerate(words):
            idx.extend(self.features(w))
            ptr[k + 1] = len(idx)
        return ptr, np.frombuffer(idx, np.int32) if idx else np.zeros(0, np.int32)

    @staticmethod
    def _sums(w: np.ndarray, ptr: np.ndarray, idx: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Sums of the rows of w that each word's features name."""
        return np.concatenate([np.add.reduceat(w[idx[ptr[a] : ptr[min(a + step, len(ptr) - 1)]]], ptr[a : min(a + step, len(ptr) - 1)] - ptr[a], axis=0) for a in range(0, len(ptr) - 1, step)])

    def marginals(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        return forward_backward(self.word_scores(words), lengths, self.trans, self.start, full=False)[0]

    def fit(self, sequences: list[tuple[list[str], list[int]]], rounds: int = 30, rate: float = 0.25, decay: float = 1e-4) -> CRF:
        """Maximise the conditional likelihood of labelled word sequences with full-batch Adam.

        sequences: (words, state numbers) pairs; empty sequences are skipped. Deterministic.
        """
        sequences = [x for x in sequences if x[0]]
        if not sequences:
            return self
        s = len(self.states)
        vocab: dict[str, int] = {}
        ids = np.array([vocab.setdefault(w, len(vocab)) for words, _ in sequences for w in words], np.int64)
        gold = np.array([y for _, labels in sequences for y in labels], np.int64)
        lengths = np.array([len(words) for words, _ in sequences])
        ptr, idx = self.index(list(vocab))
        used, idx = np.unique(idx, return_inverse=True)
        counts = np.diff(ptr)
        w = np.zeros((len(used), s))
        last = np.zeros(len(ids), bool)
        last[np.cumsum(lengths) - 1] = True
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seen = np.zeros((s, s))
        np.add.at(seen, (gold[:-1][~last[:-1]], gold[1:][~last[:-1]]), 1)
        seen0 = np.bincount(gold[first], minlength=s).astype(float)
        target = np.stack([np.bincount(ids[gold == j], minlength=len(vocab)) for j in range(s)], axis=1).astype(float)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        group = np.maximum.accumulate(bounds[:-1] // TRAIN_WORDS)
        cuts = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(lengths)]
        params = [w, self.trans.copy(), self.start.copy()]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, rounds + 1):
            table = self._sums(params[0], ptr, idx)
            expect, pairs, opened = np.zeros_like(target), np.zeros((s, s)), np.zeros(s)
            for i, j in zip(cuts, cuts[1:], strict=False):  # groups of sequences, so that messages of all words needn't be held
                words, own = ids[bounds[i] : bounds[j]], lengths[i:j]
                post, fwd, eb = forward_backward(table[words], own, params[1], params[2])
                for y in range(s):
                    expect[:, y] += np.bincount(words, weights=post[:, y], minlength=len(vocab))
                pairs += pair_marginals(fwd, eb, own, params[1])
                opened += post[np.cumsum(own) - own].sum(axis=0)
            err = target - expect
            grad = np.stack([np.bincount(idx, weights=np.repeat(err[:, y], counts), minlength=len(used)) for y in range(s)], axis=1)
            grads = [grad, seen - pairs, seen0 - opened]
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / len(ids) - decay * p / 100
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.98 * v[i] + 0.02 * g * g
                p += rate * (1 - k / (rounds + 1)) * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.98**k)) + 1e-7)
        self.w[used] = params[0]
        self.trans, self.start = params[1], params[2]
        return self


def hashed(text: str, buckets: int) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % buckets
