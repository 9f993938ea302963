"""Sentences of words as chains, and forward-backward over many chains at once."""

from __future__ import annotations

import numpy as np

#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
#: Words of a sentence that are walked one after the other; a longer one has several
#: blocks, walked side by side.
LONGEST = 64


def sentence_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray
                    ) -> np.ndarray:
    """Mask of the words that begin a sentence (or a text)."""
    n = len(starts)
    mask = np.zeros(n, bool)
    if n:
        marks = np.concatenate(([0], np.cumsum(ENDS[data])))
        mask[1:] = marks[starts[1:]] > marks[ends[:-1]]
        mask[first[:-1][first[:-1] < n]] = True
        mask[0] = True
    return mask


class Chains:
    """Words cut into chains at ``begins``, laid out by length, longest first.  A chain
    of more than ``longest`` words has several blocks; what passes from block to block
    is found first, so the results are those of the whole chain."""

    def __init__(self, begins: np.ndarray, longest: int = LONGEST):
        n = len(begins)
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(begins, at, 0)) if n else at
        self.first = np.flatnonzero(begins | (since % longest == 0))
        size = np.diff(np.append(self.first, n))
        order = np.argsort(-size, kind="stable")
        self.first, self.size = self.first[order], size[order]
        self.level = since[self.first] // longest  # a block's number in its chain
        self.goes_on = self.level > 0
        self.steps = int(self.size[0]) if len(size) else 0
        # chains that are longer than t stand before live[t]
        self.live = np.searchsorted(-self.size, -np.arange(self.steps), side="left")

    def carried(self, e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each block gets from the blocks before it (forward, at its last word
        before) and from those behind it (backward, at its own last word).  A block maps
        one to the other linearly: all blocks' matrices are built side by side, then
        each chain's are applied one after the other."""
        labels = e.shape[1]
        left, right = np.ones((2, len(self.first), labels))
        if not self.goes_on.any():
            return left, right
        along = np.argsort(self.first)  # blocks as they stand in the text
        before = np.empty(len(along), np.int64)
        before[along[1:]], before[along[0]] = along[:-1], -1
        several = self.goes_on.copy()
        several[before[self.goes_on]] = True
        pick = np.flatnonzero(several)
        first, size = self.first[pick], self.size[pick]
        enter = np.where(self.goes_on[pick, None, None], m, np.eye(labels))
        through = enter * e[first][:, None, :]
        for t in range(1, int(size[0])):
            k = first[:np.searchsorted(-size, -t, side="left")] + t
            step = (through[:len(k)] @ m) * e[k][:, None, :]
            through[:len(k)] = step / step.max(axis=(1, 2), keepdims=True)
        matrix = np.zeros((len(self.first), labels, labels))
        matrix[pick] = through
        by_level = np.argsort(self.level, kind="stable")
        edges = np.searchsorted(self.level[by_level], np.arange(1, self.level.max() + 2))
        levels = [by_level[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for own in levels:
            out = (left[before[own]][:, None, :] @ matrix[before[own]])[:, 0]
            left[own] = out / out.sum(axis=1, keepdims=True)
        for own in levels[::-1]:
            out = (matrix[own] @ right[own][:, :, None])[:, :, 0]
            right[before[own]] = out / out.sum(axis=1, keepdims=True)
        return left, right

    def marginals(self, emit: np.ndarray, move: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of every word, expected moves between labels and
        the chains' log partition sums.  emit: log scores, words x labels."""
        labels = emit.shape[1]
        top = emit.max(axis=1, keepdims=True) if len(emit) else emit
        e, m = np.exp(emit - top), np.exp(move)
        left, right = self.carried(e, m)
        forward = np.zeros_like(e)
        log_z, a = float(top.sum()), None
        for t in range(self.steps):
            k = self.first[:self.live[t]] + t
            a = (a[:len(k)] @ m) * e[k] if t else np.where(self.goes_on[:, None], left @ m, 1.0) * e[k]
            scale = a.sum(axis=1, keepdims=True)
            a = a / scale
            log_z += float(np.log(scale).sum())
            forward[k] = a
        out, moved = forward.copy(), np.zeros((labels, labels))
        last = self.first + self.size - 1
        out[last] = forward[last] * right

        def moves(k: np.ndarray, b: np.ndarray) -> np.ndarray:
            onward = b @ m.T
            z = (forward[k] * onward).sum(axis=1, keepdims=True)
            moved[:] += (forward[k] / z).T @ b * m
            return onward

        b = np.zeros((0, labels))
        for t in range(self.steps - 2, -1, -1):
            k = self.first[:self.live[t + 1]] + t
            b = np.concatenate((b, right[len(b):len(k)])) * e[k + 1]
            onward = moves(k, b)
            b = onward / onward.sum(axis=1, keepdims=True)
            out[k] = forward[k] * b
        if self.goes_on.any():  # moves from block to block
            b = np.concatenate((b, right[len(b):]))[self.goes_on]
            k = self.first[self.goes_on]
            moves(k - 1, b * e[k])
        out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
        return out, moved, log_z

    def best(self, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The most likely label of every word, by Viterbi (chains of one block)."""
        if self.goes_on.any():
            raise ValueError("Viterbi takes chains that are not cut into blocks")
        out = np.zeros(len(emit), np.int64)
        came = np.zeros(emit.shape, np.int64)
        tops: list[np.ndarray] = []
        a = emit[self.first]
        for t in range(1, self.steps):
            n = self.live[t]
            tops.append(a[n:])  # chains that ended
            k = self.first[:n] + t
            through = a[:n, :, None] + move
            came[k] = through.argmax(axis=1)
            a = through.max(axis=1) + emit[k]
        tops.append(a)
        label = np.concatenate(tops[::-1]).argmax(axis=1) if self.steps else out
        for t in range(self.steps - 1, -1, -1):
            n = self.live[t]
            k = self.first[:n] + t
            out[k] = label[:n]
            label[:n] = came[k, label[:n]]
        return out


def adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """Adam on ``params`` in place; gradient(step) gives one array for each."""
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        for p, g, (m, v) in zip(params, gradient(step), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
