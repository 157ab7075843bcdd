"""Likeness of texts by their matching blocks: twice the letters in common blocks over the letters of both. Many pairs are compared at once."""

from __future__ import annotations

import numpy as np


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters [text, place] as numbers, and lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(sizes.max(initial=0)))), np.int64)
    inside = np.arange(out.shape[1]) < sizes[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, sizes


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """Letters in common blocks of each pair: the longest block that both have, the earliest in the first and then in the second text, and so on in what is left and right of it in both.

    All stretches of all pairs that are still to be compared take one step together.
    """
    (a, n), (b, m) = _codes(first), _codes(second)
    total = np.zeros(len(first), np.int64)
    open_ = np.stack([np.arange(len(first)), np.zeros(len(first), np.int64), n, np.zeros(len(first), np.int64), m])
    while True:
        open_ = open_[:, (open_[1] < open_[2]) & (open_[3] < open_[4])]
        if not open_.shape[1]:
            return total
        pair, a0, a1, b0, b1 = open_
        at = np.arange(b.shape[1])
        inside = (at >= b0[:, None]) & (at < b1[:, None])
        run, size, ends = np.zeros((len(pair), b.shape[1]), np.int64), np.zeros(len(pair), np.int64), np.zeros((2, len(pair)), np.int64)
        for i in range(int(a0.min()), int(a1.max())):
            same = (b[pair] == a[pair, i][:, None]) & inside & ((i >= a0) & (i < a1))[:, None]
            run = np.where(same, np.pad(run[:, :-1], ((0, 0), (1, 0))) + 1, 0)
            best = run.argmax(axis=1)  # the first of equals
            longest = run[np.arange(len(pair)), best]
            better = longest > size
            size[better], ends[0, better], ends[1, better] = longest[better], i + 1, best[better] + 1
        np.add.at(total, pair, size)
        found = size > 0
        left = np.stack([pair, a0, ends[0] - size, b0, ends[1] - size])[:, found]
        right = np.stack([pair, ends[0], a1, ends[1], b1])[:, found]
        open_ = np.concatenate([left, right], axis=1)


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of each pair, 0 to 1; two empty texts are alike. The order of the texts in a pair matters where blocks tie."""
    size = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], float)
    return np.where(size > 0, 2.0 * matched(first, second) / np.maximum(size, 1), 1.0)


class Names:
    """A closed list of names, asked for the one most like a text."""

    def __init__(self, names: list[str]):
        self.names = names
        self.sizes = np.array([len(n) for n in names], np.int64)
        held: dict[str, dict[int, int]] = {}
        for i, name in enumerate(names):
            for c in name:
                held.setdefault(c, {}).setdefault(i, 0)
                held[c][i] += 1
        self.letters = {c: (np.fromiter(d, np.int64), np.fromiter(d.values(), np.int64)) for c, d in held.items()}

    def able(self, text: str, least: float) -> np.ndarray:
        """Places of the names that have enough letters of text to be as like it as least: no block holds a letter more often than both."""
        shared = np.zeros(len(self.names), np.int64)
        for c in set(text):
            if c in self.letters:
                names, counts = self.letters[c]
                shared[names] += np.minimum(counts, text.count(c))
        return np.flatnonzero(2.0 * shared >= least * (self.sizes + len(text)) - 1e-9)

    def nearest(self, texts: list[str], least: float) -> list[str | None]:
        """For each text the name most like it, the first of equals, if it is as like it as least. Only names that share enough letters with a text are compared with it."""
        some = [self.able(t, least) for t in texts]
        which = np.repeat(np.arange(len(texts)), [len(s) for s in some])
        names = np.concatenate([np.zeros(0, np.int64), *some])
        out: list[str | None] = [None] * len(texts)
        best = np.full(len(texts), -1.0)
        for at in range(0, len(names), 20_000):
            own, name = which[at : at + 20_000], names[at : at + 20_000]
            for t, n, r in zip(own, name, ratios([texts[i] for i in own], [self.names[i] for i in name]), strict=True):
                if r >= least and r > best[t]:
                    best[t], out[t] = r, self.names[n]
        return out
