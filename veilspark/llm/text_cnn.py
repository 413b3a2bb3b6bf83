"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling, a logit.

A word's embedding is the sum of two rows of a table, at two hashes of its code; rows that no frequent training word
uses are zero, so unknown words say nothing. Filters slide over whole texts. Learning follows the pooled maxima, by
Adam for the dense weights and Adagrad for the table."""

from __future__ import annotations

import copy

import numpy as np

PAD = 2  # zero rows after each text: no window of up to 3 words meets two texts


class TextCnn:
    def __init__(self, bits: int = 20, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bits, self.dim, self.widths, self.filters = bits, dim, widths, filters
        self.table = np.zeros(((1 << bits) + 1, dim), np.float32)  # the last row stays zero
        self.w = [rng.normal(0, (2 / (dim * w)) ** 0.5, (w, dim, filters)).astype(np.float32) for w in widths]
        self.b = np.zeros(len(widths) * filters, np.float32)
        self.u = rng.normal(0, 0.3, len(widths) * filters).astype(np.float32)
        self.c = np.float32(0)
        self.rng = rng

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two table rows of each word code."""
        shift = np.uint64(64 - self.bits)
        return (codes >> shift).astype(np.int32), ((codes * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int32)

    def layout(self, codes: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows with pads after each text, and where each text begins."""
        size = np.diff(splits)
        begins = np.concatenate([[0], np.cumsum(size + PAD)])
        at = np.arange(len(codes)) + np.repeat(begins[:-1] - splits[:-1], size)
        one, two = (np.full(begins[-1], 1 << self.bits, np.int32) for _ in range(2))
        one[at], two[at] = self.places(codes)
        return one, two, begins

    def windows(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter values at every window that begins in x, for each width; pads count as zero."""
        out = []
        for w, width in zip(self.w, self.widths, strict=True):
            y = x @ w[0]
            for k in range(1, width):
                y[: len(y) - k] += x[k:] @ w[k]
            out.append(y)
        return out

    def pooled(self, codes: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Maxima of each filter over each text; 0 for a text without words."""
        one, two, begins = self.layout(codes, splits)
        out = np.zeros((len(splits) - 1, len(self.b)), np.float32)
        size = np.diff(splits)
        full = np.flatnonzero(size)
        if len(full):
            x = self.table[one] + self.table[two]
            cuts = np.stack([begins[full], begins[full] + size[full]], axis=1).ravel()
            z = np.concatenate(self.windows(x), axis=1)
            out[full] = np.maximum(np.maximum.reduceat(z, cuts[:-1] if cuts[-1] >= len(z) else cuts)[::2] + self.b, 0)
        return out

    def predict(self, codes: np.ndarray, splits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(codes, splits) @ self.u + self.c).astype(np.float64)))

    def start(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, least_docs: float, scale: float) -> np.ndarray:
        """Small random rows for words of at least `least_docs` texts, their first value by the word's class odds."""
        flat = np.concatenate([np.unique(d) for d in docs])
        size = [len(np.unique(d)) for d in docs]
        seen, back = np.unique(flat, return_inverse=True)
        w, y = np.repeat(weights, size), np.repeat(labels, size)
        hit, miss = np.bincount(back, w * y, len(seen)), np.bincount(back, w * (1 - y), len(seen))
        n1, n0 = max((weights * labels).sum(), 1e-9), max((weights * (1 - labels)).sum(), 1e-9)
        odds = np.log((hit + n1 / (n1 + n0)) / (n1 + 1)) - np.log((miss + n0 / (n1 + n0)) / (n0 + 1))
        often = np.argsort(hit + miss, kind="stable")
        often = often[(hit + miss)[often] >= least_docs]
        one, two = self.places(seen[often])
        rows = np.unique(np.concatenate([one, two]))
        self.table[rows] = self.rng.normal(0, 0.02, (len(rows), self.dim))
        for at in (one, two):
            self.table[at, 0] = scale * odds[often]
        return rows

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, *, weights: np.ndarray | None = None, check=None, epochs: int = 8, batch: int = 64, rate: float = 0.01, table_rate: float = 0.02, least_docs: float = 3, decay: float = 1e-3, scale: float = 0.25) -> TextCnn:
        """docs: word codes of each text. Only words of at least `least_docs` texts get embeddings.

        check: a function of self, smaller is better; the state of the best epoch stays."""
        if not len(docs):
            return self
        weights = np.ones(len(docs)) if weights is None else weights
        rows = self.start(docs, labels, weights, least_docs, scale)
        best = None
        trained = np.zeros(len(self.table), bool)
        trained[rows] = True
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.c = np.float32(np.log(share / (1 - share)))
        dense = [*self.w, self.b, self.u]
        m, v, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
        square = np.full(len(self.table), 1e-3, np.float32)
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                grads, (where, g) = self._backward([docs[i] for i in pick], labels[pick].astype(np.float32), weights[pick].astype(np.float32))
                step += 1
                for p, d, mm, vv in zip(dense, grads, m, v, strict=False):
                    d = d + decay * p
                    mm += 0.1 * (d - mm)
                    vv += 0.001 * (d * d - vv)
                    p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
                self.c -= np.float32(rate * grads[-1])
                own, back = np.unique(where, return_inverse=True)
                total = np.zeros((len(own), self.dim), np.float32)
                np.add.at(total, back, g)
                total[~trained[own]] = 0
                square[own] += (total * total).mean(axis=1)
                self.table[own] -= table_rate * total / np.sqrt(square[own])[:, None]
            if check is not None:
                value = check(self)
                if best is None or value < best[0]:
                    best = value, self.table[rows].copy(), copy.deepcopy((self.w, self.b, self.u, self.c))
        if best is not None:
            self.table[rows] = best[1]
            self.w, self.b, self.u, self.c = best[2]
        return self

    def _backward(self, docs: list[np.ndarray], y: np.ndarray, weights: np.ndarray):
        splits = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        one, two, begins = self.layout(np.concatenate(docs), splits)
        x = self.table[one] + self.table[two]
        z, f, n = self.windows(x), self.filters, len(docs)
        at = np.zeros((n, len(self.b)), np.int64)
        h = np.zeros((n, len(self.b)), np.float32)
        for i, d in enumerate(docs):
            if len(d):
                s = begins[i]
                for j, zz in enumerate(z):
                    part = zz[s : s + len(d)]
                    at[i, j * f : (j + 1) * f] = best = part.argmax(axis=0)
                    h[i, j * f : (j + 1) * f] = part[best, np.arange(f)]
                at[i] += s
        empty = np.array([not len(d) for d in docs])
        h = np.maximum(h + self.b, 0)
        h[empty] = 0
        p = 1 / (1 + np.exp(-(h @ self.u + self.c)))
        error = (weights * (p - y) / n).astype(np.float32)
        gh = error[:, None] * self.u * (h > 0)
        grads, where, moved = [], [], []
        for j, (w, width) in enumerate(zip(self.w, self.widths, strict=True)):
            g, begin = gh[:, j * f : (j + 1) * f], at[:, j * f : (j + 1) * f]
            gw = np.empty_like(w)
            for k in range(width):
                place = np.minimum(begin + k, len(x) - 1)
                gw[k] = np.einsum("bfd,bf->df", x[place], g)
                move = (g[:, :, None] * w[k].T[None]).reshape(-1, self.dim)
                where += [one[place].ravel(), two[place].ravel()]
                moved += [move, move]
            grads.append(gw)
        grads += [gh.sum(axis=0), h.T @ error, float(error.sum())]
        return grads, (np.concatenate(where), np.concatenate(moved))
