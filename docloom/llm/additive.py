"""Additive quantisation of vectors: training, beam-search encoding, lookup-table scores.

A vector is approximated by the sum of one codeword from each of several
full-dimensional codebooks, each of its own size. Training starts from residual
k-means and then alternates beam-search encoding with least squares, one book at
a time: given the codes and the other books, the best word of a code is the mean
of what the others leave of its vectors. Plain NumPy over one batch;
``neighbours`` runs it inside Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEAM = 4
#: How many vectors' worth the present word counts in its own mean: words of unused codes stay as they are.
PRIOR = 1.0


@dataclass(frozen=True)
class Codebooks:
    """``words``: an array (codewords, dimension) for each book; the words of the first book name the lists."""

    words: tuple[np.ndarray, ...]

    @property
    def books(self) -> int:
        return len(self.words)

    @property
    def lists(self) -> int:
        return len(self.words[0])

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Dot products of queries with the words of each book: (queries, codewords)."""
        return [queries @ book.T for book in self.words]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.words[0][codes[:, 0]].copy()
        for b in range(1, self.books):
            out += self.words[b][codes[:, b]]
        return out


def means(data: np.ndarray, codes: np.ndarray, present: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """The mean of the vectors of each code, the present word counting ``prior`` times; codes without vectors keep their word."""
    order = np.argsort(codes, kind="stable")
    used, first, sizes = np.unique(codes[order], return_index=True, return_counts=True)
    out = present.copy()
    if len(used):
        sums = np.add.reduceat(data[order], first, axis=0)
        out[used] = (sums + prior * present[used]) / (sizes[:, None] + prior)
    return out


def _nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(data @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def _k_means(data: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = data[rng.choice(len(data), size=k, replace=len(data) < k)].copy()
    for _ in range(rounds):
        nearest = _nearest(data, centres)
        centres = means(data, nearest, centres)
        empty = np.flatnonzero(np.bincount(nearest, minlength=k) == 0)
        if len(empty):
            centres[empty] = data[rng.choice(len(data), size=len(empty))]
    return centres


def encode(data: np.ndarray, books: Codebooks, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search: after each book the ``beam`` best partial sums stay.

    What a choice costs follows from dot products of the data with the words and
    of words with words, so no residual vector is ever formed.
    """
    n = len(data)
    codes = np.zeros((n, 1, 0), dtype=np.int32)
    # Of each partial sum: its cost without the data's own norm, |sum|^2 - 2 data.sum.
    cost = np.zeros((n, 1), dtype=np.float32)
    rows = np.arange(n)[:, None]
    for b, book in enumerate(books.words):
        step = (book**2).sum(axis=1) - 2 * (data @ book.T)
        total = cost[:, :, None] + step[:, None, :]
        for a in range(b):
            total += 2 * (books.words[a] @ book.T)[codes[:, :, a]]
        flat = total.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(flat, best, axis=1)
        order = cost.argsort(axis=1, kind="stable")
        best, cost = np.take_along_axis(best, order, axis=1), np.take_along_axis(cost, order, axis=1)
        entry, word = best // len(book), best % len(book)
        codes = np.concatenate([codes[rows, entry], word[:, :, None].astype(np.int32)], axis=2)
    return codes[:, 0, :]


def train(data: np.ndarray, lists: int, codewords: int, books: int, rounds: int = 2, seed: int = 7) -> Codebooks:
    """Codebooks from a sample: ``lists`` codewords in the first book, ``codewords`` in each other one."""
    rng = np.random.default_rng(seed)
    data = np.ascontiguousarray(data, dtype=np.float32)
    words, rest = [], data.copy()
    for b in range(books):
        centres = _k_means(rest, lists if b == 0 else codewords, rng)
        rest -= centres[_nearest(rest, centres)]
        words.append(centres)
    for _ in range(rounds):
        codes = encode(data, Codebooks(tuple(words)))
        rest = data - Codebooks(tuple(words)).decode(codes)
        for b in range(books):
            own = rest + words[b][codes[:, b]]
            words[b] = means(own, codes[:, b], words[b], PRIOR).astype(np.float32)
            rest = own - words[b][codes[:, b]]
    return Codebooks(tuple(w.astype(np.float32) for w in words))
