"""Words of texts as rows of a byte matrix, and what numpy computes over such rows. Used inside tasks and,
for models fitted on a bounded sample, on the driver; none of it touches Spark."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: A-Z lower-cased, every other ASCII character but a-z made a space; bytes of other characters stay.
LETTERS = bytes((i + 32 if 65 <= i <= 90 else i) if 65 <= i <= 90 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters (and of non-ASCII characters), A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def byte_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as zero-padded rows of bytes, and their lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    width = int(n.max(initial=0))
    flat = np.frombuffer(b"".join(words), np.uint8)
    m = np.zeros((len(words), width), np.uint8)
    m[np.arange(width) < n[:, None]] = flat
    return m, n


def window_hashes(m: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of each row's runs of ``size`` bytes, by first byte."""
    out = np.full((m.shape[0], max(0, m.shape[1] - size + 1)), U(size), U)
    for j in range(size):
        out = out * BASE + m[:, j : j + out.shape[1]] + U(1)
    return out


def prefix_hashes(m: np.ndarray) -> np.ndarray:
    """Polynomial hashes (mod 2**64, from zero) of each row's first bytes, by their number."""
    out = np.zeros((m.shape[0], m.shape[1] + 1), U)
    for j in range(m.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + m[:, j] + U(1)
    return out


def run_hashes(before: np.ndarray, upto: np.ndarray, size: int) -> np.ndarray:
    """``window_hashes`` of runs of ``size`` bytes from the prefix hashes at their ends."""
    power = U(pow(int(BASE), size, 1 << 64))
    return upto + (U(size) - before) * power


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Pieces:
    """The pieces of a fixed vocabulary, looked up by hash; a bit table turns most misses away."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = sorted(set(map(len, pieces)))
        self.longest = self.lengths[-1]
        keys = np.concatenate([finished(window_hashes(byte_matrix([p])[0], len(p))[0]) for p in pieces])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> U(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of the raw hashes, -1 where there is none."""
        h = finished(h)
        out = np.full(h.shape, -1, np.int64)
        maybe = np.flatnonzero(self.bits[h >> U(44)])
        at = np.searchsorted(self.keys, h[maybe])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == h[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out


class Trie:
    """Distinct sorted words as a trie: the node of a prefix is owned by the first word that has it."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        self.m, self.n = byte_matrix(self.words)
        same = np.zeros(self.m.shape, bool)
        same[1:] = (self.m[1:] == self.m[:-1]) & (np.arange(self.m.shape[1]) < self.n[:-1, None])
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # bytes in common with the word before
        depth = np.arange(self.m.shape[1] + 1)
        mine = shared[:, None] < depth
        self.owner = np.maximum.accumulate(np.where(mine, np.arange(len(self.words))[:, None], 0), axis=0)
        self.new = mine & (depth <= self.n[:, None])

    def lattice(self, pieces: Pieces):
        """Per depth: the rows that own a node there, and per piece length that ends there the places in these rows,
        the owners of the node where the piece starts, and the piece. Each shared prefix comes once."""
        runs = prefix_hashes(self.m)
        for d in range(1, self.m.shape[1] + 1):
            rows = np.flatnonzero(self.new[:, d])
            found = []
            for size in pieces.lengths:
                if size > d:
                    break
                ids = pieces.find(run_hashes(runs[rows, d - size], runs[rows, d], size))
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    found.append((size, at, self.owner[rows[at], d - size], ids[at]))
            yield d, rows, found
