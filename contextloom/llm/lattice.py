"""The lattice of all ways to cut words into pieces of a unigram vocabulary, many words at a time.

Words are grouped by length; for a group the pieces at each place are found by hashes of code points, and the log-space
forward recursion runs over places for all words of the group at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x100000001B3)
_SEEN = 1 << 20


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, as the running hash below has it."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k] + np.uint64(1)
    return h


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Pieces with natural-log probabilities; pieces of one character and bytes make every word divisible."""

    def __init__(self, pieces: list[str], byte_ids: list[int], logp: np.ndarray):
        """byte_ids: ids of the 256 byte pieces, which are in pieces as <0x..>."""
        self.pieces, self.byte_ids, self.logp = pieces, np.array(byte_ids), logp
        skip = set(byte_ids)
        keys, ids = [], []
        self.most = 1
        for i, p in enumerate(pieces):
            if i not in skip and p:
                codes = np.array([[ord(c) for c in p]], dtype=np.uint64)
                keys.append(_mixed(_hash(codes), len(p))[0])
                ids.append(i)
                self.most = max(self.most, len(p))
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self.keys, self.ids = np.array(keys, dtype=np.uint64)[order], np.array(ids)[order]
        self.seen = np.zeros(_SEEN, dtype=bool)
        self.seen[self.keys & np.uint64(_SEEN - 1)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids of pieces by key, -1 where there is none."""
        out = np.full(len(key), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[key & np.uint64(_SEEN - 1)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == key[maybe]
            out[maybe[hit]] = self.ids[at[hit]]
        return out

    def arcs(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end j the (start, piece ids) of arcs into it; -2 - bytes stands for spelling one character in bytes."""
        n, size = codes.shape
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            h = np.zeros(n, dtype=np.uint64)
            for k in range(min(self.most, size - start)):
                h = h * _BASE + codes[:, start + k] + np.uint64(1)
                ids = self.find(_mixed(h, k + 1))
                if k == 0 or (ids >= 0).any():
                    out[start + k + 1].append((start, ids))
        return out

    def spelled(self, codes: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of characters spelled in byte pieces."""
        chars, back = np.unique(codes, return_inverse=True)
        own = np.array([logp[self.byte_ids[list(chr(int(c)).encode("utf-8", "surrogatepass"))]].sum() for c in chars])
        return own[back.ravel()]

    def _weights(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        table = np.append(self.logp, -np.inf)
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for end, arcs in enumerate(self.arcs(codes)):
            row = []
            for start, ids in arcs:
                lp = table[ids]
                if end - start == 1 and (ids < 0).any():
                    lp = lp.copy()
                    lp[ids < 0] = self.spelled(codes[ids < 0, start], self.logp)
                row.append((start, ids, lp))
            out.append(row)
        return out

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        n, size = codes.shape
        arcs, alpha = self._weights(codes), np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        with np.errstate(invalid="ignore"):
            for end in range(1, size + 1):
                for start, _, lp in arcs[end]:
                    alpha[end] = np.logaddexp(alpha[end], alpha[start] + lp)
        return alpha, arcs

    def likelihood(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability of each word, summed over its segmentations."""
        out = np.zeros(len(words))
        for at, codes in grouped(words):
            out[at] = self.forward(codes)[0][-1]
        return out

    def expected(self, words: list[str], often: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over all segmentations of all words."""
        total = np.zeros(len(self.pieces))
        for at, codes in grouped(words):
            alpha, arcs = self.forward(codes)
            size = codes.shape[1]
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            for end in range(size, 0, -1):
                for start, ids, lp in arcs[end]:
                    beta[start] = np.logaddexp(beta[start], beta[end] + lp)
                    share = np.exp(alpha[start] + lp + beta[end] - alpha[-1]) * often[at]
                    known = ids >= 0
                    total += np.bincount(ids[known], share[known], minlength=len(total))
                    if end - start == 1 and not known.all():
                        for c, s in zip(codes[~known, start].tolist(), share[~known].tolist(), strict=True):
                            np.add.at(total, self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))], s)
        return total


def grouped(words: list[str], cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of words of one length, with the word-begin mark in front; blocks of bounded size."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    edge = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, edge):
        if not len(places):
            continue
        size = int(lengths[places[0]]) + 1
        step = max(1, cells // (size * min(size, 16)))
        for k in range(0, len(places), step):
            at = places[k : k + step]
            text = "".join(SPACE + words[i] for i in at.tolist())
            yield at, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(at), size).astype(np.uint64)
