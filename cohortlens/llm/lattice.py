"""Lattices of vocabulary pieces over words: matching, log-space forward sums and expected piece counts.

A word is written with a leading mark (U+2581), as the public vocabulary does. Its lattice has an edge for each piece
that matches a substring; a character that no piece holds gets one edge made of its UTF-8 bytes' pieces. All words of a
batch are worked on together: edges are ordered by the position where they end, so one pass adds up every segmentation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

MARK = "▁"
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a public vocabulary file; `ids` are the file's ids, `prior` log-probabilities by position.

    The file orders its pieces by rank and has no probabilities; the prior gives rank r a weight of 1 / (r + 1).
    """

    pieces: list[str]
    ids: np.ndarray
    byte_ids: np.ndarray
    prior: np.ndarray

    @property
    def size(self) -> int:
        """Number of weights: the pieces, then 256 bytes."""
        return len(self.pieces) + 256


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """The file is read on the driver; its size bounds whatever is made from it."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, bytes_ = [], [], np.zeros(256, np.int32)
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            bytes_[int(p.id_to_piece(i)[3:-1], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i)):
            pieces.append(p.id_to_piece(i))
            ids.append(i)
    rank = np.arange(len(pieces) + 256) + 1.0
    prior = -np.log(rank)
    return Vocabulary(pieces, np.array(ids, np.int32), bytes_, prior - np.log(np.exp(prior).sum()))


class Matcher:
    """A trie as sorted arrays: the key node * n_chars + char leads to the next node."""

    def __init__(self, pieces: Sequence[str]):
        chars = sorted({c for p in pieces for c in p})
        index = {c: i for i, c in enumerate(chars)}
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        self.n_pieces, self.longest, n = len(pieces), max(map(len, pieces)), len(chars)
        nodes: dict[int, int] = {}
        piece_at = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for c in p:
                key = node * n + index[c]
                node = nodes.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = k
        self.keys = np.array(sorted(nodes), np.int64)
        self.next = np.array([nodes[k] for k in self.keys.tolist()], np.int32)
        self.piece_at = np.array(piece_at, np.int32)
        self.single = np.array([self.piece_at[nodes.get(i, 0)] for i in range(n)], np.int32)

    def lattice(self, words: Sequence[str]) -> Lattice:
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(length)])
        word = np.repeat(np.arange(len(words)), length)
        at = np.searchsorted(self.chars, codes)
        at[at == len(self.chars)] = 0
        known = self.chars[at] == codes
        cls = np.where(known, at, -1)
        end = first[1:][word]
        idx, node = np.flatnonzero(known), None
        starts, pieces, sizes = [], [], []
        for size in range(1, self.longest + 1):
            if size > 1:
                keep = idx + size - 1 < end[idx]
                idx, node = idx[keep], node[keep]
            c = cls[idx + size - 1]
            key = c if node is None else node * np.int64(len(self.chars)) + c
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            hit = (self.keys[found] == key) & (c >= 0)
            idx, node = idx[hit], self.next[found[hit]].astype(np.int64)
            if not len(idx):
                break
            p = self.piece_at[node]
            whole = p >= 0
            starts.append(idx[whole])
            pieces.append(p[whole])
            sizes.append(np.full(int(whole.sum()), size, np.int64))
        lone = np.flatnonzero(~known | (self.single[np.where(known, at, 0)] < 0))
        starts.append(lone)
        pieces.append(np.full(len(lone), -1, np.int32))
        sizes.append(np.ones(len(lone), np.int64))
        start, piece, size = np.concatenate(starts), np.concatenate(pieces), np.concatenate(sizes)
        w = word[start]
        key = (start - first[w] + size) * (self.longest + 1) + size
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        start, piece, size, w, key = start[order], piece[order], size[order], w[order], key[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        spelt = [(i, list(chr(codes[start[i]]).encode("utf-8", "surrogatepass"))) for i in np.flatnonzero(piece < 0).tolist()]
        return Lattice(len(words), first, start + w, start + w + size, piece, w, cut, spelt, self.n_pieces)


@dataclass
class Lattice:
    """Edges in the order of their end. `start` and `end` index states; word w has the states first[w] + w onwards."""

    n_words: int
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    cut: np.ndarray
    spelt: list[tuple[int, list[int]]]
    n_pieces: int

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        """log_p has a row for each piece and then for each byte; one or more columns."""
        out = log_p[np.maximum(self.piece, 0)]
        for i, bytes_ in self.spelt:
            out[i] = sum(log_p[self.n_pieces + b] for b in bytes_)
        return out

    def forward(self, weight: np.ndarray) -> np.ndarray:
        alpha = np.full((len(self.first) + int(self.first[-1]), *weight.shape[1:]), -np.inf)
        alpha[self.first[:-1] + np.arange(self.n_words)] = 0
        for a, b in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            t = self.end[a:b]
            alpha[t] = np.logaddexp(alpha[t], alpha[self.start[a:b]] + weight[a:b])
        return alpha

    def marginal(self, log_p: np.ndarray) -> np.ndarray:
        """Each word's log-probability, summed over all of its segmentations."""
        alpha = self.forward(self.weights(log_p))
        return alpha[self.first[1:] + np.arange(self.n_words)]

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and byte, if each word occurs `times` often (forward-backward)."""
        weight = self.weights(log_p)
        alpha = self.forward(weight)
        last = self.first[1:] + np.arange(self.n_words)
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0
        for a, b in zip(self.cut[-2::-1].tolist(), self.cut[:0:-1].tolist(), strict=True):
            s = self.start[a:b]
            beta[s] = np.logaddexp(beta[s], beta[self.end[a:b]] + weight[a:b])
        share = np.exp(alpha[self.start] + weight + beta[self.end] - alpha[last][self.word]) * times[self.word]
        out = np.bincount(np.maximum(self.piece, 0), np.where(self.piece < 0, 0, share), self.n_pieces + 256)
        for i, bytes_ in self.spelt:
            for b in bytes_:
                out[self.n_pieces + b] += share[i]
        return out


def smoothed(counts: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Log-probabilities from counts, with the prior counted as `strength` further uses."""
    p = counts + strength * np.exp(prior)
    return np.log(p / p.sum())
