"""Lattices of vocabulary pieces over words, summed over all segmentations in log space.

A word is a space and its bytes; a piece that begins with the space can only come first. All words
of a batch go through the vocabulary's trie in lockstep, which gives the arcs; the forward recursion
then adds up, byte by byte, the weights of all paths of all words at once. The backward recursion
gives each arc's share of its word, for expected counts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from .bytebpe import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"


@dataclass
class Pieces:
    """A vocabulary as a trie: child[node, byte class]; piece[node] is a piece's number or -1."""

    names: list[bytes]
    first: np.ndarray  # whether the piece begins a word
    rank: np.ndarray  # its place by the vocabulary's own score, from 0
    classes: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    longest: int  # bytes of the longest piece


@functools.cache
def load_pieces(path: str | None = None) -> Pieces:
    """The pieces of a sentencepiece model in lower case (A-Z), spaces for its word mark, and every single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path(VOCABULARY))
    scored: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        name = model.id_to_piece(i).replace("▁", " ").encode().lower()
        if b" " not in name[1:]:
            scored[name] = max(scored.get(name, -1e18), model.get_score(i))
    for b in range(256):
        scored.setdefault(bytes([b]), -1e17)
    names = sorted(scored)
    order = sorted(range(len(names)), key=lambda i: (-scored[names[i]], names[i]))
    rank = np.zeros(len(names), np.int64)
    rank[order] = np.arange(len(names))
    classes = np.zeros(256, np.int32)
    used = sorted({b for n in names if len(n) > 1 for b in n})
    for k in range(256):
        classes[k] = k
    nodes: dict[bytes, int] = {b"": 0}
    for n in names:
        for k in range(1, len(n) + 1):
            nodes.setdefault(n[:k], len(nodes))
    # bytes that only occur alone share a column beyond the others' and are looked up apart
    column = {b: i for i, b in enumerate(used)}
    classes = np.array([column.get(b, len(used)) for b in range(256)], np.int32)
    child = np.zeros((len(nodes), len(used) + 1), np.int32)
    piece = np.full(len(nodes), -1, np.int32)
    index = {n: i for i, n in enumerate(names)}
    for n, at in nodes.items():
        if n and n[-1] in column:
            child[nodes[n[:-1]], column[n[-1]]] = at
        piece[at] = index.get(n, -1)
    return Pieces(names, np.array([n[:1] == b" " for n in names]), rank, classes, child, piece, max(map(len, names)))


class Arcs:
    """The arcs of the lattices of many words, ordered by the place where they end."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.pieces, n = pieces, len(words)
        data = np.frombuffer(b" " + b" ".join(words) + b"\0", np.uint8)
        size = np.fromiter(map(len, words), np.int64, n) + 1
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        total = int(size.sum())
        stop = np.repeat(self.end, size)
        word = np.repeat(np.arange(n), size)
        single = np.array([pieces.names.index(bytes([b])) for b in range(256)]) if not hasattr(pieces, "single") else pieces.single
        pieces.single = single
        start, node = np.arange(total), np.zeros(total, np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(pieces.longest):
            live = start + k < stop[start]
            start, node = start[live], node[live]
            if not len(start):
                break
            node = pieces.child[node, pieces.classes[data[start + k]]]
            if k == 0:
                found.append((start, start + 1, single[data[start]]))
            live = node > 0
            start, node = start[live], node[live]
            if k:
                p = pieces.piece[node]
                hit = p >= 0
                found.append((start[hit], start[hit] + k + 1, p[hit]))
        self.start, self.stop, self.piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.local = self.stop - self.begin[word[self.start]] if total else self.stop
        order = np.lexsort((self.stop, self.local))
        self.start, self.stop, self.piece, self.local = self.start[order], self.stop[order], self.piece[order], self.local[order]
        # places are numbered so that each word has one more place than bytes
        self.word = word[self.start]
        self.source, self.target = self.start + self.word, self.stop + self.word
        self.origin, self.goal, self.places = self.begin + np.arange(n), self.end + np.arange(n), total + n

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log weight of all paths from each word's origin to each place; logp by piece, or by piece and model."""
        alpha = np.full((self.places, *logp.shape[1:]), -np.inf)
        alpha[self.origin] = 0.0
        edges = np.flatnonzero(np.diff(self.local, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            to = self.target[a:b]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[first]] = np.logaddexp.reduceat(alpha[self.source[a:b]] + logp[self.piece[a:b]], first, axis=0)
        return alpha

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """Log weight of all paths from each place to its word's end."""
        beta = np.full(self.places, -np.inf)
        beta[self.goal] = 0.0
        local = self.source - self.origin[self.word]
        order = np.lexsort((self.source, -local))
        source, target, piece, key = self.source[order], self.target[order], self.piece[order], local[order]
        edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = source[a:b]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            beta[at[first]] = np.logaddexp.reduceat(beta[target[a:b]] + logp[piece[a:b]], first)
        return beta

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece, words counted by weight; and the weighted log probability of the words."""
        alpha, beta = self.forward(logp), self.backward(logp)
        whole = alpha[self.goal]
        share = np.exp(alpha[self.source] + logp[self.piece] + beta[self.target] - whole[self.word]) * weight[self.word]
        return np.bincount(self.piece, weights=share, minlength=len(self.pieces.names)), float((whole * weight).sum())


def scores_as_weights(pieces: Pieces) -> np.ndarray:
    """The vocabulary's own scores, which only order its pieces, as weights 1 / (rank + 100)."""
    return 1.0 / (pieces.rank + 100.0)


def normalised(pieces: Pieces, weight: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """Log probabilities of pieces from their (expected) counts, and that of a word's end.

    A word is one first piece, then other pieces, then its end: each of the two draws sums to 1.
    Every piece keeps a little mass, shared out by the vocabulary's own scores.
    """
    weight = weight + scores_as_weights(pieces) / scores_as_weights(pieces).sum() * max(1.0, 0.001 * words)
    first, other = weight[pieces.first].sum(), weight[~pieces.first].sum()
    return np.log(np.where(pieces.first, weight / first, weight / (other + words))), float(np.log(words / (other + words)))


def batches(words: list[bytes], size: int = 1 << 17):
    """Slices of words of about size bytes."""
    at = 0
    while at < len(words):
        n, end = 0, at
        while end < len(words) and (end == at or n + len(words[end]) < size):
            n, end = n + len(words[end]) + 1, end + 1
        yield at, end
        at = end
