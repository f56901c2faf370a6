"""Unigram lattices of words over a public piece vocabulary: marginal log probabilities and expected piece counts.

A word is the piece vocabulary's word mark (here one space byte) and the word's bytes. Every way to cut it into pieces is a path; the probability of
the word is the sum over all paths of the product of their pieces' probabilities, by forward recursion in log space. Single bytes are always pieces.
Words of equal length are computed together; lengths that few words have go one by one.
"""

from __future__ import annotations

import functools
import math
import os
from dataclasses import dataclass, field

import numpy as np

VOCABULARY = "piece_bpe_32k.model"
SLOT_BITS = 18
FEW = 24
GROUP = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Vocabulary:
    """Surfaces of the pieces as bytes, and their slots by hash."""

    surfaces: list[bytes]
    rank: np.ndarray
    numbers: dict[bytes, int] = field(default_factory=dict)
    longest: int = 1

    def __post_init__(self):
        self.numbers = {s: k for k, s in enumerate(self.surfaces)}
        self.longest = max(map(len, self.surfaces), default=1)
        self.key, self.slot = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        mask = (1 << SLOT_BITS) - 1
        for k, s in enumerate(self.surfaces):
            h = 0
            for b in s:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            at = ((h * int(_STIR)) & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)
            while self.slot[at] >= 0:
                at = (at + 1) & mask
            self.key[at], self.slot[at] = h, k

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = ((h * _STIR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.key[at] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << SLOT_BITS) - 1)
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.key[at[open_]] != h[open_])]
        return out


@functools.cache
def vocabulary(folder: str | None = None) -> Vocabulary:
    """The public vocabulary without control pieces and pieces that no lower-case word can hold whole; bytes fill what is missing."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, VOCABULARY) if folder else public_tokenizers.path(VOCABULARY))
    best: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k):
            continue
        text, score = model.id_to_piece(k), -model.get_score(k)
        surface = bytes([int(text[3:5], 16)]) if model.is_byte(k) else text.replace("▁", " ").encode()
        if b" " in surface[1:] or any(65 <= b <= 90 for b in surface):
            continue
        score = float(model.get_piece_size()) if model.is_byte(k) else score
        best[surface] = min(score, best.get(surface, math.inf))
    surfaces = sorted(best)
    return Vocabulary(surfaces, np.array([best[s] for s in surfaces]))


def first_weights(vocab: Vocabulary) -> np.ndarray:
    """Natural log weights by the vocabulary's own scores. They are merge ranks, taken as Zipf ranks."""
    p = 1 / (vocab.rank + 3)
    return np.log(p / p.sum())


def _groups(lengths: np.ndarray, models: int = 1):
    """Rows of equal length, fewer at once for more models."""
    most = max(FEW, GROUP * 8 // max(8, models))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, edges):
        yield from (part[k : k + most] for k in range(0, len(part), most))


def _pieces(vocab: Vocabulary, letters: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """letters: positions by words. For each (start, end) that some word has a piece for: the piece of each word, or -1."""
    size, n = letters.shape
    out = {}
    for start in range(size):
        h = np.zeros(n, np.uint64)
        for end in range(start + 1, min(size, start + vocab.longest) + 1):
            h = h * _BASE + letters[end - 1] + np.uint64(1)
            found = vocab.find(h)
            if (found >= 0).any():
                out[start, end] = found
    return out


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(parts)
    most = stacked.max(0)
    return most + np.log(np.exp(stacked - most).sum(0))


def _letters(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The word mark, then the bytes, positions by words."""
    out = np.empty((size + 1, len(starts)), np.uint64)
    out[0] = 32
    out[1:] = data[starts[None, :] + np.arange(size)[:, None]]
    return out


def log_probabilities(vocab: Vocabulary, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability under each row of weights: rows by words."""
    out = np.empty((len(weights), len(starts)))
    wide = np.hstack((weights, np.full((len(weights), 1), -np.inf)))  # of piece -1
    for rows in _groups(ends - starts, len(weights)):
        size = int(ends[rows[0]] - starts[rows[0]])
        if len(rows) < FEW:
            for k in rows:
                word = b" " + data[starts[k] : ends[k]].tobytes()
                out[:, k] = [one(vocab, w, word)[-1] for w in weights]
            continue
        pieces = _pieces(vocab, _letters(data, starts[rows], size))
        alpha = [np.zeros((len(weights), len(rows)))]
        for end in range(1, size + 2):
            alpha.append(_log_sum([alpha[start] + wide[:, pieces[start, end]] for start in range(max(0, end - vocab.longest), end) if (start, end) in pieces]))
        out[:, rows] = alpha[-1]
    return out


def one(vocab: Vocabulary, weights: np.ndarray, word: bytes) -> list[float]:
    """The forward log sums of one word, mark included."""
    alpha = [0.0]
    for end in range(1, len(word) + 1):
        parts = [alpha[start] + weights[k] for start in range(max(0, end - vocab.longest), end) if (k := vocab.numbers.get(word[start:end])) is not None]
        most = max(parts)
        alpha.append(most + math.log(sum(math.exp(p - most) for p in parts)))
    return alpha


def expected_counts(vocab: Vocabulary, weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur `times` times, under the weights (forward-backward)."""
    out = np.zeros(len(weights) + 1)
    wide = np.append(weights, -np.inf)
    for rows in _groups(ends - starts):
        size = int(ends[rows[0]] - starts[rows[0]]) + 1
        if len(rows) < FEW:
            for k in rows:
                _one_expected(vocab, weights, b" " + data[starts[k] : ends[k]].tobytes(), times[k], out)
            continue
        pieces = _pieces(vocab, _letters(data, starts[rows], size - 1))
        alpha = [np.zeros(len(rows))]
        for end in range(1, size + 1):
            alpha.append(_log_sum([alpha[start] + wide[pieces[start, end]] for start in range(max(0, end - vocab.longest), end) if (start, end) in pieces]))
        beta = [None] * size + [np.zeros(len(rows))]
        for start in range(size - 1, -1, -1):
            beta[start] = _log_sum([beta[end] + wide[pieces[start, end]] for end in range(start + 1, min(size, start + vocab.longest) + 1) if (start, end) in pieces])
        for (start, end), found in pieces.items():
            share = np.exp(alpha[start] + wide[found] + beta[end] - alpha[-1]) * times[rows]
            out += np.bincount(found + 0, share, len(out)) if (found >= 0).all() else np.bincount(np.where(found < 0, len(weights), found), share, len(out))
    return out[:-1]


def _one_expected(vocab: Vocabulary, weights: np.ndarray, word: bytes, times: float, out: np.ndarray) -> None:
    alpha, size = one(vocab, weights, word), len(word)
    beta = [0.0] * (size + 1)
    for start in range(size - 1, -1, -1):
        parts = []
        for end in range(start + 1, min(size, start + vocab.longest) + 1):
            k = vocab.numbers.get(word[start:end])
            if k is not None:
                parts.append(beta[end] + weights[k])
                out[k] += times * math.exp(min(0.0, alpha[start] + parts[-1] - alpha[-1]))
        most = max(parts)
        beta[start] = most + math.log(sum(math.exp(p - most) for p in parts))

