"""Per-document counts that the quality operators share, computed in numpy over whole texts."""

from __future__ import annotations

import numpy as np

from tilewright.llm import textbatch as tb

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5


def base_counts(words: tb.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = words.n_texts
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": words.per_text(words.inside & tb.LEAD[words.data]),
        "n_symbols": words.per_text(SYMBOLS[words.data]),
    }
    text_of = words.text_of
    salt = tb.mix(np.arange(1, n + 1, dtype=np.uint64))
    found, first = tb.windows(hashes, words.bounds, WINDOW)
    twice = first[tb.repeats(found ^ salt[text_of[first]])]
    step = np.bincount(twice, minlength=len(hashes) + 1) - np.bincount(twice + WINDOW, minlength=len(hashes) + 1)
    covered = np.cumsum(step[: len(hashes)]) > 0
    out["n_repeat_words"] = np.bincount(text_of, covered, n).astype(np.int64)
    starts, ends, text = tb.line_spans(words.data, words.at)
    some = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, text = starts[some], ends[some], text[some]
    keys = tb.span_hashes(words.data, starts, ends) ^ salt[text]
    _, kept = np.unique(keys, return_index=True)
    lines, distinct = np.bincount(text, minlength=n), np.bincount(text[kept], minlength=n)
    out["n_dup_lines"] = (lines - distinct).astype(np.int64)
    return out
