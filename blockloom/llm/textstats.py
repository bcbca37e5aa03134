"""Whole-text statistics that the quality rules judge."""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _repeats(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """Which of the windows at ``at`` occur there twice or more, by their words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, which, count = np.unique(ids[at[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True, return_counts=True)
    return count[which.ravel()] > 1


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a UTF-8 text (null: none).

    Words are runs without ASCII white space. Repeated words are those in any window of five words found twice or more;
    windows that a 64-bit hash has in common are compared by their words.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    chars = len(text.translate(None, SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        code = h[: n - WINDOW + 1] * _ODD[0]
        for k in range(1, WINDOW):
            code += (h[k : n - WINDOW + 1 + k] ^ (h[k : n - WINDOW + 1 + k] >> np.uint64(29))) * _ODD[k]
        order = code.argsort()
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            alike = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            twice = np.zeros(len(code), bool)
            twice[alike[_repeats(words, alike)]] = True
            edge = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((edge.cumsum() > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated
