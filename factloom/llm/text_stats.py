"""Statistics of one text, on its UTF-8 bytes. Words are runs of bytes other than space and \\x09-\\x0D."""

from __future__ import annotations

import numpy as np

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_WORD_CHAR = _SPACE + _CONTINUATION
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_PUNCTUATION = b"!?.,;:"
WINDOW = 8
_ODD = np.random.default_rng(20240501).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Positions covered by 8-word windows that occur at least twice. Hashes only propose; the words themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += hashes[j : j + n] * _ODD[j]
    h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    in_run = np.zeros(n, bool)
    in_run[order[1:][same]] = True
    in_run[order[:-1][same]] = True
    starts = np.flatnonzero(in_run).tolist()
    count: dict[tuple, int] = {}
    keys = [tuple(words[i : i + WINDOW]) for i in starts]
    for key in keys:
        count[key] = count.get(key, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, key in zip(starts, keys, strict=True) if count[key] > 1], np.int64)
    if not len(at):
        return 0
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


#: Order of the columns that measure() gives.
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_punctuation", "n_exclaim", "n_same_as_last", "n_distinct", "n_pipes")


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = repeated_words(words, hashes)
    return (
        n, len(text.translate(None, _NOT_WORD_CHAR)), without(_SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines),
        without(_UPPER), without(_LETTERS), without(_DIGITS), without(_PUNCTUATION), text.count(b"!"),
        int(np.count_nonzero(hashes[1:] == hashes[:-1])), len(set(words)), text.count(b"|"),
    )


def measure_all(texts: list[bytes]) -> np.ndarray:
    """One row of FIELDS for each text."""
    return np.array([measure(t) for t in texts], np.int64).reshape(len(texts), len(FIELDS))


def ratios(m: np.ndarray) -> np.ndarray:
    """Shares that don't depend on length, smoothed so that short texts stay near zero."""
    m = m.astype(float)
    words, letters, lines = m[:, 0], m[:, 7], m[:, 5]
    share = lambda part, whole, prior: part / (whole + prior)
    return np.stack([
        np.log1p(share(m[:, 2], words, 10) * 20), share(m[:, 3], lines, 3), share(m[:, 4], words, 10), share(m[:, 6], letters, 60),
        np.log1p(share(m[:, 10], words, 10) * 20), share(m[:, 11], words, 10), share(m[:, 13], words, 10),
    ], axis=1)
