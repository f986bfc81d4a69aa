"""Numbers of a whole text for classifiers: hashed words and structure, worked out on its bytes with numpy."""

from __future__ import annotations

import numpy as np

BUCKETS = 512

# kinds of bytes
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[33:127] = 5  # other marks
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[ord(c) for c in "#*$%&|<>"]] = 4
_KINDS[[ord(c) for c in ".,;:'\"-()"]] = 6
_KINDS[[ord(c) for c in "!?"]] = 7
_KINDS[128:] = 8
_KINDS[:9] = _KINDS[14:32] = _KINDS[127] = 9  # control characters
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(5)
# a random number for each letter at each place of a word; marks count nothing, capitals as small letters
_LETTERS = _rng.integers(1, 1 << 63, (32, 256), dtype=np.uint64)
_LETTERS[:, (_KINDS >= 4) & (_KINDS <= 7)] = 0
_LETTERS[:, ord("A") : ord("Z") + 1] = _LETTERS[:, ord("a") : ord("z") + 1]

NAMES = (
    "log_words log_chars blank small capital digit symbol mark stop shout wide control word_length word_spread distinct top_word "
    "twice_running symbol_end shout_end lines_per_word dup_lines longest_word no_stop short_lines"
).split()


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a text in UTF-8."""
    a = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _BLANK[a], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(a)))
    place = (np.arange(starts[0], len(a)) - np.repeat(starts, sizes)) & 31
    body = a[starts[0] :]
    value = _LETTERS[place, body]
    value[_BLANK[body]] = 0
    return starts, ends, np.add.reduceat(value, starts - starts[0])


def structure(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shares and sizes, each about 0 to 1, in the order of ``NAMES``."""
    a = np.frombuffer(data, np.uint8)
    n, words = max(len(a), 1), max(len(starts), 1)
    kinds = np.bincount(_KINDS[a], minlength=10) / n
    length = (ends - starts) if len(starts) else np.zeros(1)
    unique, times = np.unique(hashes, return_counts=True) if len(hashes) else (hashes, np.zeros(1))
    last = _KINDS[a[ends - 1]] if len(ends) else np.zeros(1, np.uint8)
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    return np.array(
        [
            np.log1p(len(starts)) / 10, np.log1p(len(a)) / 12, *kinds,
            min(length.mean() / 20, 2), min(length.std() / 20, 2), len(unique) / words, times.max() / words,
            (np.count_nonzero(hashes[1:] == hashes[:-1]) / words) if len(hashes) > 1 else 0.0,
            np.count_nonzero(last == 4) / words, np.count_nonzero(last == 7) / words,
            min(len(filled) / words, 1), (len(filled) - len(set(filled))) / max(len(filled), 1),
            min(length.max() / 100, 2), 1 - min(1.0, 10 * np.count_nonzero(last == 6) / words),
            sum(len(x) < 40 for x in filled) / max(len(filled), 1),
        ]
    )


def vector(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Structure, then square roots of the shares of words per bucket."""
    starts, ends, hashes = word_table(data)
    tf = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets) / max(len(hashes), 1)
    return np.concatenate([structure(data, starts, ends, hashes), np.sqrt(tf)]).astype(np.float32)
