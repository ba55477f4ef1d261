"""Five-word shingles of lines, as arrays over all words of a batch of texts.

A word is hashed from prefix sums over the bytes of the batch, a window from the hashes of its words; a line of one to
four words is one window. A shingle is 57 bits of a 64-bit hash, so that a rarity of six bits fits in front of it.

Line dedup makes its sets with DataFrame functions; this form is what tests compare them with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE, BITS = 5, 57
#: Bytes of text that are taken at once; a longer text is taken alone.
CHUNK = 2 << 20
#: Bytes that are hashed at once; a longer word is hashed alone.
STEP = 1 << 18
_U = np.uint64
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = (_powers(b, STEP + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; the same bytes have the same hash wherever they are."""
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        power, inverse = (_POWER, _INVERSE) if high - low <= STEP else (_powers(_BASE, high - low), _INVERSE)
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(_CODES[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * inverse[s])
        at = to
    return out


class Lines:
    """The lines of a list of texts (bytes) that have words, and their shingles, repeats included.

    ``text`` and ``number`` say where a line is; ``line`` is the line of each shingle, by place in these.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = _SEPARATES[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        h = word_hashes(data, starts, ends)
        breaks = np.flatnonzero(data == 10)
        first = np.concatenate([[0], np.searchsorted(starts, breaks)])  # each line's first word
        count = np.diff(np.append(first, len(h)))
        per_text = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        full = np.flatnonzero(count)
        before = np.cumsum(per_text) - per_text
        self.text = np.repeat(np.arange(len(texts)), per_text)[full]
        self.number = (full - before[self.text]).astype(np.int32)
        first, count = first[full], count[full]
        line = np.repeat(np.arange(len(full)), count)
        long = np.flatnonzero(line[: max(0, len(h) - SHINGLE + 1)] == line[SHINGLE - 1 :])
        windows = np.zeros(max(0, len(h) - SHINGLE + 1), _U)
        for j in range(SHINGLE):
            windows = mixed(windows * _U(31) + h[j : j + len(windows)])
        few = np.flatnonzero(count < SHINGLE)
        short = np.zeros(len(few), _U)
        for j in range(SHINGLE - 1):
            has = count[few] > j
            short[has] = mixed(short[has] * _U(31) + h[first[few[has]] + j])
        self.line = np.concatenate([line[long], few])
        self.shingles = np.concatenate([windows[long], short]) >> _U(64 - BITS)

    def sets(self, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The lines' sets one after another, each in order of rank (by the shingle's last bits), then of shingle; and where each begins and the last ends."""
        keys = self.shingles if ranks is None else ranks[self.shingles & _U(len(ranks) - 1)].astype(_U) << _U(BITS) | self.shingles
        order = np.argsort(keys)
        line = self.line[order].astype(np.uint16 if len(self.text) < 1 << 16 else np.int64)
        order = order[np.argsort(line, kind="stable")]
        keys, line = keys[order], self.line[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
        return keys[new], np.searchsorted(line[new], np.arange(len(self.text) + 1))


def bitmaps(keys: np.ndarray, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """n words of 64 bits for each set, with the bits that its shingles choose."""
    bit = keys >> _U(16)
    one, word = _U(1) << (bit & _U(63)), bit >> _U(6) & _U(n - 1)
    for i in range(n):
        yield np.bitwise_or.reduceat(np.where(word == _U(i), one, _U(0)), starts)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if texts:
        yield at, len(texts)
