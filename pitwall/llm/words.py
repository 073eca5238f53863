"""Words of many texts at once, as arrays: borders and 64-bit hashes without a step for each word.

A buffer of bytes is cut into words by a table of blank bytes. A word is hashed eight bytes at a time, all words side by side;
fingerprints of windows of equal width come from prefix sums of a polynomial modulo 2**64 and do not depend on where the window stands.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Texts are handled in groups of about so many bytes; one longer text is a group of its own.
GROUP_BYTES = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


LETTERS = mixed(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


class Fingerprints:
    """Position-independent fingerprints of all windows of a buffer."""

    def __init__(self):
        self.powers = self.inverses = np.zeros(0, dtype=_U)

    def of(self, body: np.ndarray, letters: np.ndarray = LETTERS) -> Fingerprints:
        n = len(body)
        if len(self.powers) < n:
            self.powers = np.cumprod(np.full(n, _BASE, dtype=_U))
            self.inverses = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=_U))
        self.sums = np.zeros(n + 1, dtype=_U)
        terms = letters[body]
        terms *= self.powers[:n]
        np.cumsum(terms, out=self.sums[1:])
        return self

    def at(self, positions: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[positions + width] - self.sums[positions]) * self.inverses[positions] + np.asarray(width).astype(_U))


#: Bytes of white space between words: 9 to 13 and 32.
SPACE = np.zeros(256, dtype=bool)
SPACE[[*range(9, 14), 32]] = True
#: ASCII letters in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)


def run_hashes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes buffer[start : start + size], equal for equal runs."""
    padded = np.zeros(len(buffer) + 8, dtype=np.uint8)
    padded[: len(buffer)] = buffer
    eight = np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mixed((eight[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(_U) << _U(56)))
    long = np.flatnonzero(sizes > 8)
    done = 8
    while len(long):
        at = starts[long] + done
        out[long] = mixed(out[long] * _U(_BASE) + (eight[at] & _MASKS[np.minimum(sizes[long] - done, 8)]))
        done += 8
        long = long[sizes[long] > done]
    return out


def borders(buffer: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``blank``."""
    inside = np.zeros(len(buffer) + 2, dtype=bool)
    np.logical_not(blank[buffer], out=inside[1:-1])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return at[0::2], at[1::2]


class TextWords:
    """Word hashes of texts, ASCII lower-cased; memory follows GROUP_BYTES or the longest text."""

    def groups(self, data, at):
        """(first text, word hashes, first word of each text and the end) for groups of neighbouring texts."""
        i, n = 0, len(at) - 1
        whole = np.frombuffer(data, dtype=np.uint8)
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + GROUP_BYTES, side="right")) - 1)
            j = min(j, n)
            lo = int(at[i])
            body = LOWER[whole[lo : int(at[j])]]
            starts, ends = borders(body, SPACE)
            inner = np.asarray(at[i : j + 1], dtype=np.int64) - lo
            # A border between texts ends a word, too.
            crossing = np.searchsorted(starts, inner[1:-1], side="left")
            cut = inner[1:-1][(crossing > 0) & (ends[np.maximum(crossing - 1, 0)] > inner[1:-1])] if len(starts) else inner[:0]
            if len(cut):
                cut = np.unique(cut)
                starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
            yield i, run_hashes(body, starts, ends - starts), np.searchsorted(starts, inner, side="left")
            i = j

    def each(self, data, at):
        """(text number, its word hashes)."""
        for first, hashes, cuts in self.groups(data, at):
            for k in range(len(cuts) - 1):
                yield first + k, hashes[cuts[k] : cuts[k + 1]]
