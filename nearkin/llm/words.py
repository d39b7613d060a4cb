"""Words of many documents at once, and rolling hashes of them, in numpy.

A word's hash is mixed from its bytes, eight at a time; a long word's is XXH64. Hashes of runs of words are
polynomials of the words' hashes modulo 2**64 in an odd base, so that of any run is a difference of two prefix
sums. Such polynomials collide on some long runs of two words, so what depends on them is compared by words.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .shared import own

U = np.uint64
#: Odd bases and multipliers; any odd numbers do.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
LENGTH = U(0xC2B2AE3D27D4EB4F)
#: Words of more than eight times so many bytes are hashed by XXH64; which bytes of eight a word of so many has.
CHUNKS = 8
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

#: ASCII white space: 0x09 to 0x0D and 0x20.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def own_words() -> None:
    """The operators of this module's hashes keep the powers from task to task."""
    own("words", _powers.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        _powers[base] = have = tuple(_row(b, size) for b in (base, pow(base, -1, 1 << 64)))
    return have[0][:n], have[1][:n]


def _row(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times the base's powers, from 0."""
    terms = values.astype(U)
    terms *= powers(base, len(values))[0]
    out = np.zeros(len(values) + 1, U)
    np.cumsum(terms, out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs from starts to ends."""
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts] + (ends - starts).astype(U) * LENGTH)


class Words:
    """The words of documents that lie one after another in `data`; document d has data[offsets[d]:offsets[d + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD):
        """classes: of each byte, false between words; a change of class also ends a word if there are several."""
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        kind = classes[self.data]
        n = len(kind)
        begins = np.zeros(n + 1, bool)
        begins[1:n] = kind[1:] != kind[:-1]
        begins[self.offsets] = True
        at = np.flatnonzero(begins[:n])
        ends = np.append(at[1:], n)
        real = kind[at] != 0 if n else np.zeros(0, bool)
        self.starts, self.ends = at[real], ends[real]
        self.firsts = np.searchsorted(self.starts, self.offsets)  # of each document, its first word; then the number of words
        self.counts = np.diff(self.firsts)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes and length."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        h = mix(eight[self.starts] & MASKS[np.minimum(size, 8)] ^ size.astype(U) * LENGTH)
        at = np.flatnonzero(size > 8)
        for chunk in range(1, CHUNKS):
            if not len(at):
                break
            left = size[at] - 8 * chunk
            h[at] = mix(h[at] ^ eight[self.starts[at] + 8 * chunk] & MASKS[np.minimum(left, 8)])
            at = at[left > 8]
        for k in at.tolist():
            h[k] = xxhash.xxh64_intdigest(self.data[self.starts[k] : self.ends[k]])
        return h

    def run(self, a: int, b: int) -> bytes:
        """The words from a to b, joined by one space."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())
