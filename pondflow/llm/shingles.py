"""Word and shingle hashes of whole Arrow batches, in numpy.

Words are runs of bytes between separators (space and 0x09-0x0D unless others are
given), with A-Z lower-cased. A
word's 64-bit hash is read off a running polynomial over the batch's bytes, so no
Python string is made; a document's shingles are the distinct hashes of its runs of
``k`` words (or of its whole word sequence when it has fewer than ``k``).
Work goes through pieces of a few MB cut at separators, so a very long text needs
no more memory than its words' hashes.
"""

from __future__ import annotations

import numpy as np

from pondflow.llm.common import GOLDEN, mix

PIECE = 2 << 20  # bytes hashed at a time

_BYTES = np.arange(256, dtype=np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
with np.errstate(over="ignore"):
    _VALUE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * GOLDEN) | np.uint64(1)
_BASE = np.uint64(0xA24BAED4963EE407)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Separators for matching passages: every ASCII byte that is no letter or digit.
NOT_WORD = ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90))
             | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128))


def fold_latin(raw: np.ndarray) -> np.ndarray:
    """Bytes with the two-byte capitals of Latin-1 (C3 80 to C3 9E, but not the sign C3 97) lower-cased."""
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
    out = raw.copy()
    out[at] += 0x20
    return out


class Hasher:
    """``separators``: which bytes end a word. The tables of powers are one pair for all hashers of a worker."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, separators: np.ndarray = _SPACE):
        self.separators = separators

    @classmethod
    def _grow(cls, n: int) -> None:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray):
        """Byte ranges of about PIECE bytes that end at a document's end or at a separator."""
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi = lo + PIECE
            if hi >= end:
                yield lo, end
                return
            cut = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if cut <= lo:  # inside one long document: cut at its next separator
                stop = int(offsets[np.searchsorted(offsets, hi, "right")])
                cut = hi
                while cut < stop:
                    found = np.flatnonzero(self.separators[raw[cut:min(cut + PIECE, stop)]])
                    if len(found):
                        cut += int(found[0])
                        break
                    cut = min(cut + PIECE, stop)
            yield lo, cut
            lo = cut

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, first word of every document and the end) for a batch."""
        hashes, starts = [], []
        for lo, hi in self._pieces(raw, offsets):
            piece = raw[lo:hi]
            self._grow(len(piece) + 1)
            inside = ~self.separators[piece]
            heads = np.empty(len(piece), bool)
            heads[0] = True
            heads[1:] = ~inside[:-1]
            edges = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
            heads[edges] = True
            begin = np.flatnonzero(inside & heads)
            tails = np.empty(len(piece), bool)
            tails[-1] = True
            tails[:-1] = ~inside[1:]
            tails[edges[edges > 0] - 1] = True
            stop = np.flatnonzero(inside & tails) + 1
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUE[piece] * self.up[:len(piece)], out=total[1:])
            hashes.append(mix((total[stop] - total[begin]) * self.down[begin]))
            starts.append(begin + lo)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts = np.concatenate(starts)
        return np.concatenate(hashes), np.searchsorted(starts, offsets)

    def shingles(self, raw: np.ndarray, offsets: np.ndarray, k: int = 5):
        """The sorted distinct shingle hashes of each document of a batch, one array each."""
        words, first = self.words(raw, offsets)
        weights = mix((np.arange(1, k + 1, dtype=np.uint64)) * GOLDEN) | np.uint64(1)
        runs = max(len(words) - k + 1, 0)
        joined = np.zeros(runs, np.uint64)
        for j in range(k):
            joined += words[j:j + runs] * weights[j]
        joined = mix(joined + np.uint64(k))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                s = np.sort(joined[a:b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(np.array([np.sum(words[a:b] * weights[:b - a]) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_name(shingles: np.ndarray) -> np.uint64:
    """One 64-bit name of a shingle set."""
    return mix(np.array([np.sum(mix(shingles ^ GOLDEN)) + np.uint64(len(shingles))], np.uint64))[0]
