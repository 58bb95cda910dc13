"""Elias-Fano sequences and the two-level n-gram trie built of them, with vectorised queries.

All arrays of a trie live in one file that is memory-mapped; queries take arrays of targets at once.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_U = np.uint64
#: Bits of a word's key below its context in the trie's second level.
WORD_BITS = 40
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _rank] = _bit


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other, in 64-bit words (one spare at the end)."""
    bits = len(values) * width
    out = np.zeros(bits // 64 + 2, "<u8")
    if not width:
        return out
    shifts = np.arange(width, dtype=_U)
    raw = out.view(np.uint8)
    step = 1 << 16  # a multiple of 8 values ends on a whole byte
    for i in range(0, len(values), step):
        block = (values[i : i + step, None] >> shifts & _U(1)).astype(np.uint8)
        packed = np.packbits(block.ravel(), bitorder="little")
        raw[i * width // 8 : i * width // 8 + len(packed)] = packed
    return out


def read_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), _U)
    at = index.astype(_U) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
    return (low | high) & _U((1 << width) - 1)


class EliasFano:
    """A monotone sequence of n values below ``universe``: low bits packed, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self._ends: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(_U)
        marks = (values >> _U(width)).astype(np.int64) + np.arange(n)
        size = n + (universe >> width) + 1
        high = np.zeros(size // 64 + 1, "<u8")
        np.bitwise_or.at(high, marks >> 6, _U(1) << (marks & 63).astype(_U))
        clear = 64 - np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(clear)]).astype("<i8")
        return cls(n, width, pack_bits(values, width), high, zeros)

    @property
    def ends(self) -> np.ndarray:
        """By bucket of high bits, the index after its last value: the select directory of the clear bits, made at the
        first bulk query."""
        if self._ends is None:
            clear = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)
            self._ends = (clear - np.arange(len(clear))).astype(np.int32 if self.n < 1 << 31 else np.int64)
        return self._ends

    def successor(self, targets: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the least value >= target, looked for from ``first`` up to ``last``, and whether it equals it."""
        targets = targets.astype(_U)
        bucket = (targets >> _U(self.width)).astype(np.int64)
        end = self.ends[bucket].astype(np.int64)
        start = np.where(bucket > 0, self.ends[bucket - 1], 0).astype(np.int64)
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        stop = end.copy()
        want = targets & _U((1 << self.width) - 1)
        busy = np.flatnonzero(start < stop)
        while len(busy):
            mid = (start[busy] + stop[busy]) >> 1
            less = read_bits(self.low, mid, self.width) < want[busy]
            start[busy[less]] = mid[less] + 1
            stop[busy[~less]] = mid[~less]
            busy = busy[start[busy] < stop[busy]]
        equal = start < end
        at = np.flatnonzero(equal)
        equal[at] = read_bits(self.low, start[at], self.width) == want[at]
        return start, equal

    def values(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places (select on the set bits by their running count)."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, index, "right") - 1
        rest = index - ones[word]
        bits = self.high[word]
        place = np.zeros(len(index), np.int64)
        open_ = np.ones(len(index), bool)
        for i in range(8):
            part = (bits >> _U(8 * i) & _U(255)).astype(np.int64)
            count = np.bitwise_count(part.astype(np.uint8)).astype(np.int64)
            here = open_ & (rest < count)
            place[here] = word[here] * 64 + 8 * i + _SELECT[part[here], rest[here]]
            open_ &= ~here
            rest = np.where(open_, rest - count, rest)
        return ((place - index).astype(_U) << _U(self.width)) | read_bits(self.low, index, self.width)


#: Probabilities are kept as 16-bit steps of their logarithm down to 10**-SPAN, rounded down so that sums stay below 1.
SPAN = 9.0
_STEPS = 65534


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for none; else 1 to 65535, the largest step not above p."""
    with np.errstate(divide="ignore"):
        code = np.floor((np.log10(p) + SPAN) / SPAN * _STEPS + 1e-9) + 1
    return np.where(code >= 1, code, 0).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 1) / _STEPS * SPAN - SPAN), 0.0)


class Trie:
    """Contexts, pointers to their successors, successors, and quantised probabilities, memory-mapped from one file.

    Level one holds the sorted context keys and the monotone pointers; level two holds, for each context, the sorted keys
    of its successors, made monotone over all contexts by the context's rank in front. A query finds the context's rank,
    then searches the successor inside that context's range of pointers.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray, probabilities: np.ndarray, weights: np.ndarray) -> None:
        """contexts: sorted keys below 2**63; counts: successors of each; words: their keys below 2**WORD_BITS, sorted
        within each context; probabilities by word; weights: the back-off weight by context."""
        ranks = np.repeat(np.arange(len(contexts), dtype=_U), counts)
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(_U)
        levels = (
            EliasFano.of(contexts, 1 << 63),
            EliasFano.of(pointers, len(words) + 1),
            EliasFano.of((ranks << _U(WORD_BITS)) | words.astype(_U), max(len(contexts), 1) << WORD_BITS),
        )
        arrays = [a for x in levels for a in (x.low, x.high, x.zeros)] + [quantise(probabilities), quantise(weights)]
        handle, path = tempfile.mkstemp(prefix="trie-")
        places = []
        with os.fdopen(handle, "wb") as f:
            for a in arrays:
                places.append(f.tell())
                f.write(a.tobytes() + bytes(-a.nbytes % 8))
            self.bytes = f.tell()
        mapped = [
            np.memmap(path, a.dtype, "r", place, a.shape) if a.size else a for a, place in zip(arrays, places)
        ]
        os.unlink(path)  # the mapping keeps the file's content; nothing is left behind if the worker dies
        self.levels = [EliasFano(x.n, x.width, *mapped[3 * i : 3 * i + 3]) for i, x in enumerate(levels)]
        self.codes, self.weights = mapped[9], mapped[10]

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the contexts and whether they are there."""
        return self.levels[0].successor(contexts)

    def query(self, ranks: np.ndarray, there: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Quantised probabilities of words: ``counts`` words for each context, whose rank and presence are given. 0 where
        the pair is unknown."""
        out = np.zeros(len(words), "<u2")
        ranks = np.where(there, ranks, 0)
        pointers = self.levels[1]
        if not len(self.codes) or not len(words):
            return out
        first, last = pointers.values(ranks).astype(np.int64), pointers.values(ranks + 1).astype(np.int64)
        last[~there] = first[~there]
        bases = np.repeat(ranks.astype(_U) << _U(WORD_BITS), counts)
        index, equal = self.levels[2].successor(bases | words.astype(_U), np.repeat(first, counts), np.repeat(last, counts))
        out[equal] = self.codes[index[equal]]
        return out
