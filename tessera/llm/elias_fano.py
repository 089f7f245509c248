"""A level of a trie as an Elias-Fano sequence: the upper bits are the monotone pointers, the lower bits the words.

The sequence holds (context << bits) | word in ascending order. Its upper part, coded in unary, tells where each context's
words begin and end (a pointer is the place of a zero among the ones); its lower part is packed. A query goes to the range
that its context's pointers give and looks for the first word not below it there. All searches are vectorised and read the
arrays where they lie, which may be memory-mapped files.
"""

from __future__ import annotations

import numpy as np

_ONE, _ALL, RATE = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), 16
#: Blocks of RATE zeros that span more words than this keep the places of all their zeros.
LONG = 24


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _in_byte() -> np.ndarray:
    """Place of the r-th set bit of byte b, at r << 8 | b."""
    out = np.zeros((8, 256), np.uint8)
    for b in range(256):
        for r, at in enumerate(i for i in range(8) if b >> i & 1):
            out[r, b] = at
    return out.ravel()


_BYTE, _EACH, _TOPS = _in_byte(), np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_B1, _B2, _B4 = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _select(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word, by the counts of set bits up to each of its bytes."""
    r = r.astype(np.uint64)
    upto = x - (x >> _ONE & _B1)
    upto = (upto & _B2) + (upto >> np.uint64(2) & _B2)
    upto = (upto + (upto >> np.uint64(4)) & _B4) * _EACH
    at = np.bitwise_count((r * _EACH | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)  # bytes that end before it
    r -= upto << np.uint64(8) >> at & np.uint64(255)
    return (at + _BYTE[r << np.uint64(8) | x >> at & np.uint64(255)]).astype(np.int64)


class EliasFano:
    """n values, ascending. low: packed low bits; high: unary sizes of the contexts; samples: place of every 16th zero of
    high; far, far_at: the zeros of long blocks and their places."""

    PARTS = ("head", "low", "high", "samples", "far", "far_at")

    def __init__(self, n: int, words: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, far: np.ndarray, far_at: np.ndarray) -> None:
        self.n, self.words, self.bits = n, words, max(0, words - 1).bit_length()
        self.low, self.high, self.samples, self.far, self.far_at = low, high, samples, far, far_at

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, contexts: int, words: int) -> EliasFano:
        """Of pairs in ascending order; 0 <= context < contexts, 0 <= word < words."""
        n, bits = len(word), max(0, words - 1).bit_length()
        flags = np.zeros(n + contexts + 2 * RATE, np.uint8)
        flags[context.astype(np.int64) + np.arange(n)] = 1
        zeros = np.flatnonzero(flags == 0)
        samples = zeros[::RATE]
        span = np.diff(samples, append=len(flags)) // 64
        far = np.flatnonzero(np.repeat(span > LONG, RATE)[: len(zeros)])
        small = np.uint32 if len(flags) < 1 << 32 else np.uint64
        packed = np.packbits(flags, bitorder="little")
        high = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), "<u8")
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            where, shift, v = at >> 6, (at & 63).astype(np.uint64), word.astype(np.uint64)
            _or_at(low, where, v << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            _or_at(low, where[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
        return cls(n, words, low, high, samples.astype(small), far.astype(small), zeros[far].astype(small))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": np.array([self.n, self.words], np.uint64)} | {k: getattr(self, k) for k in self.PARTS[1:]}

    @classmethod
    def load(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(*(int(x) for x in a["head"]), *(a[k] for k in cls.PARTS[1:]))

    def word(self, i: np.ndarray) -> np.ndarray:
        """Words at indexes i."""
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        where, shift = at >> 6, (at & 63).astype(np.uint64)
        v = self.low[where] >> shift
        rest = np.flatnonzero(shift > np.uint64(64 - self.bits))
        v[rest] |= self.low[where[rest] + 1] << (np.uint64(64) - shift[rest])
        return v & np.uint64((1 << self.bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place in high of the k-th (from 0) zero."""
        out = np.empty(len(k), np.int64)
        live = np.arange(len(k))
        if len(self.far):
            at = np.minimum(np.searchsorted(self.far, k), len(self.far) - 1)
            known = self.far[at] == k
            out[known] = self.far_at[at[known]]
            live = live[~known]
            k = k[live]
        start = self.samples[k // RATE].astype(np.int64)
        left, word = k % RATE, start >> 6
        zeros = ~self.high[word] & (_ALL << (start & 63).astype(np.uint64))
        have = _popcount(zeros)
        go = np.flatnonzero(left >= have)
        have = have[go]
        while len(go):  # on to the next word
            rest, at = left[go] - have, word[go] + 1
            here = ~self.high[at]
            left[go], word[go], zeros[go] = rest, at, here
            have = _popcount(here)
            more = rest >= have
            go, have = go[more], have[more]
        out[live] = (word << 6) + _select(zeros, left)
        return out

    def bounds(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of each context's words, by its pointers."""
        k = context.astype(np.int64)
        before = np.where(k > 0, self._zero(np.maximum(k - 1, 0)), -1)
        after, word, live = np.empty(len(k), np.int64), (before + 1) >> 6, np.arange(len(k))
        zeros = ~self.high[word] & (_ALL << ((before + 1) & 63).astype(np.uint64))
        for _ in range(3):  # most ranges end in the word in which they begin or the next one
            here = zeros != 0
            z = zeros[here]
            after[live[here]] = (word[here] << 6) + _popcount((z & (~z + _ONE)) - _ONE)
            live, word = live[~here], word[~here] + 1
            if not len(live):
                break
            zeros = ~self.high[word]
        if len(live):
            after[live] = self._zero(k[live])
        return before - k + 1, after - k

    def find(self, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word >= word in its range, whether it is equal). The index may be end."""
        index, equal = begin.copy(), np.zeros(len(begin), bool)
        live = np.flatnonzero(begin < end)
        a, b, want = begin[live], end[live], word[live].astype(np.uint64)
        # words are numbered by hash, so a context's words are spread evenly
        size = b - a
        mid = a + np.minimum((size * np.minimum(want.astype(np.float64) / self.words, 1.0)).astype(np.int64), size - 1)
        less, a, b = self._halved(live, a, b, want, mid, equal)
        # the place lies near: a second probe brackets it
        reach = (2.0 * np.sqrt(size)).astype(np.int64) + 2
        probe = np.where(less, mid + reach, mid - reach)
        near = np.flatnonzero((probe >= a) & (probe < b))
        _, a[near], b[near] = self._halved(live[near], a[near], b[near], want[near], probe[near], equal)
        while True:
            more = a < b
            over = ~more
            index[live[over]] = a[over]
            live, a, b, want = live[more], a[more], b[more], want[more]
            if not len(live):
                return index, equal
            _, a, b = self._halved(live, a, b, want, (a + b) >> 1, equal)

    def _halved(self, live: np.ndarray, a: np.ndarray, b: np.ndarray, want: np.ndarray, mid: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the word at mid is less, a, b): ranges cut at mid, closed where the word is found, which is noted in equal."""
        got = self.word(mid)
        less, same = got < want, got == want
        equal[live[same]] = True
        return less, np.where(less, mid + 1, np.where(same, mid, a)), np.where(less, b, mid)


def _or_at(out: np.ndarray, where: np.ndarray, values: np.ndarray) -> None:
    """out[where] |= values for ascending where with repeats."""
    if not len(where):
        return
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    out[where[first]] |= np.bitwise_or.reduceat(values, first)
