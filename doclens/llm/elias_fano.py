"""Monotone sequences in Elias-Fano form, and an n-gram trie made of them.

All parts of a trie lie in one buffer, which can be written to a file and mapped into memory;
opening it copies nothing but a directory of the high bits.
"""

from __future__ import annotations

import json
import mmap

import numpy as np


class EliasFano:
    """A non-decreasing sequence of n integers below `universe`: low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        unary = np.unpackbits(high, bitorder="little")
        #: Number of values below each value of the high bits.
        zeros = np.flatnonzero(unary == 0)
        self.begin = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.uint32 if n < 1 << 32 else np.int64)
        self._ones: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        top = (v >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(n + (universe >> bits) + 2, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        if rest := len(high) * 8 - len(unary):  # padding holds no zeros
            high[-1] |= (0xFF << (8 - rest)) & 0xFF
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift, x = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), v & np.uint64((1 << bits) - 1)
            for w, part in ((word, x << shift), (word + 1, np.where(shift > 64 - bits, x >> ((np.uint64(64) - shift) & np.uint64(63)), 0).astype(np.uint64))):
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                low[w[first]] |= np.bitwise_or.reduceat(part, first)
        return n, bits, low, high

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), 0).astype(np.uint64)
        return ((self.low[word] >> shift) | over) & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if self._ones is None:
            ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
            self._ones = ones.astype(np.uint32 if len(self.high) < 1 << 29 else np.int64)
        return ((self._ones[i].astype(np.int64) - i) << self.bits) | self.lows(i).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it isn't: a bucket of the high bits, then binary search among its low bits."""
        top, want = x >> self.bits, (x & ((1 << self.bits) - 1)).astype(np.uint64)
        lo, hi = self.begin[top].astype(np.int64), self.begin[top + 1].astype(np.int64)
        end, out = hi, np.full(len(x), -1, np.int64)
        live = np.flatnonzero(lo < hi)
        low, high, goal = lo[live], hi[live], want[live]
        while len(live):
            mid = (low + high) >> 1
            less = self.lows(mid) < goal
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            more = low < high
            done = ~more
            lo[live[done]] = low[done]
            live, low, high, goal = live[more], low[more], high[more], goal[more]
        at = np.flatnonzero(lo < end)
        ok = at[self.lows(lo[at]) == want[at]]
        out[ok] = lo[ok]
        return out


#: Probabilities are held as 16-bit multiples of this part of log10, on one grid for all tries: what a shard holds doesn't move it.
STEP = 2.0**-12


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities, in steps."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Trigrams (left, middle, right) of the middle words of one shard.

    middles -> successors (with probabilities), middles -> lefts (contexts, with back-off weights), and contexts ->
    successors, written as their positions among the successors of the middle word: context-relative ids, of which every
    context's make one ascending run in one monotone sequence.
    """

    SEQUENCES = ("next", "context", "third", "next_at", "third_base")
    ARRAYS = ("count", "p2", "b2", "p3", "b3")

    def __init__(self, buffer):
        size = int.from_bytes(bytes(buffer[:8]), "little")
        head = json.loads(bytes(buffer[8 : 8 + size]))
        self.n = head["n"]
        part = lambda k: np.frombuffer(buffer, np.dtype(head["at"][k][2]), head["at"][k][1], head["at"][k][0])
        for k in self.ARRAYS:
            setattr(self, k, part(k))
        for k in self.SEQUENCES:
            n, bits = head["ef"][k]
            setattr(self, k, EliasFano(n, bits, part(k + ".low"), part(k + ".high")))

    @staticmethod
    def build(m: np.ndarray, left: np.ndarray, r: np.ndarray, c: np.ndarray, ended: np.ndarray, n: tuple[int, int, int], discount: float = 0.75, whole: tuple[np.ndarray, ...] | None = None) -> bytes:
        """Distinct training trigrams as ids below n = (middles, lefts, rights), in order of (m, left, r), and their counts. ended: nothing follows; r is then no word.

        whole: of middles that stand here in part only, (middles, counts, which are the tokens that follow, too; distinct ones that follow) and their bigrams (m * rights + r, in order; counts).
        """
        nm, nl, nr = n
        count = np.bincount(m, c, nm).astype(np.int64)
        goes = ~ended
        key = m * nl + left
        contexts, back = np.unique(key, return_inverse=True)
        total3 = np.bincount(back[goes], c[goes], len(contexts))
        types3 = np.bincount(back[goes], minlength=len(contexts))
        pairs, to_pair = np.unique((m * nr + r)[goes], return_inverse=True)
        c2 = np.bincount(to_pair, c[goes], len(pairs))
        if whole:
            *of_middles, wpairs, wc2 = whole
            held, held_c2 = pairs, c2
            pairs = np.union1d(held, wpairs)
            c2 = np.zeros(len(pairs))
            c2[np.searchsorted(pairs, held)] = held_c2
            c2[np.searchsorted(pairs, wpairs)] = wc2
            to_pair = np.searchsorted(pairs, held)[to_pair]
        pm = pairs // nr
        degree = np.bincount(pm, minlength=nm)
        total2, types2 = np.bincount(pm, c2, nm), degree
        if whole:
            wm, wcount, wtypes = of_middles
            types2 = degree.copy()
            count[wm], total2[wm], types2[wm] = wcount, wcount, wtypes
        p2 = (c2 - discount) / total2[pm] if len(pairs) else np.zeros(0)
        start = np.concatenate([[0], np.cumsum(degree)])
        base = np.concatenate([[0], np.cumsum(degree[contexts // nl])]) if len(contexts) else np.zeros(1, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            b2 = np.where(total2 > 0, discount * types2 / total2, 1.0)
            b3 = np.where(total3 > 0, discount * types3 / total3, 1.0)
        ctx = back[goes]
        third = base[ctx] + to_pair - start[m[goes]]
        p3 = (c[goes] - discount) / total3[ctx] + b3[ctx] * p2[to_pair] if len(ctx) else np.zeros(0)
        codes = {k: quantised(v) for k, v in (("p2", p2), ("b2", b2), ("p3", p3), ("b3", b3))}
        sequences = {"next": (pairs, nm * nr + 1), "context": (contexts, nm * nl + 1), "third": (third, int(base[-1]) + 1), "next_at": (start, len(pairs) + 1), "third_base": (base, int(base[-1]) + 1)}
        parts, ef = {"count": count}, {}
        for k, (v, u) in sequences.items():
            size, bits, parts[k + ".low"], parts[k + ".high"] = EliasFano.encode(v, int(u))
            ef[k] = (size, bits)
        parts |= codes
        at, offset = {}, 0
        for k, v in parts.items():
            at[k] = (offset, len(v), v.dtype.str)
            offset += -(-v.nbytes // 8) * 8
        head = {"n": n, "ef": ef}
        room = -(-(len(json.dumps(head | {"at": {k: (10**12, *v[1:]) for k, v in at.items()}})) + 8) // 8) * 8
        text = json.dumps(head | {"at": {k: (v[0] + room, *v[1:]) for k, v in at.items()}}).encode().ljust(room - 8)
        out = bytearray((room - 8).to_bytes(8, "little") + text + bytes(offset))
        for k, v in parts.items():
            out[room + at[k][0] : room + at[k][0] + v.nbytes] = v.tobytes()
        return bytes(out)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """In anonymous mapped memory: no folder of a machine is needed."""
        m = mmap.mmap(-1, len(data))
        m[:] = data
        return cls(m)

    @classmethod
    def open(cls, path: str) -> Trie:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def score(self, m: np.ndarray, left: np.ndarray, r: np.ndarray, first: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For trigrams: (-log10, in steps, of what the right word has but for its unigram probability if it never followed the middle, whether the middle's own unigram probability counts, the middle's training count).

        first: left is no word, the middle begins a text.
        """
        nm, nl, nr = self.n
        out = np.zeros(len(m), np.int64)
        # Trigrams come in order, those of a context together: each context is looked up once.
        key = m * nl + left
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        context = self.context.find(key[new])[np.cumsum(new) - 1]
        alone = first | (context < 0)
        pair = np.where(ended, -1, self.next.find(m * nr + np.where(ended, 0, r)))
        deep = ~first & (context >= 0) & ~ended
        third = np.full(len(m), -1, np.int64)
        both = np.flatnonzero(deep & (pair >= 0))
        if len(both):
            relative = pair[both] - self.next_at[m[both]]
            third[both] = self.third.find(self.third_base[context[both]] + relative)
        known = self.count[m] > 0
        for where, k, index in (
            (third >= 0, "p3", third),
            (deep & (third < 0), "b3", context),
            ((third < 0) & (pair >= 0), "p2", pair),
            (~ended & (pair < 0) & known, "b2", m),
        ):
            at = np.flatnonzero(where)
            if len(at):
                out[at] += getattr(self, k)[index[at]]
        return out, alone, self.count[m]
