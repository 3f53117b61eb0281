"""Same or nearly the same sets on two sides: a compressed full-text index of one side, searched backward.

The sets of the evaluation side, written as sequences of their elements in the global
order (rarest first), form the text of one FM-index per shard; a shard holds the
sequences of some of the rarest tokens, and each training sequence visits the shards of
its own rarest tokens, which no similar partner can all miss.  Sets that agree up to the
threshold differ in few elements, so their sequences share at least one long run.  Each
position of a training sequence is searched backward to the shortest run that a partner
must share; the hits of a pair on one diagonal merge into maximal matches, these are
counted, and the pair is verified by its exact overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tagloom.llm.set_blocks import Block, as_sets, pairs_batch, pairs_by_cell, ranges


def shortest_run(m: int, num: int, den: int) -> int:
    """Length of the run that a set of m shares at least with any partner at the threshold.

    With an overlap of o, d = m + s - 2 o elements stand on one side only and cut the
    common ones into d + 1 runs at most, so the longest run has ceil(o / (d + 1)).
    """
    least = m
    for s in range((m * num + den - 1) // den, m * den // num + 1):
        o = max(1, -(-num * (m + s) // (num + den)))
        if o <= min(m, s):
            least = min(least, -(-o // (m + s - 2 * o + 1)))
    return max(1, least)


class BitVector:
    """Bits in words of 64 with the ones before each word counted."""

    def __init__(self, bits: np.ndarray):
        self.words = np.frombuffer(np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bits.dtype)]), bitorder="little").tobytes(), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        w = at >> 6
        low = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class FullTextIndex:
    """FM-index of integer sequences: about three bytes a symbol for thousands of symbols.

    The Burrows-Wheeler transform is kept in a wavelet matrix, one bit vector with ranks
    per bit of the symbols.  Of the suffix array every ``sample``-th place of a sequence
    is kept; the others are found by walking back to one of these.
    """

    def __init__(self, codes: np.ndarray, off: np.ndarray, sample: int = 8):
        """codes: symbols >= 0 of all sequences; off: offsets of the sequences."""
        k, sizes = len(off) - 1, np.diff(off)
        # a separator of its own ends each sequence: symbols 0..k-1, below all others
        n = len(codes) + k
        text = np.empty(n, np.int64)
        self.begins = off[:-1] + np.arange(k)
        ends = off[1:] + np.arange(k)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes + k
        text[ends] = np.arange(k)
        self.n, self.sample = n, sample
        order = np.argsort(text, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(text[order]) != 0])) if n else 0
        step, most = 1, int(sizes.max()) + 1 if k else 0
        while step <= most:  # prefix doubling; separators make suffixes differ within a sequence
            nxt = np.full(n, -1, np.int64)
            nxt[: n - step] = rank[step:]
            key = rank * (n + 1) + nxt + 1
            order = np.argsort(key, kind="stable")
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            step *= 2
            if n and rank[order[-1]] == n - 1:
                break
        # from here on all separators are symbol 0: no run that is searched holds one
        bwt = np.maximum(text[order - 1] - k + 1, 0)
        self.symbols = int(codes.max()) + 2 if len(codes) else 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=self.symbols))])
        self.levels: list[tuple[int, BitVector, int]] = []
        x = bwt
        for shift in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            bit = (x >> shift) & 1
            self.levels.append((shift, BitVector(bit.astype(np.uint8)), int(len(x) - bit.sum())))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.first = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        inside = np.searchsorted(self.begins, order, side="right") - 1
        kept = (order - self.begins[inside]) % sample == 0
        self.sampled, self.places = BitVector(kept.astype(np.uint8)), order[kept].astype(np.int32 if n < 1 << 31 else np.int64)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for _, v, _ in self.levels) + self.sampled.nbytes + self.places.nbytes + self.smaller.nbytes + self.first.nbytes

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            one = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + one, at - one)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: the rows of suffixes that start with ``symbol`` before row ``at``."""
        return self.smaller[symbol] + self._down(symbol, at) - self.first[symbol]

    def search(self, flat: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the runs flat[end - length + 1 : end + 1]; symbols that don't occur are -1."""
        c = flat[end] + 1
        lo, hi = self.smaller[c], self.smaller[np.minimum(c + 1, self.symbols)]
        hi = np.where(c > 0, hi, lo)
        live = np.arange(len(end))
        for j in range(1, int(length.max()) if len(end) else 0):
            live = live[(length[live] > j) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = flat[end[live] - j] + 1
            hi[live[c == 0]] = lo[live[c == 0]]
            live, c = live[c > 0], c[c > 0]
            both = self.step(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place in it) of the suffixes in some rows."""
        place = np.empty(len(rows), np.int64)
        open_, at, walked = np.arange(len(rows)), rows, 0
        while len(open_):
            hit = self.sampled.get(at) == 1
            place[open_[hit]] = self.places[self.sampled.rank(at[hit])] + walked
            open_, at = open_[~hit], at[~hit]
            down, symbol = at, np.zeros(len(at), np.int64)
            for _, bits, zeros in self.levels:
                bit, one = bits.get(down), bits.rank(down)
                down = np.where(bit, zeros + one, down - one)
                symbol = symbol * 2 + bit
            at = self.smaller[symbol] + down - self.first[symbol]
            walked += 1
        sequence = np.searchsorted(self.begins, place, side="right") - 1
        return sequence, place - self.begins[sequence]


def _distinct_sets(b: Block, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the block, one per set of a side; for each row of the block the set's number)."""
    _, first, number = np.unique(b.id[side], return_index=True, return_inverse=True)
    of = np.full(len(b.id), -1, np.int64)
    of[side] = number
    return np.flatnonzero(side)[first], of


def backward_matches(b: Block, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of one shard: training sequences are streamed through the index of the other side."""
    if not b.indexed.any() or not b.probes.any():
        return
    text, _ = _distinct_sets(b, b.indexed)
    probes, probe_of = _distinct_sets(b, b.probes)
    alphabet, coded = np.unique(b.tokens[ranges(b.off[text], b.size[text])], return_inverse=True)
    off = np.concatenate([[0], np.cumsum(b.size[text])])
    index = FullTextIndex(coded, off)
    k = len(text)
    own = np.sort(coded.astype(np.int64) * k + np.repeat(np.arange(k), b.size[text]))
    # a pair is given by the shard of its first common token: the cells of the probes here
    width = int(b.size.max()) + 1
    here = np.unique(probe_of[b.probes] * width + b.nth[b.probes])
    runs = np.array([shortest_run(int(m), num, den) for m in range(width)])
    for i in range(0, len(probes), 20_000):
        rows = probes[i : i + 20_000]
        m = b.size[rows]
        flat_off = np.concatenate([[0], np.cumsum(m)])
        flat = b.tokens[ranges(b.off[rows], m)]
        at = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
        flat = np.where(alphabet[at] == flat, at, -1)
        r = runs[m]
        starts = m - r + 1  # searches per probe
        who = np.repeat(np.arange(len(rows)), starts)
        begin = np.arange(len(who)) - np.repeat(np.cumsum(starts) - starts, starts)
        lo, hi = index.search(flat, flat_off[who] + begin + r[who] - 1, r[who])
        hits = np.maximum(hi - lo, 0)
        for part in _whole_parts(hits, who, 2_000_000):
            h = hits[part]
            if not h.any():
                continue
            sequence, place = index.locate(ranges(lo[part], h))
            p, nth = np.repeat(who[part], h), np.repeat(begin[part], h)
            size = b.size[text[sequence]]
            near = (size * den >= num * m[p]) & (m[p] * den >= num * size)
            pair, diagonal, nth = (p * k + sequence)[near], (place - nth)[near], nth[near]
            order = np.lexsort((nth, diagonal, pair))
            pair, diagonal, nth = pair[order], diagonal[order], nth[order]
            if not len(pair):
                continue
            # successive hits on one diagonal are one maximal match
            fresh = np.ones(len(pair), bool)
            fresh[1:] = (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (nth[1:] != nth[:-1] + 1)
            match = np.flatnonzero(fresh)
            length = np.diff(np.append(match, len(pair))) - 1
            pairs, first = np.unique(pair[match], return_index=True)
            spans, longest = np.diff(np.append(first, len(match))), np.maximum.reduceat(length, first)
            x, y = pairs // k, pairs % k
            longest = longest + r[x]
            for j in range(0, len(x), 100_000):
                yield _checked(b, slice(j, j + 100_000), x, y, spans, longest, flat, flat_off, rows, text, own, here, probe_of, width, num, den)


def _checked(b, s, x, y, spans, longest, flat, flat_off, rows, text, own, here, probe_of, width, num, den) -> pa.RecordBatch:
    """Pairs that reach the threshold and whose first common token is a cell of this shard."""
    x, y, spans, longest = x[s], y[s], spans[s], longest[s]
    m, k = b.size[rows[x]], len(text)
    w = np.arange(int(m.max()))
    inside = w < m[:, None]
    code = np.where(inside, flat[np.minimum(flat_off[x][:, None] + w, len(flat) - 1)], -1)
    want = code * k + y[:, None]
    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
    hit = (own[at] == want) & (code >= 0)
    both, other = hit.sum(1), b.size[text[y]]
    key = probe_of[rows[x]] * width + hit.argmax(1)
    place = np.minimum(np.searchsorted(here, key), len(here) - 1)
    ok = (both * (num + den) >= num * (m + other)) & (here[place] == key)
    return pairs_batch(b.id[rows[x[ok]]], b.id[text[y[ok]]], both[ok], m[ok], other[ok], spans[ok], longest[ok])


def _whole_parts(sizes: np.ndarray, who: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items with about ``most`` in all, never cut within one ``who``."""
    last = np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1 if len(who) else np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(who):
        end = last[min(np.searchsorted(total[last], total[begin] + most, side="right"), len(last) - 1)]
        if end <= begin:
            end = last[np.searchsorted(last, begin, side="right")]
        yield slice(begin, end)
        begin = end


def overlaps_between(df: DataFrame, id_col: str, set_col: str, side: Column, threshold: float, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, membership) between side 0 (streamed) and side 1 (indexed).

    Pairs ``a, b, overlap, size_a, size_b, spans, longest``: a class of side 0 and one of
    side 1 with overlap / union >= threshold, equal sets included, each once; ``spans``
    counts their maximal matches, runs of elements that stand together in both, and
    ``longest`` is the longest one's length.  Rows with a null side belong to neither.
    Nulls, repeated elements, small and very long sets and empty tables as in
    :func:`tagloom.llm.set_join.similar_classes`.
    """
    sets = as_sets(df, id_col, set_col, None, side)
    return pairs_by_cell(sets, threshold, backward_matches, True, **bounds), sets.members()
