"""Evaluation texts leaking into a corpus: SimHash of windows, looked up in Hamming blocks.

Each item is covered by windows, of a given number of words or of about its own size;
every window of every document of the same size gets a 64-bit SimHash.  The fingerprint
is cut into blocks, one of which two fingerprints within the radius share almost or
wholly, so looking up each block finds them all.  Candidates within the radius are
verified by the weighted similarity of their shingles, then, where whole passages are
wanted, word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import mix64, words
from tagloom.plans.lineage import cut

BITS = 64
#: Characters of items that are sent to the tasks; windows of more items are joined by block.
ITEM_CHARS = 4_000_000
#: Bytes of text that a task handles at once.
BATCH_BYTES = 4_000_000


def window_starts(text_no: np.ndarray, window: int) -> np.ndarray:
    """Places whose window lies within one text."""
    n = len(text_no) - window + 1
    return np.flatnonzero(text_no[:n] == text_no[window - 1 :]) if n > 0 else np.empty(0, np.int64)


def simhash(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the words of each window: the majority of each bit."""
    out = np.empty(len(starts), np.uint64)
    step = 1 << 15
    for i in range(0, len(starts), step):
        s = starts[i : i + step]
        a, z = s[0], s[-1] + window
        bits = np.unpackbits(h[a:z].view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, BITS), np.uint8)
        np.cumsum(bits, axis=0, dtype=np.uint8, out=sums[1:])  # wraps; differences stay right below 256
        most = (sums[s - a + window] - sums[s - a]) > window // 2
        out[i : i + step] = np.packbits(most, axis=1).view(np.uint64).ravel()
    return out


class HammingIndex:
    """Fingerprints by blocks of their bits: all that lie within the radius are found.

    Of ``blocks`` blocks (radius + 1 unless given) one at least differs in radius // blocks
    bits or fewer; under each block the fingerprints stand with all values that near.
    """

    def __init__(self, prints: np.ndarray, radius: int, blocks: int | None = None):
        self.prints, self.radius = prints, radius
        m = blocks or radius + 1
        cuts = [BITS * i // m for i in range(m + 1)]
        self.blocks = []
        for a, z in zip(cuts, cuts[1:]):
            flips = [0]
            for k in range(1, radius // m + 1):
                flips += [sum(1 << i for i in bits) for bits in combinations(range(z - a), k)]
            v = (self._block(prints, a, z)[:, None] ^ np.array(flips, np.uint64)).ravel()
            order = np.argsort(v, kind="stable")
            width = min(z - a, 24)
            there = np.zeros(1 << width, bool)
            there[(v >> np.uint64(z - a - width)).astype(np.int64)] = True
            self.blocks.append((a, z, v[order], (order // len(flips)).astype(np.int32), there, np.uint64(z - a - width)))

    @staticmethod
    def _block(x: np.ndarray, a: int, z: int) -> np.ndarray:
        return (x >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1)

    def within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place in x, fingerprint) at most ``radius`` bits apart, some more than once."""
        p, q = [], []
        for a, z, values, order, there, shift in self.blocks:
            v = self._block(x, a, z)
            at = np.flatnonzero(there[(v >> shift).astype(np.int64)])
            lo, hi = np.searchsorted(values, v[at]), np.searchsorted(values, v[at], side="right")
            n = hi - lo
            who = np.repeat(at, n)
            got = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = np.bitwise_count(x[who] ^ self.prints[got]) <= self.radius
            p.append(who[near])
            q.append(got[near].astype(np.int64))
        return np.concatenate(p), np.concatenate(q)


def shingles(words_: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of each row of word hashes."""
    n = words_.shape[-1] - size + 1
    s = np.zeros((*words_.shape[:-1], n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            s = mix64(s * np.uint64(31) + words_[..., k : n + k])
    return s


class Weights:
    """How telling a shingle is: by how few of all items' shingles equal it; the rest of the corpus has the highest weight."""

    def __init__(self, kinds: np.ndarray, counts: np.ndarray, total: int):
        self.kinds, self.weights, self.rare = kinds, np.log1p(total / counts), math.log1p(total)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.kinds):
            return np.full(s.shape, self.rare)
        at = np.minimum(np.searchsorted(self.kinds, s), len(self.kinds) - 1)
        return np.where(self.kinds[at] == s, self.weights[at], self.rare)


def similarity_of(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each two rows of shingles; copies in a row count once."""

    def once(s):
        o = np.argsort(s, axis=1, kind="stable")
        t = np.take_along_axis(s, o, 1)
        f = np.ones_like(t, bool)
        f[:, 1:] = t[:, 1:] != t[:, :-1]
        back = np.empty_like(f)
        np.put_along_axis(back, o, f, 1)
        return back

    fa, fb = once(a), once(b)
    out = np.empty(len(a))
    for i in range(0, len(a), 2000):
        k = slice(i, i + 2000)
        common = ((fa[k] & (a[k, :, None] == b[k, None, :]).any(2)) * wa[k]).sum(1)
        total = (wa[k] * fa[k]).sum(1) + (wb[k] * fb[k]).sum(1) - common
        out[k] = common / np.maximum(total, 1e-12)
    return out


class Windows:
    """What counts as a passage: its words, how near fingerprints and shingles must be, and whether all words must agree."""

    def __init__(self, words_: int | None, radius: int, blocks: int, similarity: float, exact: bool, shingle: int):
        self.words, self.radius, self.blocks, self.similarity, self.exact, self.shingle = words_, radius, blocks, similarity, exact, shingle

    def sizes(self, lengths: np.ndarray) -> np.ndarray:
        """Window size of items of some lengths; 0 for items too short to have one.

        Item-sized windows come in steps of a quarter, so that a few sizes serve all items.
        """
        if self.words:
            return np.where(lengths >= self.words, self.words, 0)
        steps = [2 * self.shingle]
        while steps[-1] < 255:  # the counters of a window's bits are bytes
            steps.append(min(255, steps[-1] + max(1, steps[-1] // 4)))
        at = np.searchsorted(steps, lengths, side="right")
        return np.where(at > 0, np.array([0, *steps])[at], 0)


class _Items:
    """Windows of some items, by size: fingerprints, words and owners."""

    def __init__(self, ids: list[int], texts: list[str], how: Windows, weights: Weights):
        h, no = words(texts)
        lengths = np.bincount(no, minlength=len(texts))
        size = how.sizes(lengths)
        self.h, self.how, self.weights, self.by_size = h, how, weights, []
        for w in np.unique(size[size > 0]):
            start = window_starts(no, int(w))
            start = start[size[no[start]] == w]
            if not how.words:  # the first and the last window together hold the whole item
                ends = np.append(no[start][1:] != no[start][:-1], True)
                start = start[ends | np.append(True, ends[:-1])]
            prints = simhash(h, start, int(w))
            self.by_size.append((int(w), start, prints, np.array(ids, np.int64)[no[start]]))

    def index(self):
        return [(w, start, owner, HammingIndex(prints, self.how.radius, self.how.blocks)) for w, start, prints, owner in self.by_size]


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int | None = 12, radius: int = 2, similarity: float = 1.0, exact: bool = True, shingle: int = 3, blocks: int = 3, item_chars: int | None = None) -> DataFrame:
    """``doc_id, item_id, windows, similarity``: documents that carry a passage of an item.

    A passage is ``window`` successive words (runs of a-z, 0-9 after lower-casing), or
    where that is None as many as the item has, rounded down by a quarter at most (255 at
    most).  With ``exact`` all of them must agree in order, else their fingerprints must
    lie within ``radius`` and their weighted shingles reach ``similarity``.  ``windows``
    counts the windows of the document that match, similarity is the best one.  Texts
    with fewer words match nothing, and so do null and empty ones; repeated ids give one
    row each time their rows are read; ties don't arise.

    Items of up to ``item_chars`` characters are sent to the tasks and documents are not
    shuffled.  With more of them each document is still read once: of its windows those
    that share a block's leading bits with some item are joined to the items' by block,
    and only these windows' shingles are shuffled.
    """
    how = Windows(window, radius, blocks, similarity, exact, shingle)
    kept = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    chars = kept.agg(F.sum(F.length("t"))).first()[0] or 0
    slim = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    if chars > (ITEM_CHARS if item_chars is None else item_chars):
        return _joined_by_block(slim, kept, how)
    rows = kept.orderBy("i", "t").collect()  # ITEM_CHARS characters at most
    return slim.mapInArrow(_scanner([x[0] for x in rows], [x[1] for x in rows], how), FOUND)


FOUND = "doc_id long, item_id long, windows int, similarity double"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about BATCH_BYTES at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(d)
            texts.append(t)
            size += len(t)
            if size > BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _weights_of(texts: list[str], how: Windows) -> Weights:
    h, no = words(texts)
    start = window_starts(no, how.shingle)
    seen = shingles(h, how.shingle)[start] if len(start) else np.empty(0, np.uint64)
    kinds, counts = np.unique(seen, return_counts=True)
    return Weights(kinds, counts, len(seen))


def _scanner(ids: list[int], texts: list[str], how: Windows):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, texts, how, _weights_of(texts, how))
        index, ih = items.index(), items.h
        if not index:
            return
        item_shingles = shingles(ih, how.shingle)
        item_weights = items.weights(item_shingles)
        for docs, bodies in _batches(batches):
            h, no = words(bodies)
            found, run = [], None
            for w, istart, owner, near in index:
                start = window_starts(no, w)
                if not len(start):
                    continue
                p, q = near.within(simhash(h, start, w))
                pair = np.unique(p * len(owner) + q)
                p, q = start[pair // len(owner)], pair % len(owner)
                if not len(p):
                    continue
                run = shingles(h, how.shingle) if run is None else run
                span = np.arange(w - how.shingle + 1)
                of = np.unique(p[:, None] + span)
                weight = items.weights(run[of])
                sim = np.empty(len(p))
                for i in range(0, len(p), 20_000):
                    x, y = p[i : i + 20_000, None] + span, istart[q[i : i + 20_000]][:, None] + span
                    sim[i : i + 20_000] = similarity_of(run[x], item_shingles[y], weight[np.searchsorted(of, x)], item_weights[y])
                ok = sim >= how.similarity - 1e-9
                if how.exact:
                    all_ = np.arange(w)
                    ok[ok] = (h[p[ok][:, None] + all_] == ih[istart[q[ok]][:, None] + all_]).all(1)
                found.append((no[p[ok]], owner[q[ok]], p[ok], sim[ok]))
            if not found or not sum(len(f[0]) for f in found):
                continue
            doc, item, place, sim = map(np.concatenate, zip(*found))
            keys, inv = np.unique(np.stack([doc, item], 1), axis=0, return_inverse=True)
            inv = inv.ravel()
            # windows of a document, not copies of a window in the item
            at = np.unique(np.stack([inv, place], 1), axis=0)
            n = np.bincount(at[:, 0], minlength=len(keys)).astype(np.int32)
            best = np.zeros(len(keys))
            np.maximum.at(best, inv, sim)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[keys[:, 0]]), pa.array(keys[:, 1]), pa.array(n), pa.array(best)], ["doc_id", "item_id", "windows", "similarity"])

    return scan


# ---- any number of items: windows joined by block --------------------------------------

#: Leading bits of a block by which a document's windows are sifted before the join.
_SIFT = 24


def _joined_by_block(slim: DataFrame, kept: DataFrame, how: Windows) -> DataFrame:
    cuts = [BITS * i // how.blocks for i in range(how.blocks + 1)]
    if how.radius // how.blocks:
        raise ValueError("the join by block needs more blocks than the radius")
    sizes = [how.words] if how.words else [int(x) for x in np.unique(how.sizes(np.arange(256))) if x]

    def value(prints: np.ndarray, b: int) -> np.ndarray:
        return HammingIndex._block(prints, cuts[b], cuts[b + 1])

    def sifted(v: np.ndarray, b: int) -> np.ndarray:
        return (v >> np.uint64(max(0, cuts[b + 1] - cuts[b] - _SIFT))).astype(np.int64)

    def rows(block, v, w, prints, owner, place, s) -> pa.RecordBatch:
        off = np.arange(len(s) + 1) * s.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(s.astype(np.uint64).view(np.int64).ravel()))
        i32 = lambda x: pa.array(np.full(len(v), x, np.int32))
        return pa.RecordBatch.from_arrays([i32(block), pa.array(v.astype(np.int64)), i32(w), pa.array(prints.view(np.int64)), pa.array(owner), pa.array(place.astype(np.int64)), lists], ["block", "v", "w", "print", "owner", "place", "shingles"])

    schema = "block int, v long, w int, print long, owner long, place long, shingles array<long>"

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            x = _Items(ids, texts, how, None)
            for w, start, prints, owner in x.by_size:
                s = shingles(x.h[start[:, None] + np.arange(w)], how.shingle)
                for b in range(how.blocks):
                    yield rows(b, value(prints, b), w, prints, owner, start, s)

    item_rows = cut(kept.mapInArrow(of_items, schema))
    weights = item_rows.where("block = 0").select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    weights = cut(weights)
    total = weights.agg(F.sum("n")).first()[0] or 0
    # one bit per leading value of a block: blocks x 2 MB at most
    lead = [F.shiftrightunsigned("v", max(0, cuts[b + 1] - cuts[b] - _SIFT)) + 1 for b in range(how.blocks)]
    bit = F.coalesce(*[F.when(F.col("block") == b, x) for b, x in enumerate(lead)])
    maps = item_rows.select("block", bit.alias("x")).groupBy("block", F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    there = [np.zeros(1 << _SIFT, bool) for _ in range(how.blocks)]
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        there[r["block"]][(r["k"] - 1) * len(bits) : r["k"] * len(bits)] = bits
    packed = [np.packbits(x) for x in there]

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [np.unpackbits(x).astype(bool) for x in packed]
        for ids, texts in _batches(batches):
            h, no = words(texts)
            for w in sizes:
                start = window_starts(no, w)
                if not len(start):
                    continue
                prints = simhash(h, start, w)
                for b in range(how.blocks):
                    v = value(prints, b)
                    at = np.flatnonzero(some[b][sifted(v, b)])
                    for i in range(0, len(at), 20_000):
                        k = at[i : i + 20_000]
                        s = shingles(h[start[k][:, None] + np.arange(w)], how.shingle)
                        yield rows(b, v[k], w, prints[k], np.array(ids, np.int64)[no[start[k]]], start[k], s)

    x = slim.mapInArrow(of_docs, schema).select("block", "v", "w", F.col("print").alias("p"), F.col("owner").alias("doc_id"), "place", F.col("shingles").alias("a"))
    y = item_rows.select("block", "v", "w", F.col("print").alias("q"), F.col("owner").alias("item_id"), F.col("shingles").alias("b"))
    near = x.join(y, ["block", "v", "w"]).where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= how.radius)
    if how.exact:
        near = near.where("a = b").withColumn("similarity", F.lit(1.0))
    else:
        near = cut(near.select("doc_id", "item_id", "place", "a", "b").distinct())
        rare = math.log1p(total)
        kinds = near.select(F.explode(F.concat("a", "b")).alias("s")).distinct()
        # the weights of the shingles in question, joined, not sent to all
        known = kinds.join(weights, "s").select("s", F.log1p(F.lit(float(total)) / F.col("n")).alias("weight"))
        ends = [near.select("doc_id", "item_id", "place", "a", "b", F.lit(side).alias("side"), F.explode(F.array_distinct(side)).alias("s")) for side in ("a", "b")]
        w = F.coalesce("weight", F.lit(rare))
        sums = ends[0].unionByName(ends[1]).join(known, "s", "left").groupBy("doc_id", "item_id", "place", "a", "b").agg(
            F.sum(F.when((F.col("side") == "a") & F.array_contains("b", F.col("s")), w).otherwise(0.0)).alias("both"), F.sum(w).alias("all")
        )
        near = sums.withColumn("similarity", F.col("both") / (F.col("all") - F.col("both"))).where(F.col("similarity") >= how.similarity - 1e-9)
    hits = near.groupBy("doc_id", "item_id", "place").agg(F.max("similarity").alias("similarity"))
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("windows"), F.max("similarity").alias("similarity"))
