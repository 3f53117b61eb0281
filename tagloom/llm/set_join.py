"""All similar pairs between records that hold sets: T-occurrence list merging.

Inside a block each (cell, token) has an inverted list of records.  A probe must occur
with a partner in at least T of its lists.  Its longest lists are set aside for binary
search; the remaining short ones are merged with skipping: the heads of the lists are
kept in order, and when the T-th smallest head lies beyond the smallest ones, all of
those jump straight to it.  Many probes advance in step, each row of a matrix being the
heap of one probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.set_blocks import CLASS_ROWS, Block, as_sets, mix, pairs_batch, pairs_by_cell
from tagloom.plans.lineage import cut

_END = np.iinfo(np.int64).max


def merge_skip(keys: np.ndarray, n: int, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows found in at least ``need`` of the ``lists`` of each probe.

    keys: sorted list * n + row.  lists: matrix (probe, list), -1 for none.  Rows outside
    lo <= row < hi are left out.  Returns (probe, row) of all candidates: those found in
    the short lists ``need - L`` times or more, the L longest lists being left to the
    binary search of the caller's check.
    """
    base = lists * n
    start = np.searchsorted(keys, base + lo[:, None])
    stop = np.where(lists >= 0, np.searchsorted(keys, base + hi[:, None]), start)
    length = stop - start
    order = np.argsort(length, axis=1, kind="stable")
    length = np.take_along_axis(length, order, 1)
    start, stop, base = (np.take_along_axis(x, order, 1) for x in (start, stop, base))
    longest = np.maximum(length[:, -1], 2)
    # the share of the lists set aside, after the usual cost model of such merges
    aside = np.minimum(need - 1, np.ceil(need / (0.1 * np.log2(longest) + 1)).astype(np.int64))
    width = lists.shape[1]
    short = np.arange(width) < (width - aside)[:, None]
    least = need - aside
    stop = np.where(short, stop, start)
    live = np.flatnonzero(((stop > start).sum(1) >= least))
    pos, stop, base, least, who = start[live], stop[live], base[live], least[live], live
    probes, rows = [], []
    last = max(len(keys) - 1, 0)
    while len(who):
        heads = np.where(pos < stop, keys[np.minimum(pos, last)] - base, _END)
        heap = np.sort(heads, axis=1)
        t = np.take_along_axis(heap, (least - 1)[:, None], 1)[:, 0]
        match = (heap[:, 0] == t) & (t != _END)
        probes.append(who[match])
        rows.append(t[match])
        # equal heads of a match move on by one, smaller heads jump to the T-th
        pos = pos + ((heads == t[:, None]) & match[:, None] & (heads != _END))
        r, c = np.nonzero((heads < t[:, None]) & (t != _END)[:, None])
        if len(r):
            pos[r, c] = np.minimum(np.searchsorted(keys, base[r, c] + t[r]), stop[r, c])
        on = t != _END
        if not on.all():
            pos, stop, base, least, who = pos[on], stop[on], base[on], least[on], who[on]
    if not probes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(probes), np.concatenate(rows)


class _Lists:
    """Inverted lists of a block: each (cell, token) is one list of rows."""

    def __init__(self, b: Block):
        self.b, self.n = b, len(b.size)
        row = np.repeat(np.arange(self.n), b.size)
        _, codes = np.unique(mix(b.cell[row], b.tokens), return_inverse=True)
        self.codes = codes.astype(np.int64)
        take = b.indexed[row]
        self.keys = np.sort(self.codes[take] * self.n + row[take])

    def shared(self) -> np.ndarray:
        """For each row, how many of its lists hold other rows."""
        own = np.repeat(self.b.indexed, self.b.size)
        held = np.bincount(self.codes[own], minlength=int(self.codes.max(initial=-1)) + 1)
        total = np.concatenate([[0], np.cumsum(held[self.codes] > own)])
        return total[self.b.off[1:]] - total[self.b.off[:-1]]

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Lists of each row in ``rows``, -1 where a row has no more."""
        w = int(self.b.size[rows].max()) if len(rows) else 0
        at = np.arange(w)
        ok = at < self.b.size[rows][:, None]
        return np.where(ok, self.codes[np.minimum(self.b.off[rows][:, None] + at, max(len(self.codes) - 1, 0))], -1)

    def verified(self, a: np.ndarray, b: np.ndarray, num: int, den: int) -> Iterator[pa.RecordBatch]:
        """Pairs (rows a, rows b) that reach the threshold, in the cell of their first common token; smaller id first within a table."""
        size, nth, id_ = self.b.size, self.b.nth, self.b.id
        for i in range(0, len(a), 100_000):
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            p = self.of(x)
            want = p * self.n + y[:, None]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = (self.keys[at] == want) & (p >= 0)
            both = hit.sum(1)
            ok = (both * (num + den) >= num * (size[x] + size[y])) & (hit.argmax(1) == nth[x])
            x, y, both = x[ok], y[ok], both[ok]
            if not self.b.between:
                swap = id_[x] > id_[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield pairs_batch(id_[x], id_[y], both, size[x], size[y])


def t_occurrence(b: Block, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs of one block; see :func:`tagloom.llm.set_blocks.pairs_by_cell`."""
    if len(b.size) < 2 or not b.indexed.any():
        return
    p, lo, hi = b.partners(num, den)
    if not len(p):
        return
    lists = _Lists(b)
    smallest = (b.size * num + den - 1) // den
    need = np.maximum((num * (b.size + smallest) + num + den - 1) // (num + den), 1)
    # a probe without enough lists that hold others needs no merging
    enough = lists.shared() >= need
    some = enough[p]
    p, lo, hi = p[some], lo[some], hi[some]
    m, need = b.size[p], need[p]
    for w in np.unique(m):  # probes of one size: their lists are a matrix
        at = np.flatnonzero(m == w)
        for i in range(0, len(at), 4096):
            k = at[i : i + 4096]
            who, row = merge_skip(lists.keys, lists.n, lists.of(p[k]), lo[k], hi[k], need[k])
            if len(who):
                yield from lists.verified(p[k][who], row, num, den)


def similar_classes(df: DataFrame, id_col: str, set_col: str, threshold: float, group: Column | None = None, side: Column | None = None, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, membership) of the records of one table, or between two sides of it.

    A class holds the records of one group (and side) with equal sets; ``rep`` is its
    smallest id.  Pairs ``a, b, overlap, size_a, size_b`` are those of different classes
    with overlap / union >= threshold, each once; within one table a < b, between sides
    ``a`` is of side 0 and ``b`` of side 1.  Membership: ``id, side, rep, copies``.

    Null elements and repeated elements are ignored; null arrays and sets of fewer than
    two elements take no part; a null group is one group; rows with a null id or side
    are left out; an empty table gives no pairs; sets of any length go through.  Sets
    compare by hashes of 63 bits of their elements.
    """
    sets = as_sets(df, id_col, set_col, group, side)
    pairs = pairs_by_cell(sets, threshold, t_occurrence, side is not None, **bounds)
    return pairs.drop("spans", "longest"), sets.members()


def class_links(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``id, rep, copies, links``: each record with its class and the number of records it is similar to.

    Copies are not expanded into pairs: a record links to the other members of its class
    and to all members of the classes that its class is paired with.
    """
    size = of.select("rep", "copies").distinct()
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("n"))
    return of.join(near, "rep", "left").select("id", "rep", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))


def _members_of(pairs: DataFrame, many: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the class in column ``end`` replaced by each of its members."""
    # only classes of several records need the join; AQE splits one that holds very many
    of = many.select(F.col("rep").alias(end), F.col("id").alias("__id"))
    return pairs.join(of, end, "left").withColumn(end, F.coalesce("__id", end)).drop("__id")


def expand(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``a, b`` (a < b): all pairs of records behind the pairs of classes of one table, equal sets included.

    The members of a large class are paired in parts: each of its records is sent with
    one part of the others to a task.
    """
    many = cut(of.where("copies > 1"))
    across = _members_of(_members_of(pairs.select("a", "b"), many, "a"), many, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parts = F.ceil(F.col("copies") / CLASS_ROWS).cast("int")
    m = many.select("rep", "id", parts.alias("k"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    x = m.select("rep", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    within = x.join(m.select("rep", "part", F.col("id").alias("b")), ["rep", "part"]).where("a < b").select("a", "b")
    return across.unionByName(within)


def expand_between(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs`` with the classes of ``a`` and ``b`` replaced by their records, those of side 0 and side 1."""
    many = cut(of.where("copies > 1"))
    return _members_of(_members_of(pairs, many, "a"), many, "b")
