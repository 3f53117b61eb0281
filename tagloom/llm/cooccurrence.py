"""Items that appear together: stripes of neighbour counts, PMI and log-likelihood ratio.

A pair is held by the stripe of its rarer item.  A frequent item's own stripe then holds
only the few items still more frequent, so no stripe is long and no task gets more than
the others, however many records an item is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.term_frequency import array_term_counts
from tagloom.plans.lineage import cut

#: Pairs that a task holds before it sends them.
STRIPE_PAIRS = 2_000_000
#: Items whose frequency is known to the tasks, a bound on what is sent to them; the order
#: of the others, all rarer than these, is by hash.
TOP_ITEMS = 60_000
#: The 95 % point of chi-squared with one degree of freedom.
SIGNIFICANT = 3.841

_WIDTH = 1 << 31
_PARTIAL = "item string, ids binary, counts binary, rest array<string>, rest_counts array<long>"
_MERGED = "source string, target string, n_ab long, n_a long, n_b long"


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class _Names:
    """Numbers for names: those of the most frequent items are the same in all tasks, others as they come."""

    def __init__(self, top: list[str]):
        self.top = len(top)
        self.names, self.of = list(top), {x: i for i, x in enumerate(top)}
        # rarest first: items outside the top by hash, then the top by frequency
        self.keys = [(self.top - i) << 41 for i in range(self.top)]

    def numbers(self, values: pa.Array) -> np.ndarray:
        coded = values.dictionary_encode()
        local = np.empty(len(coded.dictionary), np.int64)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            n = self.of.get(name)
            if n is None:
                n = self.of[name] = len(self.names)
                self.names.append(name)
                self.keys.append(int.from_bytes(blake2b(name.encode(), digest_size=5).digest(), "big"))
            local[i] = n
        return local[np.asarray(coded.indices)]


def _binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _stripes(names: _Names, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per item from sorted pair codes item * width + neighbour."""
    item, other = codes // _WIDTH, codes % _WIDTH
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
    known = other < names.top
    before = np.concatenate([[0], np.cumsum(known)])[np.append(start, len(item))]
    after = np.append(start, len(item)) - before
    table = pa.array(names.names, pa.string())
    off = pa.array(after.astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            table.take(pa.array(item[start])), _binary(other[known].astype(np.int32), before), _binary(counts[known], before),
            pa.ListArray.from_arrays(off, table.take(pa.array(other[~known]))), pa.ListArray.from_arrays(off, pa.array(counts[~known])),
        ],
        ["item", "ids", "counts", "rest", "rest_counts"],
    )


def _pair_codes(m: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs of each row of a matrix of items, rarest first, in parts of bounded size."""
    rows, s = m.shape
    if s * (s - 1) // 2 <= STRIPE_PAIRS:
        a, b = np.triu_indices(s, 1)
        step = max(1, STRIPE_PAIRS // len(a))
        for i in range(0, rows, step):
            x = m[i : i + step]
            yield (x[:, a] * _WIDTH + x[:, b]).ravel()
    else:  # a very long record: some of its items with all later ones at a time
        step = max(1, STRIPE_PAIRS // s)
        for row in m:
            for i in range(0, s - 1, step):
                a, b = np.triu_indices(min(step, s - 1 - i), 1, s - i)
                yield row[i + a] * _WIDTH + row[i + b]


def _builder(top: list[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = _Names(top), [], 0
        for batch in batches:
            lists = batch.column(0)
            off = np.asarray(lists.offsets).astype(np.int64)
            if not batch.num_rows or off[-1] == off[0]:
                continue
            number = names.numbers(lists.flatten())
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            by_name = np.argsort(np.argsort(np.array(names.names, object), kind="stable"))
            number = number[np.lexsort((by_name[number], np.array(names.keys)[number], row))]
            start = off[:-1] - off[0]
            for s in np.unique(size):  # records of one size form a matrix
                if s < 2:
                    continue
                for codes in _pair_codes(number[start[size == s][:, None] + np.arange(s)]):
                    held.append(_merge(codes, np.ones(len(codes), np.int64)))
                    n += len(held[-1][0])
                    if n > STRIPE_PAIRS:
                        c, k = _merge(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                        held, n = [(c, k)], len(c)
                        if n > STRIPE_PAIRS // 2:
                            yield from _stripes(names, c, k)
                            held, n = [], 0
            if not held and len(names.names) > STRIPE_PAIRS:
                names = _Names(top)
        if held:
            yield from _stripes(names, *_merge(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])))

    return build


def _merger(top: list[str], frequency: list[int]):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs from partial stripes that come sorted by item: some stripes and the last, open one are held."""
        names = _Names(top)
        known = np.array([*frequency, 0], np.int64)
        held, n, last = [], 0, -1

        def pairs(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y = codes // _WIDTH, codes % _WIDTH
            words = pa.array(names.names, pa.string())
            by_name = np.argsort(np.argsort(np.array(names.names, object), kind="stable"))  # code-point order
            a, b = np.where(by_name[x] < by_name[y], x, y), np.where(by_name[x] < by_name[y], y, x)
            for i in range(0, len(a), 50_000):
                p, q = a[i : i + 50_000], b[i : i + 50_000]
                of = [pa.array(known[np.minimum(z, names.top)], mask=z >= names.top) for z in (p, q)]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(p)), words.take(pa.array(q)), pa.array(counts[i : i + 50_000]), *of], ["source", "target", "n_ab", "n_a", "n_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            item = names.numbers(batch.column(0))
            ids, counts = batch.column(1), batch.column(2)
            blobs = ids.to_pylist()
            size = np.array([len(x) // 4 for x in blobs])
            flat = np.frombuffer(b"".join(blobs), np.int32).astype(np.int64)
            held.append(_merge(np.repeat(item, size) * _WIDTH + flat, np.frombuffer(b"".join(counts.to_pylist()), np.int64)))
            rest = batch.column(3)
            if len(rest.flatten()):
                size = np.diff(np.asarray(rest.offsets).astype(np.int64))
                held.append(_merge(np.repeat(item, size) * _WIDTH + names.numbers(rest.flatten()), np.asarray(batch.column(4).flatten())))
            n = sum(len(x) for x, _ in held)
            last = item[-1]
            if n > STRIPE_PAIRS:
                codes, counts = _merge(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                open_ = codes // _WIDTH == last  # this item may go on in the next batch
                if not open_.all():
                    yield from pairs(codes[~open_], counts[~open_])
                held = [(codes[open_], counts[open_])]
        if held:
            yield from pairs(*_merge(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])))

    return merge


def cooccurrence(records: DataFrame, items: Column) -> DataFrame:
    """``source, target, n_ab, n_a, n_b, n, pmi, llr, significant`` of each pair of items that share a record.

    ``source < target`` in code-point order; n counts the records with two distinct items
    or more, n_a and n_b those with the item.  PMI = ln(n_ab n / (n_a n_b)); llr is
    Dunning's log-likelihood ratio, 2 sum k ln(k / expected) over the four cells;
    ``significant`` marks pairs more frequent than chance at the 95 % level.

    Each task merges its records into stripes, one associative array of neighbours per
    item, before the shuffle by item; the shuffled ones come sorted by item and are merged
    one after the other.  Nulls and repeated items in a record are ignored; an empty table
    gives no rows; records of any length go through in parts of bounded size.
    """
    spark = records.sparkSession
    s = F.array_distinct(F.filter(items.cast("array<string>"), lambda x: x.isNotNull()))
    sets = records.select(s.alias("s")).where(F.size("s") >= 2)
    # one row per item, and the null item for all records; read three times below
    counts = cut(array_term_counts(sets, F.col("s"), with_total=True).select(F.col("term").alias("item"), F.col("records").alias("n")))
    single, total = counts.where("item is not null"), counts.where("item is null").agg(F.sum("n").alias("n"))
    first = [(r[0], r[1]) for r in single.orderBy(F.desc("n"), "item").limit(TOP_ITEMS + 1).collect()]
    top, frequency = [x for x, _ in first[:TOP_ITEMS]], [k for _, k in first[:TOP_ITEMS]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = sets.mapInArrow(_builder(top), _PARTIAL).repartition(parts, "item").sortWithinPartitions("item")
    j = stripes.mapInArrow(_merger(top, frequency), _MERGED)
    if len(first) > TOP_ITEMS:  # some items' frequency isn't known to the tasks
        of = [single.select(F.col("item").alias(c), F.col("n").alias(f"joined_{c}")) for c in ("source", "target")]
        j = j.join(of[0], "source").join(of[1], "target").select("source", "target", "n_ab", F.col("joined_source").alias("n_a"), F.col("joined_target").alias("n_b"))
    j = j.join(F.broadcast(total))
    d = lambda c: F.col(c).cast("double")
    a, b, ab, n = d("n_a"), d("n_b"), d("n_ab"), d("n")

    def cell(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)

    llr = 2 * (cell(ab, a, b) + cell(a - ab, a, n - b) + cell(b - ab, n - a, b) + cell(n - a - b + ab, n - a, n - b))
    j = j.select("source", "target", "n_ab", "n_a", "n_b", "n", F.log(ab * n / (a * b)).alias("pmi"), F.greatest(llr, F.lit(0.0)).alias("llr"))
    return j.withColumn("significant", (F.col("llr") >= SIGNIFICANT) & (ab * n > a * b))
