"""Shared parts of the joins on sets: classes of equal sets, prefix cells, bounded blocks.

A record is routed to one *cell* per token of its prefix (its rarest tokens, as many as
a similar partner can't all miss), so similar records meet in at least one cell.  Cells
are packed into blocks of bounded size; a cell larger than a bound is cut into chunks and
each pair of chunks becomes a block of its own, so that no task holds more than two
chunks however frequent a token, a company or a group of near copies is.

A set travels as bytes: its tokens ascend in a global order, rarest first, the most
frequent ones as numbers of two bytes, all others as hashes.  A set too long to be sent
once per cell is routed by its id alone; its pairs are verified by a join afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.term_frequency import array_term_counts
from tagloom.plans.lineage import cut

#: Tokens whose frequency is known to the tasks: a bound on what is sent to them, and on two bytes.
TOP_TOKENS = 60_000
BLOCK_ROWS = 60_000
CELL_ROWS = 20_000
#: Tokens of a set that is still sent whole to each of its cells.
LONG = 400
#: Rows of a class in one task where its members are paired.
CLASS_ROWS = 20_000

PAIRS = "a long, b long, overlap int, size_a int, size_b int, spans int, longest int"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit mix of two arrays of hashes."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def token_hash(token: str) -> int:
    """A negative 64-bit hash: hashed tokens stand before the numbered ones."""
    return int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) | -(1 << 63)


# ---- sets as bytes -------------------------------------------------------------------


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some ranges, one after the other."""
    o = np.cumsum(length) - length
    return np.repeat(start - o, length) + np.arange(int(length.sum()))


def packed(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of sets of ascending tokens: negative ones in 8 bytes, others in 2."""
    hashed = np.concatenate([[0], np.cumsum(tokens < 0)])
    r = hashed[off[1:]] - hashed[off[:-1]]
    n = np.diff(off)
    at = np.concatenate([[0], np.cumsum(8 * r + 2 * (n - r))])
    out = np.empty(at[-1], np.uint8)
    out[ranges(at[:-1], 8 * r)] = np.frombuffer(tokens[tokens < 0].tobytes(), np.uint8)
    out[ranges(at[:-1] + 8 * r, 2 * (n - r))] = np.frombuffer(tokens[tokens >= 0].astype(np.uint16).tobytes(), np.uint8)
    return out, at


def unpacked(raw: np.ndarray, at: np.ndarray, r: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of packed sets: at their places, with r hashed of n tokens."""
    off = np.concatenate([[0], np.cumsum(n)])
    tokens = np.empty(off[-1], np.int64)
    tokens[ranges(off[:-1], r)] = np.frombuffer(raw[ranges(at, 8 * r)].tobytes(), np.int64)
    tokens[ranges(off[:-1] + r, n - r)] = np.frombuffer(raw[ranges(at + 8 * r, 2 * (n - r))].tobytes(), np.uint16)
    return tokens, off


def binary(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def raw_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0]


class Sets:
    """The sets of a table: what :func:`as_sets` makes, with what is known of the frequent tokens."""

    def __init__(self, rows: DataFrame, top: list[str], frequency: list[int]):
        self.rows, self.frequency = rows, np.array(frequency, np.int64)
        self.top_hash = np.array([token_hash(t) for t in top] or [0], np.int64)
        # the classes of several records alone: the keys are summed without the sets
        keys = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self.repeated = cut(keys.where("copies > 1"))

    def members(self) -> DataFrame:
        """``id, side, rep, copies``: the class of each record, named after its smallest id, and its size."""
        m = self.rows.select("id", "side", "k1", "k2").join(self.repeated, ["k1", "k2"], "left")
        return m.select("id", "side", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))

    def classes(self) -> DataFrame:
        """``rep, side, gk, size, hashed, tokens``: one record of each class; written once."""
        first = self.rows.join(self.repeated, ["k1", "k2"], "left").where("rep is null or id = rep")
        return cut(first.select(F.col("id").alias("rep"), "side", "gk", "size", "hashed", "tokens"), hashes=True)


def as_sets(df: DataFrame, id_col: str, set_col: str, group: Column | None = None, side: Column | None = None) -> Sets:
    """``id, side, k1, k2, gk, size, hashed, tokens`` of the sets with two distinct elements or more.

    Null arrays, null elements and rows with a null id or side are left out; a null group
    is a group of its own.  ``k1, k2`` are the key of the class of equal sets.
    """
    g = F.coalesce(group, F.lit("")) if group is not None else F.lit("")
    side = side if side is not None else F.lit(0)
    slim = df.where(F.size(set_col) >= 2).select(F.col(id_col).cast("long").alias("id"), side.cast("int").alias("side"), F.xxhash64(g).alias("gk"), F.col(set_col).cast("array<string>").alias("s"))
    # over all rows, whatever their side: an order of the tokens, and at least their records
    found = array_term_counts(df.where(F.size(set_col) >= 2), F.col(set_col)).orderBy(F.desc("records"), "term").limit(TOP_TOKENS).collect()
    found.reverse()  # rarest first
    top, frequency = [r["term"] for r in found], [r["records"] for r in found]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(top)}
        hashes = np.array([token_hash(t) for t in top] or [0], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sides, lists = batch.column(0), batch.column(1), batch.column(3)
            size = np.diff(np.asarray(lists.offsets).astype(np.int64))
            flat = lists.flatten()
            there = np.asarray(flat.is_valid()).astype(bool)
            coded = flat.drop_null().dictionary_encode()
            local = np.array([number[t] if t in number else token_hash(t) for t in coded.dictionary.to_pylist()], np.int64)
            row, token = np.repeat(np.arange(len(size)), size)[there], local[np.asarray(coded.indices)]
            order = np.lexsort((token, row))
            row, token = row[order], token[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
            row, token = row[once], token[once]
            off = np.searchsorted(row, np.arange(len(size) + 1))
            h = np.where(token >= 0, hashes[np.maximum(token, 0)], token)
            side, gk = np.asarray(sides.fill_null(0)).astype(np.int64), np.asarray(batch.column(2))
            keys = []
            for seed in (1, 2):
                with np.errstate(over="ignore"):
                    total = np.concatenate([[0], np.cumsum(mix(h, np.full(len(h), seed, np.int64)))])
                    keys.append(mix(mix(total[off[1:]] - total[off[:-1]], gk), side + seed))
            hashed = np.concatenate([[0], np.cumsum(token < 0)])
            n = np.diff(off)
            ok = (n > 1) & np.asarray(ids.is_valid()).astype(bool) & np.asarray(sides.is_valid()).astype(bool)
            cols = [ids, sides, pa.array(keys[0]), pa.array(keys[1]), batch.column(2), pa.array(n.astype(np.int32)), pa.array((hashed[off[1:]] - hashed[off[:-1]]).astype(np.int32)), binary(*packed(token, off))]
            out = pa.RecordBatch.from_arrays(cols, ["id", "side", "k1", "k2", "gk", "size", "hashed", "tokens"])
            yield out if ok.all() else out.filter(pa.array(ok))

    rows = cut(slim.mapInArrow(encode, "id long, side int, k1 long, k2 long, gk long, size int, hashed int, tokens binary"), hashes=True)
    return Sets(rows, top, frequency)


def ratio(threshold: float) -> tuple[int, int]:
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def prefix_length(n, num: int, den: int):
    """Tokens of a set of n of which a partner at the threshold shares at least one."""
    return n - (n * num + den - 1) // den + 1


# ---- routing -------------------------------------------------------------------------

_HEAD = np.dtype([("cell", "<i8"), ("id", "<i8"), ("nth", "<u4"), ("size", "<u4"), ("hashed", "<u4"), ("side", "i1"), ("whole", "i1")])


def _by_column(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Heads of each blob turned so that equal bytes of all its records stand together: they compress better."""
    w, out = _HEAD.itemsize, np.empty_like(raw)
    for a, z in zip(ends[:-1] * w, ends[1:] * w):
        out[a:z] = raw[a:z].reshape(-1, w).T.ravel()
    return out


def _by_record(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Heads of all blobs, record by record."""
    w, out = _HEAD.itemsize, np.empty_like(raw)
    for a, z in zip(at[:-1], at[1:]):
        out[a:z] = raw[a:z].reshape(w, -1).T.ravel()
    return np.frombuffer(out.tobytes(), _HEAD)


class _Replicas:
    """One row per set of a batch and token of its prefix."""

    def __init__(self, batch: pa.RecordBatch, num: int, den: int, top_hash: np.ndarray):
        names = batch.schema.names
        col = lambda c: batch.column(names.index(c))
        self.n, self.r = np.asarray(col("size")).astype(np.int64), np.asarray(col("hashed")).astype(np.int64)
        self.raw, self.at = raw_of(col("tokens"))
        tokens, off = unpacked(self.raw, self.at[:-1], self.r, self.n)
        p = prefix_length(self.n, num, den)
        self.src = np.repeat(np.arange(len(self.n)), p)
        self.nth = np.arange(len(self.src)) - np.repeat(np.cumsum(p) - p, p)
        self.token = tokens[off[:-1][self.src] + self.nth]
        h = np.where(self.token >= 0, top_hash[np.maximum(self.token, 0)], self.token)
        self.cell = mix(np.asarray(col("gk"))[self.src], h)
        self.id, self.side = np.asarray(col("rep")), np.asarray(col("side"))

    def heads(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heads, packed tokens, their offsets) of some replicas."""
        src = self.src[take]
        out = np.empty(len(take), _HEAD)
        out["cell"], out["id"], out["nth"] = self.cell[take], self.id[src], self.nth[take]
        out["size"], out["hashed"], out["side"] = self.n[src], self.r[src], self.side[src]
        out["whole"] = self.n[src] <= LONG
        length = np.where(out["whole"] == 1, self.at[1:][src] - self.at[:-1][src], 0)
        return out, self.raw[ranges(self.at[:-1][src], length)], np.concatenate([[0], np.cumsum(length)])


def pairs_by_cell(sets: Sets, threshold: float, solve: Callable[[Block, int, int], Iterator[pa.RecordBatch]], between: bool, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of classes ``a, b, overlap, size_a, size_b, spans, longest`` that ``solve`` finds block by block.

    ``solve(block, num, den)`` yields each pair only in the cell of its first common
    token.  ``spans`` and ``longest`` are for solvers that find runs, else null.
    """
    spark, reps = sets.rows.sparkSession, sets.classes()
    num, den = ratio(threshold)
    top_hash, frequency = sets.top_hash, sets.frequency
    n = F.col("size")
    stats = sets.rows.agg(F.sum(n - F.ceil(n * num / den) + 1), F.max(n)).first()
    replicas, longest = stats[0] or 0, stats[1] or 0
    # a cell holds no more records than its token: only these tokens can make one too large
    hot_token = np.append(frequency > cell_rows, len(frequency) >= TOP_TOKENS and frequency[0] > cell_rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(4 * parts, int(replicas // block_rows) + 1)
    slim = reps

    def suspect(x: _Replicas) -> np.ndarray:
        return hot_token[np.where(x.token >= 0, x.token, len(hot_token) - 1)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _Replicas(batch, num, den, top_hash)
                cell, k = np.unique(x.cell[suspect(x)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k)], ["cell", "n"])

    hot = None
    if hot_token.any():
        hot = slim.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > cell_rows)
        hot = cut(hot.select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("k")))
        hot = None if hot.isEmpty() else hot
    split = hot is not None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replicas as one row per block and batch."""
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                x = _Replicas(batch.slice(i, 5000), num, den, top_hash)
                block = np.mod(x.cell, blocks)
                order = np.argsort(block, kind="stable")
                if split:
                    order = order[~suspect(x)[order]]
                heads, raw, at = x.heads(order)
                b = block[order]
                first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
                ends = np.append(first, len(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[first]), pa.nulls(len(first), pa.int64()), pa.array(np.zeros(len(first), np.int32)), binary(_by_column(np.frombuffer(heads.tobytes(), np.uint8), ends), ends * _HEAD.itemsize), binary(raw, at[ends])],
                    ["block", "cell", "role", "heads", "tokens"],
                )

    schema = "block long, cell long, role int, heads binary, tokens binary"
    put = slim.mapInArrow(route, schema)
    if split:

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Replicas with a suspect token, one row each."""
            for batch in batches:
                for i in range(0, batch.num_rows, 5000):
                    x = _Replicas(batch.slice(i, 5000), num, den, top_hash)
                    take = np.flatnonzero(suspect(x))
                    heads, raw, at = x.heads(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(heads["cell"]), pa.array(heads["id"]), pa.array(heads["side"].astype(np.int32)), binary(np.frombuffer(heads.tobytes(), np.uint8), np.arange(len(take) + 1) * _HEAD.itemsize), binary(raw, at)],
                        ["cell", "id", "side", "heads", "tokens"],
                    )

        c, every = F.pmod(F.xxhash64("id"), F.col("k")).cast("int"), F.sequence(F.lit(0), F.col("k") - 1)
        if between:  # side 0 probes, side 1 is indexed
            spread = F.when(F.col("side") == 0, F.transform(every, lambda j: F.struct(c.alias("i"), j.alias("j"), F.lit(1).alias("role")))).otherwise(
                F.transform(every, lambda i: F.struct(i.alias("i"), c.alias("j"), F.lit(2).alias("role")))
            )
        else:
            role = lambda x: F.when(x == c, 0).when(c < x, 1).otherwise(2)
            spread = F.transform(every, lambda x: F.struct(F.least(c, x).alias("i"), F.greatest(c, x).alias("j"), role(x).alias("role")))
        rows = slim.mapInArrow(single, "cell long, id long, side int, heads binary, tokens binary").join(hot, "cell", "left")
        plain = rows.where("k is null").select(F.pmod("cell", F.lit(blocks)).alias("block"), F.lit(None).cast("long").alias("cell"), F.lit(0).alias("role"), "heads", "tokens")
        own = F.xxhash64("cell", "s.i", "s.j")
        wide = rows.where("k is not null").withColumn("s", F.explode(spread)).select(own.alias("block"), own.alias("cell"), F.col("s.role").alias("role"), "heads", "tokens")
        put = put.unionByName(plain).unionByName(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(list(batches), between)
        yield from candidates(block, num, den)
        yield from solve(block.whole(), num, den)

    found = put.repartition(max(parts, min(blocks, 10 * parts)) if split else parts, "block").groupBy("block").applyInArrow(run, PAIRS)
    return found if longest <= LONG else _verified(cut(found), reps, num, den)


def _verified(found: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs found, those of long sets (overlap -1) once each and checked by their tokens."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("hashed").alias(f"hashed_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    open_ = found.where("overlap < 0").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, sa, ha, ta, sb, hb, tb in zip(*(batch.column(c).to_pylist() for c in range(8))):
                x, y = (unpacked(np.frombuffer(t, np.uint8), np.array([0]), np.array([h]), np.array([n]))[0] for n, h, t in ((sa, ha, ta), (sb, hb, tb)))
                both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                if len(both) * (num + den) >= num * (sa + sb):
                    run = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
                    rows.append((a, b, len(both), sa, sb, len(run), int(np.diff(np.append(run, len(i))).max())))
            yield pairs_batch(*(np.array([r[c] for r in rows], np.int64) for c in range(7)))

    columns = ["a", "b", "size_a", "hashed_a", "tokens_a", "size_b", "hashed_b", "tokens_b"]
    return found.where("overlap >= 0").unionByName(open_.select(*columns).mapInArrow(check, PAIRS))


def pairs_batch(a, b, overlap, size_a, size_b, spans=None, longest=None) -> pa.RecordBatch:
    i32 = lambda x: pa.array(x.astype(np.int32)) if x is not None else pa.nulls(len(a), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), i32(overlap), i32(size_a), i32(size_b), i32(spans), i32(longest)], ["a", "b", "overlap", "size_a", "size_b", "spans", "longest"])


# ---- blocks --------------------------------------------------------------------------


class Block:
    """Records of one block in the order of cell, size and id, with their tokens."""

    def __init__(self, batches: list[pa.RecordBatch], between: bool):
        heads, cells, roles, raws = [], [], [], []
        for b in batches:
            raw, at = raw_of(b.column(3))
            x = _by_record(raw, at)
            n = np.diff(at) // _HEAD.itemsize
            own = np.repeat(np.asarray(b.column(1).fill_null(0)), n)
            cells.append(np.where(np.repeat(np.asarray(b.column(1).is_valid()).astype(bool), n), own, x["cell"]))
            roles.append(np.repeat(np.asarray(b.column(2)), n))
            raws.append(raw_of(b.column(4))[0])
            heads.append(x)
        h, cell, role, raw = map(np.concatenate, (heads, cells, roles, raws))
        size, hashed = h["size"].astype(np.int64), h["hashed"].astype(np.int64)
        whole = h["whole"] == 1
        length = np.where(whole, 8 * hashed + 2 * (size - hashed), 0)
        at = np.cumsum(length) - length
        order = np.lexsort((h["id"], size, cell))
        kept = np.where(whole, size, 0)[order]
        self.tokens, self.off = unpacked(raw, at[order], np.where(whole, hashed, 0)[order], kept)
        self._set(cell[order], size[order], h["id"][order], h["nth"][order].astype(np.int64), role[order], h["side"][order], whole[order], between)

    def _set(self, cell, size, id_, nth, role, side, is_whole, between):
        self.cell, self.size, self.id, self.nth, self.role, self.side, self.is_whole, self.between = cell, size, id_, nth, role, side, is_whole, between
        self.apart = (role == 1) | between  # such probes meet rows of another chunk or side
        self.probes = (role != 2) if not between else (side == 0)
        self.indexed = (role != 1) if not between else (side == 1)
        _, self.first, self.cell_no = np.unique(cell, return_index=True, return_inverse=True)

    def whole(self) -> Block:
        """The records that brought their tokens."""
        if self.is_whole.all():
            return self
        b, k = object.__new__(Block), self.is_whole
        b.tokens, b.off = self.tokens, np.concatenate([[0], np.cumsum(self.size[k])])
        b._set(self.cell[k], self.size[k], self.id[k], self.nth[k], self.role[k], self.side[k], k[k], self.between)
        return b

    def partners(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probes, from, to): the rows of each probe's cell whose sizes are within reach; a pair of one chunk from its later row."""
        stop = np.append(self.first[1:], len(self.cell))[self.cell_no]
        p = np.flatnonzero(self.probes & (stop - self.first[self.cell_no] > 1))
        m, width = self.size[p], int(self.size.max(initial=0)) + 2
        place = self.cell_no * width + self.size
        lo = np.searchsorted(place, self.cell_no[p] * width + (m * num + den - 1) // den)
        hi = np.where(self.apart[p], np.searchsorted(place, self.cell_no[p] * width + np.minimum(m * den // num, width - 1), side="right"), p)
        some = lo < hi
        return p[some], lo[some], hi[some]


def candidates(b: Block, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs with a long set that the places of their common token don't rule out, to be verified later (overlap -1)."""
    if b.is_whole.all():
        return
    p, lo, hi = b.partners(num, den)
    n = hi - lo
    step = np.cumsum(n) // 500_000
    for s in np.unique(step):
        k = step == s
        x, y = np.repeat(p[k], n[k]), ranges(lo[k], n[k])
        need = -(-num * (b.size[x] + b.size[y]) // (num + den))
        most = 1 + np.minimum(b.size[x] - b.nth[x], b.size[y] - b.nth[y]) - 1
        ok = b.indexed[y] & ~(b.is_whole[x] & b.is_whole[y]) & (most + np.minimum(b.nth[x], b.nth[y]) >= need)
        x, y = b.id[x[ok]], b.id[y[ok]]
        if not b.between:
            x, y = np.minimum(x, y), np.maximum(x, y)
        yield pairs_batch(x, y, np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)))
