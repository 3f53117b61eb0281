"""Mapping freely entered values to a reference list: token repair and soft TF-IDF.

1. *Phrases said around names* are learned from the values themselves: a run of tokens at
   an edge, numbers by their shape, is one if what remains is, for most of the values
   that have it, the name of an entry, and of several different entries.
2. *Token-level repair*: each distinct token of the values is joined to the tokens of the
   reference list by edit distance; a longer token may have more slips.
3. *Soft TF-IDF*: complete entries are ranked by the weights of the corrected tokens they
   share with a value.  The weights of the shared tokens must cover value and entry
   almost wholly; where they don't cover all, the best entry must lead by a margin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.plans.lineage import cut

#: Entries that are sent to the tasks at once; a longer reference list goes in shards.
ENTRIES_AT_ONCE = 50_000
#: Tokens of a phrase at most, entries and share of its values that make a phrase.
PHRASE_TOKENS = 4
PHRASE_ENTRIES = 3
PHRASE_SHARE = 0.5
#: Phrases that are sent to the tasks; more of them are an error.
MOST_PHRASES = 100_000
#: Letters of a token per allowed slip, and slips at most.
LETTERS_PER_EDIT = 5
MOST_EDITS = 2
#: Least cosine of the shared tokens, and the lead of an entry that isn't shared wholly.
COVER = 0.85
MARGIN = 0.05

_CUT = re.compile(r"(?:[^\w+#.]|_)+")
_CHARS = re.compile(r"[^\w+#]|_")
_FIXED = re.compile(r"[^0-9+#]")
_DIGITS = re.compile(r"\d+")


def _plain(name: str) -> str:
    x = name if name.isascii() else "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return x.lower().replace("&", " and ")


def name_tokens(name: str) -> list[str]:
    """Tokens of a name: lower case, without accents, split at white space and marks, dots left out."""
    return [t for t in (y.replace(".", "") for y in _CUT.split(_plain(name))) if t]


def name_key(name: str) -> str:
    """The letters, digits and signs of a name."""
    return _CHARS.sub("", _plain(name))


def token_shapes(name: str) -> list[str]:
    """For each token of a name how it is written: dots kept inside, each number as 0."""
    return [_DIGITS.sub("0", y.strip(".")) for y in _CUT.split(_plain(name)) if y.replace(".", "")]


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            k = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                k = min(k, older[j - 2] + 1)
            row.append(k)
        older, old = old, row
    return old[-1]


def allowed_edits(letters: int) -> int:
    """Slips allowed between two tokens of which the longer has so many letters."""
    return min(MOST_EDITS, letters // LETTERS_PER_EDIT)


def _deletions(x: str, edits: int) -> set[str]:
    out = last = {x}
    for _ in range(edits):
        last = {y[:i] + y[i + 1 :] for y in last for i in range(len(y))}
        out = out | last
    return out


class TokenRepair:
    """The join of tokens to reference tokens by edit distance.

    Two tokens within k edits become equal by k deletions in each.  Tokens of more than
    ``LONG`` letters would have too many deletions; these are cut into 2 k + 1 pieces, of
    which k edits, swaps included, leave one unchanged.
    """

    LONG = 40

    def __init__(self, tokens: set[str]):
        self.tokens = tokens
        self.names = sorted(tokens)
        at, hashes = [], []
        self.pieces: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for i, t in enumerate(self.names):
            # a partner may be longer by the edits and so be allowed more of them
            k = allowed_edits(len(t) + MOST_EDITS)
            if len(t) > self.LONG - MOST_EDITS:
                for j, (a, z) in enumerate(self._cuts(len(t))):
                    self.pieces[len(t), j, t[a:z]].append(t)
            if len(t) <= self.LONG + MOST_EDITS:
                found = [hash(y) for y in _deletions(t, k)]
                hashes += found
                at += [i] * len(found)
        order = np.argsort(np.array(hashes, np.int64), kind="stable")
        self.hashes, self.at = np.array(hashes, np.int64)[order], np.array(at, np.int32)[order]

    @staticmethod
    def _cuts(n: int) -> list[tuple[int, int]]:
        k = 2 * MOST_EDITS + 1
        return [(n * j // k, n * (j + 1) // k) for j in range(k)]

    def _candidates(self, token: str, k: int) -> set[str]:
        if len(token) <= self.LONG:
            h = np.array([hash(y) for y in _deletions(token, k)], np.int64)
            lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            return {self.names[self.at[p]] for a, z in zip(lo, hi) for p in range(a, z)}
        out: set[str] = set()
        for n in range(len(token) - k, len(token) + k + 1):
            for j, (a, z) in enumerate(self._cuts(n)):
                for shift in range(-k, k + 1):
                    if a + shift >= 0:
                        out.update(self.pieces.get((n, j, token[a + shift : z + shift]), ()))
        return out

    def __call__(self, token: str) -> list[tuple[str, int]]:
        """(reference token, edits) within what its letters allow; a changed digit or sign is another name, not a slip."""
        k = allowed_edits(len(token) + MOST_EDITS)
        found = []
        if k:
            fixed = _FIXED.sub("", token)
            for t in self._candidates(token, k):
                most = allowed_edits(max(len(t), len(token)))
                if abs(len(t) - len(token)) <= most and _FIXED.sub("", t) == fixed and (d := edit_distance(token, t)) <= most:
                    found.append((t, d))
        elif token in self.tokens:
            found.append((token, 0))
        return sorted(found, key=lambda x: (x[1], x[0]))


class SoftRank:
    """Ranks complete entries for a value by soft TF-IDF over its repaired tokens."""

    def __init__(self, names: list[str], idf: dict[str, float], rare: float):
        self.names, self.idf, self.rare = names, idf, rare
        self.tokens = [name_tokens(n) for n in names]
        self.square = [sum(idf[t] ** 2 for t in ts) for ts in self.tokens]
        self.holding: dict[str, list[int]] = defaultdict(list)
        self.glued: dict[str, list[int]] = defaultdict(list)
        for i, ts in enumerate(self.tokens):
            for t in set(ts):
                self.holding[t].append(i)
            self.glued[name_key(names[i])].append(i)
        self.repair = TokenRepair({*self.holding, *self.glued})
        self.known: dict[str, list[tuple[str, int]]] = {}

    def near(self, token: str) -> list[tuple[str, int]]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[token] = self.repair(token)
        return got

    def _score(self, entry: int, tokens: list[str], options: list[list[tuple[str, int]]]) -> tuple[float, int, bool] | None:
        """(score, edits, whole) of an entry; None if the shared tokens don't cover enough."""
        left, both, soft, alone, edits = list(self.tokens[entry]), 0.0, 0.0, 0.0, 0
        for t, near in zip(tokens, options):
            m = next(((x, d) for x, d in near if x in left), None)
            if m is None:
                alone += self.idf.get(t, self.rare) ** 2
                continue
            left.remove(m[0])
            w = self.idf[m[0]] ** 2
            both += w
            soft += w * (1 - m[1] / max(len(t), len(m[0])))
            edits += m[1]
        cover = both / math.sqrt((both + alone) * self.square[entry]) if both else 0.0
        whole = not left and not alone
        # a slip in a name that isn't given wholly counts against its cover
        return (cover * soft / both, edits, whole) if cover * (1 if whole else soft / max(both, 1e-9)) >= COVER else None

    def __call__(self, tokens: list[str]) -> list[tuple[float, int, bool, int]]:
        """(score, edits, whole, entry) of the entries that a value's tokens cover."""
        key = "".join(tokens)
        # slips are looked for only where no entry is written as it stands
        for repaired in (False, True):
            find = self.near if repaired else lambda t: [(t, 0)] if t in self.repair.tokens else []
            found: dict[int, tuple[float, int, bool]] = {}
            for t, d in find(key):  # written in one piece, or cut elsewhere
                for e in self.glued.get(t, ()):
                    found[e] = (1 - d / max(len(key), len(t), 1), d, True)
            options = [[(x, d) for x, d in find(t) if x in self.holding] for t in tokens]
            square = [max([self.idf[x] ** 2 for x, _ in o], default=self.idf.get(t, self.rare) ** 2) for t, o in zip(tokens, options)]
            # the rarest tokens, until the others alone can't cover an entry
            rest = total = sum(square)
            for i in sorted(range(len(tokens)), key=lambda i: -square[i]):
                if rest < COVER**2 * total:
                    break
                rest -= square[i]
                for x, _ in options[i]:
                    for e in self.holding[x]:
                        s = self._score(e, tokens, options)
                        if s and s > found.get(e, (0.0, 0, False)):
                            found[e] = s
            if found:
                return [(*s, e) for e, s in found.items()]
        return []


class Phrases:
    """What is said around names: runs of shapes at either edge."""

    def __init__(self, before: set[str], after: set[str]):
        self.before, self.after = before, after

    def core(self, shapes: list[str]) -> tuple[int, int]:
        """Where the name begins and ends; at least one token is left."""
        a, z = 0, len(shapes)
        while True:
            for n in range(min(PHRASE_TOKENS, z - a - 1), 0, -1):
                if " ".join(shapes[a : a + n]) in self.before:
                    a += n
                    break
                if " ".join(shapes[z - n : z]) in self.after:
                    z -= n
                    break
            else:
                return a, z


def _edge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of tokens at both edges of each value and the letters that remain; the value itself as a run of none."""
    for batch in batches:
        rows = []
        for v in batch.column(0).to_pylist():
            shapes, tokens = token_shapes(v), name_tokens(v)
            n = len(tokens)
            if n < 2:
                continue
            for k in range(min(PHRASE_TOKENS, n - 1) + 1):
                rows.append((v, "before", k, " ".join(shapes[:k]), "".join(tokens[k:])))
                rows.append((v, "after", k, " ".join(shapes[n - k :]), "".join(tokens[: n - k])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["raw", "side", "k", "phrase", "rest"])


def learn_phrases(values: DataFrame, known: DataFrame) -> Phrases:
    """Phrases around names, from the distinct values in column ``raw`` and the entries in ``name``.

    A run speaks for a phrase where it is the shortest of its edge that leaves an entry's
    name; a value none of whose runs does speaks against all of them; a value that is a
    name as it stands teaches nothing.
    """

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([name_key(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(0)], ["rest", "entry"])

    entry = known.select("name").mapInArrow(with_key, "rest string, entry string").groupBy("rest").agg(F.min("entry").alias("entry"))
    runs = _spread(values).mapInArrow(_edge_runs, "raw string, side string, k int, phrase string, rest string").join(entry, "rest", "left")
    hit = F.min(F.when(F.col("entry").isNotNull(), F.col("k")))
    per = runs.groupBy("raw", "side").agg(hit.alias("first"), F.collect_list(F.struct("k", "phrase", "entry")).alias("runs"))  # PHRASE_TOKENS + 1 runs at most
    told = per.where("first is null or first > 0").select("side", "first", F.explode("runs").alias("r")).where("r.k > 0 and (first is null or r.k = first)")
    stats = told.groupBy("side", "r.phrase").agg(F.count_distinct("r.entry").alias("entries"), F.count("first").alias("hit"), F.count(F.lit(1)).alias("n"))
    rows = stats.where((F.col("entries") >= PHRASE_ENTRIES) & (F.col("hit") >= PHRASE_SHARE * F.col("n"))).select("side", "phrase").take(MOST_PHRASES + 1)
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases; raise PHRASE_ENTRIES")
    return Phrases({p for s, p in rows if s == "before"}, {p for s, p in rows if s == "after"})


def _spread(values: DataFrame) -> DataFrame:
    """In a stated number of partitions: few bytes mean much work here."""
    return values.select("raw").repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_RANKED = "raw string, score double, edits int, whole boolean, live boolean, name string"


def _ranked(values: DataFrame, shard: list[tuple[str, bool]], phrases: Phrases, idf: dict[str, float], rare: float) -> DataFrame:
    """The best two entries of each value among those of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = SoftRank([n for n, _ in shard], idf, rare)
        live = [a for _, a in shard]
        order = lambda x: (-x[0], x[1], not live[x[3]], best.names[x[3]])
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                tokens = name_tokens(raw)
                found = best(tokens) if tokens else []
                if not any(w and not e for _, e, w, _ in found):
                    a, z = phrases.core(token_shapes(raw))
                    if z - a < len(tokens):
                        found = [*found, *best(tokens[a:z])]
                seen: set[int] = set()
                for s, e, w, i in sorted(found, key=order):
                    if i not in seen and len(seen) < 2:
                        seen.add(i)
                        rows.append((raw, s, e, w, live[i], best.names[i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()))], ["raw", "score", "edits", "whole", "live", "name"])

    return values.select("raw").mapInArrow(run, _RANKED)


def to_canonical(values: DataFrame, raw: str, reference: DataFrame, decided: DataFrame | None = None, retired: DataFrame | None = None, at_once: int = ENTRIES_AT_ONCE) -> DataFrame:
    """``raw, canonical`` of each distinct non-null value, canonical '' where it names no entry.

    ``reference``: one column of entry names.  ``decided``: (raw, canonical) of earlier
    decisions, which hold as they stand; a null canonical, or one not in the reference
    list, means none.  ``retired``: names that are no longer entries; a value that names
    one of them names none.  A token of n letters may have n / 5 slips, two at most.
    Ties go to the higher score, then the fewest edits, then the name.  Empty values, and
    any value where the reference list is empty, name none.
    """
    # written once: the phrases are learned from it and it is ranked, and its values may be costly to make
    distinct = cut(values.select(F.col(raw).alias("raw")).where(F.col("raw").isNotNull()).distinct())
    ref = reference.toDF("name").where("name is not null").distinct()
    known = ref.withColumn("live", F.lit(True))
    if retired is not None:
        gone = retired.toDF("name").where("name is not null").distinct().join(ref, "name", "left_anti")
        known = known.unionByName(gone.withColumn("live", F.lit(False)))
    known = cut(known)
    said = distinct
    if decided is not None:
        d = decided.toDF("raw", "name").where("raw is not null").groupBy("raw").agg(F.min("name").alias("name"))
        said = distinct.unionByName(d.select("raw")).distinct()
        d = d.join(known.where("live").withColumnRenamed("live", "hit"), "name", "left").select("raw", F.when(F.col("hit"), F.col("name")).otherwise("").alias("decided"))
        both = distinct.join(d, "raw", "left")
        settled, open_ = both.where("decided is not null").select("raw", F.col("decided").alias("canonical")), both.where("decided is null").select("raw")
    else:
        settled, open_ = None, distinct

    n = known.count()
    shards = _shards(known, n, at_once)
    phrases = learn_phrases(said, known)
    rare = math.log(1 + n)
    ranked = None
    for shard in shards:
        got = _ranked(_spread(open_), shard, phrases, _idf(known, shard, n, len(shards)), rare)
        ranked = got if ranked is None else ranked.unionByName(got)
    if ranked is None:
        named = open_.select("raw", F.lit("").alias("canonical"))
    else:
        # the best two of each shard settle it: one order, whatever the shards
        order = F.struct((-F.col("score")).alias("s"), "edits", (~F.col("live")).alias("l"), "name", "whole")
        two = ranked.groupBy("raw").agg(F.min(order).alias("a"), F.array_sort(F.collect_list("score")).alias("all"))
        lead = F.when(F.size("all") > 1, F.element_at("all", -1) - F.element_at("all", -2)).otherwise(1.0)
        ok = (F.col("a.whole") | (lead >= MARGIN)) & ~F.col("a.l")
        two = two.select("raw", F.when(ok, F.col("a.name")).otherwise("").alias("canonical"))
        named = open_.join(two, "raw", "left").select("raw", F.coalesce("canonical", F.lit("")).alias("canonical"))
    return named if settled is None else settled.unionByName(named)


def _shards(known: DataFrame, n: int, at_once: int) -> list[list[tuple[str, bool]]]:
    """The entries in lists of about ``at_once``, each by a hash of the name."""
    k = math.ceil(n / at_once)
    part = F.pmod(F.xxhash64("name"), F.lit(max(k, 1)))
    return [[(r[0], r[1]) for r in known.where(part == s).orderBy("name").collect()] for s in range(k)]


def _idf(known: DataFrame, shard: list[tuple[str, bool]], n: int, shards: int) -> dict[str, float]:
    """Weights of a shard's tokens, by the entries of all shards that hold them."""
    own = {t for name, _ in shard for t in name_tokens(name)}
    if shards == 1:
        held = Counter(t for name, _ in shard for t in set(name_tokens(name)))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = Counter(t for name in batch.column(0).to_pylist() for t in set(name_tokens(name)) & own)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["t", "n"])

        held = dict(known.select("name").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n")).collect())
    return {t: math.log(1 + n / held[t]) for t in own}
