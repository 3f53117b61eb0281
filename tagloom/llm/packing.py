"""Filling fixed-capacity containers with whole texts: bounded-space best fit."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OpenBins:
    """A fixed number of open bins; those with an equal free space share a bit of a bitset.

    An item goes to the open bin with the least free space that holds it.  Where none
    does, a bin is opened, and if too many are open the fullest is closed first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        b = at.pop()
        if not at:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, size: int) -> int:
        """The bin of an item of 1 <= size <= capacity."""
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = self._take(free)
        else:
            # an item that fills a bin leaves none open, so none is closed for it
            if size < self.capacity and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.open += 1
        return b


def token_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Makes a counter of tokens from a file of byte-pair ranks; run once per task."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]

    return make


def public_counter(name: str = "byte_bpe_50k.tiktoken", path: str | None = None):
    """Counter of a public tokenizer; ``path`` overrides where its file lies."""
    import public_tokenizers as P

    return token_counter(path or P.path(name), P.PATTERN)


def pack(docs: DataFrame, doc_id: str, text: str, counter, capacity: int = 2048, open_bins: int = 128) -> DataFrame:
    """``doc_id, part, first_token, n_tokens, container``: each text with its containers.

    A text of at most ``capacity`` tokens lies whole in one container; a longer one is
    cut into parts of ``capacity`` tokens and a rest, ``first_token`` being where a part
    begins.  Null and empty texts have no tokens and come out once with part 0 and a null
    container.  Rows are packed where they are read, without a shuffle; the rows of equal
    ids are packed each for itself.  Container numbers are unique over all tasks.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, bins = counter(), OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for d, n in zip(b["doc_id"], count([t if isinstance(t, str) else "" for t in b["t"]])):
                if not n:
                    out.append((d, 0, 0, 0, None))
                for part, first in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - first)
                    out.append((d, part, first, size, base + bins.place(size)))
            yield pd.DataFrame(out, columns=["doc_id", "part", "first_token", "n_tokens", "container"]).astype({"container": "Int64"})

    return slim.mapInPandas(run, f"doc_id {kind}, part int, first_token int, n_tokens int, container long")
