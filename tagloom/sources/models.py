"""Models behind plain functions: classification of strings by a client, embedding of names.

A client is any function from a prompt to a reply; none is called unless the caller
brings one.  The embedding has a default that needs no model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.sources.files import append_new, read_or_empty, unwrap_reply

#: Strings in one prompt, and calls for it before its strings are left for a later run.
BATCH = 40
TRIES = 3

REPLY = "array<struct<raw: string, canonical: string, category: string>>"


def replies(strings: DataFrame, client: Callable[[str], str], prompt: Callable[[list[str]], str], batch: int = BATCH, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """``strings, reply, error``: the client's reply to each ``batch`` of the column ``raw``, tried again after a longer wait."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in range(0, len(part), batch):
                own = part["raw"].iloc[i : i + batch].tolist()
                reply, error = None, None
                for k in range(tries):
                    try:
                        reply, error = client(prompt(own)), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k if k + 1 < tries else 0)
                out.append((own, reply, error))
            yield pd.DataFrame(out, columns=["strings", "reply", "error"])

    return strings.select("raw").mapInPandas(run, "strings array<string>, reply string, error string")


def classify(counts: DataFrame, client: Callable[[str], str], prompt: Callable[[list[str]], str], path: str, **options) -> DataFrame:
    """Appends ``raw, count, canonical, category`` of the strings in ``counts`` that the artifact lacks; returns them.

    Replies that can't be read, and strings that a reply doesn't name, are left out, so
    the next run asks for them again.
    """
    schema = "raw string, count long, canonical string, category string"
    done = read_or_empty(counts.sparkSession, path, schema).select("raw")
    open_ = counts.select("raw", F.col("count").cast("long").alias("count")).join(done, "raw", "left_anti")
    got = replies(open_, client, prompt, **options).where("reply is not null")
    rows = got.select(F.explode(F.from_json(unwrap_reply(F.col("reply")), REPLY)).alias("x"))
    named = rows.select(F.trim("x.raw").alias("raw"), F.trim("x.canonical").alias("canonical"), F.lower(F.trim("x.category")).alias("category")).where("raw is not null and category is not null")
    return append_new(open_.join(named.dropDuplicates(["raw"]), "raw").select("raw", "count", "canonical", "category"), path, "raw")


def ngram_vectors(names: list[str], size: int = 384) -> np.ndarray:
    """Vectors of names without a model: hashed runs of two to four letters, the word's edges included."""
    out = np.zeros((len(names), size))
    for i, name in enumerate(names):
        x = f" {name.lower().strip()} "
        for n in (2, 3, 4):
            for k in range(len(x) - n + 1):
                h = int.from_bytes(blake2b(x[k : k + n].encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
    return out


def embed_names(names: DataFrame, column: str, embed: Callable[[list[str]], np.ndarray] = ngram_vectors) -> DataFrame:
    """``names`` with ``v``, the unit vector of each name; null names have a null vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(b.schema.names.index(column)).to_pylist()
            m = np.asarray(embed([t or "" for t in texts]), np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(x) if t is not None else None for x, t in zip(m, texts)], pa.list_(pa.float64()))], [*b.schema.names, "v"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema)
    return names.mapInArrow(run, f"{fields}, v array<double>")
