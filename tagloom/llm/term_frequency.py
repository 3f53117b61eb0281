"""Frequency of every distinct value: occurrences and records, with bounds for use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_counts(values: DataFrame, record: str, term: Column) -> DataFrame:
    """``term, occurrences, records`` over rows of one value each.

    Two hash aggregations: first one state per record and term (values of a record stand
    together, so most collapse before the shuffle), then sums per term, again combined
    by each task before its rows are shuffled: a term in a third of all records sends
    one row per task.  Null terms are no term; a null record is one record.
    """
    per_record = values.select(F.col(record).alias("__record"), term.alias("term")).where(F.col("term").isNotNull()).groupBy("__record", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def array_term_counts(records: DataFrame, terms: Column, unpack: Callable | None = None, clean: Callable[[str], str] | None = None, with_total: bool = False) -> DataFrame:
    """``term, occurrences, records`` over one array of terms per row, without a shuffle by record.

    Each batch becomes the term counts of its records and their sums by hash, so one row
    per batch and term is left for JVM's own partial sums and the single shuffle by term.
    Null arrays and null elements are left out.  ``unpack`` makes a function from the
    column's Arrow arrays to arrays of terms (see :func:`tagloom.operators.packed.unpacked`);
    ``clean`` maps a term to the form that counts.  With ``with_total`` a row of the null
    term counts the records that hold any term, so they are read once for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = unpack() if unpack else None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = split(batch.column(0)) if split else batch.column(0)
            row = pc.list_parent_indices(lists)
            flat = lists.flatten()
            there = flat.is_valid()
            row, coded = np.asarray(row.filter(there)), flat.filter(there).dictionary_encode()
            names = coded.dictionary.to_pylist()
            if clean:
                merged = pa.array([clean(x) for x in names], pa.string()).dictionary_encode()
                code, names = np.asarray(merged.indices)[np.asarray(coded.indices)], merged.dictionary.to_pylist()
            else:
                code = np.asarray(coded.indices)
            k = len(names)
            occurrences = np.bincount(code, minlength=k)
            held = np.bincount(np.unique(row.astype(np.int64) * max(k, 1) + code) % max(k, 1), minlength=k)
            if with_total:
                names, occurrences, held = [*names, None], np.append(occurrences, 0), np.append(held, len(np.unique(row)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(occurrences), pa.array(held)], ["term", "occurrences", "records"])

    rows = records.select((terms if unpack else terms.cast("array<string>")).alias("t")).mapInArrow(run, "term string, occurrences long, records long")
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_by_frequency(counts: DataFrame, total: DataFrame, least: int = 3, most: float = 0.05) -> DataFrame:
    """Adds ``mark``: rare below ``least`` records, common above the share ``most`` of ``total`` (one row ``total``), else null."""
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") / F.col("total") > most, "common")
    return counts.join(F.broadcast(total)).withColumn("mark", mark).drop("total")
