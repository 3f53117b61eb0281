import os
from pathlib import Path

import duckdb
import numpy as np
import pytest

from oracle import DATA, check
from tagloom.operators.sweep import blended_hits
from tagloom.plans.lineage import release, shared_folder
from tagloom.queries import ORACLE, QUERIES

MODES = [(0.0, "fixed"), (0.3, "fixed"), (0.3, "adaptive"), (1.0, "fixed"), (1.0, "adaptive")]


def brute(baskets, base, others, trust, copies):
    """Rows of the sweep from dense matrices, candidate by candidate."""
    names, out = sorted(copies), []
    for kind, a in others.items():
        for alpha, mode in MODES:
            ranks = []
            for known, masked in baskets:
                rows = [i for i in known if i in copies]
                score = {}
                for j in names if rows else []:
                    w = [alpha * (np.sqrt(trust[i] * trust[j]) if mode == "adaptive" else 1) for i in rows]
                    if j not in known:
                        score[j] = round(sum(x * copies[i] * copies[j] * a[i, j] + (1 - x) * base[i, j] for x, i in zip(w, rows)), 6)
                order = sorted(score, key=lambda j: (-score[j], j))
                ranks += [order.index(t) + 1 for t in masked if t in score]
            out.append((alpha, mode, *(round(np.mean([r <= k for r in ranks]), 6) for k in (5, 10, 20)), round(np.mean([1 / r for r in ranks]), 6), len(ranks), kind))
    return sorted(out)


def test_blended_hits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    names = [f"n{i:02}" for i in range(30)]
    copies = {x: 2 if i == 7 else 1 for i, x in enumerate(names) if i not in (4, 11)}  # two have no vector, one has two
    cell = {(i, j): float(rng.normal()) for i in copies for j in copies}
    rows = [(i, j, v / (copies[i] * copies[j])) for (i, j), v in cell.items() for _ in range(copies[i] * copies[j])]
    base = spark.createDataFrame(rows, "i string, j string, v double")
    kinds, tables = {}, {}
    for kind, zero in (("p", -0.25), ("q", 0.5)):
        there = {(i, j): float(rng.integers(0, 3)) for i in names for j in names if rng.random() < 0.3 and i != names[2]}  # many ties, and a row without cells
        kinds[kind] = {(i, j): there.get((i, j), zero) for i in names for j in names}
        tables[kind] = spark.createDataFrame([(i, j, v) for (i, j), v in there.items()], "i string, j string, v double"), zero
    trust = {x: float(rng.random()) for x in names}
    baskets = []
    for _ in range(300):
        x = [names[i] for i in rng.permutation(30)[: rng.integers(2, 9)]]
        baskets.append((x[1:], x[:1]) if len(x) < 4 else (x[2:], x[:2]))
    baskets += [([names[4]], [names[5]]), ([names[5]], [names[11]]), ([names[4], names[11]], [names[6]])]
    df = spark.createDataFrame(baskets, "known array<string>, masked array<string>").repartition(3)
    got = blended_hits(df, base, tables, trust, copies, MODES)
    assert got.columns == ["alpha", "mode", "hits_5", "hits_10", "hits_20", "mrr", "n_targets", "structural"]
    assert sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got.collect()) == brute(baskets, cell, kinds, trust, copies)


def copied(folder, times):
    for name, keys in (("lineitem", {"l_orderkey": 1500, "l_partkey": 200}), ("part", {"p_partkey": 200})):
        moved = ", ".join(f"{k} + i * {n} AS {k}" for k, n in keys.items())
        duckdb.execute(f"COPY (SELECT x.* REPLACE ({moved}) FROM '{DATA}/{name}.parquet' x, range({times}) r(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    os.symlink(f"{DATA}/embeddings.parquet", f"{folder}/embeddings.parquet")


def test_alpha_sweep_writes_few_bytes_per_row(spark, tmp_path):
    copied(tmp_path, 10)
    release(spark)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert len(QUERIES["alpha_sweep"](spark, str(tmp_path)).collect()) == 105
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))
    rows = duckdb.execute(f"SELECT count(*) FROM '{tmp_path}/lineitem.parquet'").fetchall()[0][0]
    assert written + shuffled() - before < 60 * rows


@pytest.mark.parametrize("same", [1, 4])
def test_alpha_sweep_without_edges(spark, tmp_path, same):
    """No pair often enough, or every basket of the same items: SQL gives no rows."""
    if same == 1:
        baskets = [[(7 * k + p * (k % 11 + 1)) % 97 for p in range(4)] for k in range(60)]
        baskets = [b for b in baskets if len(set(b)) == 4]
    else:
        baskets = [[0, 1, 2, 3]] * 60
    db = duckdb.connect()
    db.execute("CREATE TABLE lineitem AS SELECT unnest($1) AS l_orderkey, unnest($2) AS l_partkey", [[k for k, b in enumerate(baskets) for _ in b], [p for b in baskets for p in b]])
    db.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'n' || i AS p_name FROM range(97) t(i)")
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    for t in ("lineitem", "part", "embeddings"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert not db.execute(ORACLE["alpha_sweep"]).fetchall()
    check(spark, QUERIES["alpha_sweep"], ORACLE["alpha_sweep"], db, str(tmp_path))
