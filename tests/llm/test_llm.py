import itertools
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import check, connect  # noqa: E402
from tagloom.llm import canonical, cross_split, leakage, packing, subjects, term_frequency  # noqa: E402
from tagloom.llm.cooccurrence import cooccurrence  # noqa: E402
from tagloom.llm.queries import ORACLE, QUERIES  # noqa: E402
from tagloom.llm.set_blocks import ratio  # noqa: E402
from tagloom.llm import cooccurrence as together  # noqa: E402
from tagloom.llm import set_blocks  # noqa: E402
from tagloom.llm.set_join import class_links, expand, expand_between, similar_classes  # noqa: E402
from tagloom.operators.packed import split_packed  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    check(spark, QUERIES[name], ORACLE[name], db)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def random_sets(n, seed, groups="ab"):
    r = random.Random(seed)
    base = [r.sample(range(30), r.randint(2, 9)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5 and len(s) > 1:
                s.pop()
            else:
                s.append(r.randrange(30))
        rows.append((i, r.choice([*groups, None]), [f"t{x}" for x in s] + [None], r.choice([0, 1, None])))
    return [*rows, (n, "a", None, 0), (n + 1, "a", [], 1), (n + 2, "a", ["x"], 0), (n + 3, "a", ["x", "x", None], 1)]


def brute(rows, th, same_group, sides):
    num, den = ratio(th)
    out = set()
    sets = {r[0]: {x for x in r[2] or [] if x} for r in rows}
    for x, y in itertools.permutations(rows, 2):
        a, b = sets[x[0]], sets[y[0]]
        if min(len(a), len(b)) < 2 or (same_group and x[1] != y[1]):
            continue
        if sides and not (x[3] == 0 and y[3] == 1) or not sides and not x[0] < y[0]:
            continue
        if len(a & b) * den >= num * len(a | b):
            out.add((x[0], y[0]))
    return out


SCHEMA = "id long, company string, skills array<string>, side int"


BOUNDS = [{}, {"cell_rows": 3, "block_rows": 10}]


def all_pairs(parts):
    pairs, of = parts
    return [(r["a"], r["b"]) for r in expand(pairs, of).collect()]


def both_sides(parts):
    return [(r["a"], r["b"]) for r in expand_between(*parts).collect()]


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("th", [0.5, 0.6, 0.8, 1.0])
def test_similar_pairs(spark, th, bounds):
    rows = random_sets(160, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("toks", F.lit(1))
    got = all_pairs(similar_classes(df, "id", "skills", th, group=F.col("company"), **bounds))
    assert len(got) == len(set(got)) and set(got) == brute(rows, th, True, False)
    got = both_sides(similar_classes(df, "id", "skills", th, side=F.col("side"), **bounds))
    assert len(got) == len(set(got)) and set(got) == brute(rows, th, False, True)


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("th", [0.6, 0.8, 1.0])
def test_cross_split(spark, th, bounds):
    rows = random_sets(160, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = both_sides(cross_split.overlaps_between(df, "id", "skills", F.col("side"), th, **bounds))
    assert len(got) == len(set(got)) and set(got) == brute(rows, th, False, True)


@pytest.mark.parametrize("long,top", [(6, 20_000), (400, 4), (0, 4)])
def test_sets_that_travel_without_tokens_and_unknown_tokens(spark, monkeypatch, long, top):
    """Long sets, and tokens whose frequency the tasks don't know, give the same pairs."""
    monkeypatch.setattr(set_blocks, "LONG", long)
    monkeypatch.setattr(set_blocks, "TOP_TOKENS", top)
    rows = random_sets(120, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    for bounds in BOUNDS:
        got = all_pairs(similar_classes(df, "id", "skills", 0.6, group=F.col("company"), **bounds))
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, True, False)
        got = both_sides(cross_split.overlaps_between(df, "id", "skills", F.col("side"), 0.8, **bounds))
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.8, False, True)


def test_a_set_of_many_tokens_is_routed_small(spark):
    many = [f"t{i}" for i in range(30_000)]
    rows = [(1, "a", many, 0), (2, "a", many[:-10], 1), (3, "a", many[:20_000], 1), (4, "a", many[:9], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(all_pairs(similar_classes(df, "id", "skills", 0.6))) == [(1, 2), (1, 3), (2, 3)]
    assert both_sides(cross_split.overlaps_between(df, "id", "skills", F.col("side"), 0.8)) == [(1, 2)]


def test_large_classes_are_paired_in_parts(spark, monkeypatch):
    from tagloom.llm import set_join

    monkeypatch.setattr(set_join, "CLASS_ROWS", 3)
    df = spark.createDataFrame([(i, "a", ["x", "y"], 0) for i in range(10)] + [(10, "a", ["x", "y", "z"], 0)], SCHEMA)
    parts = similar_classes(df, "id", "skills", 0.6)
    got = all_pairs(parts)
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(11) for j in range(i + 1, 11)}
    assert {(r["id"], r["rep"], r["copies"], r["links"]) for r in class_links(*parts).collect()} == {(i, 0, 10, 10) for i in range(10)} | {(10, 10, 1, 10)}


def test_maximal_matches(spark):
    """Spans are the runs that stand together in both sequences, in the order of rareness."""
    filler = [(i, "a", [f"u{j}" for j in range(i % 10 + 1)], 0) for i in range(100, 200)]
    rows = [(1, "a", [f"u{j}" for j in range(10)], 1), (2, "a", [f"u{j}" for j in range(10) if j != 4], 0)]
    df = spark.createDataFrame(rows + filler, SCHEMA)
    pairs, _ = cross_split.overlaps_between(df.where("id < 100 or size(skills) < 7"), "id", "skills", F.col("side"), 0.8)
    got = pairs.where("a = 2").first()
    assert (got["overlap"], got["spans"], got["longest"]) == (9, 2, 5)


def test_sets_of_numbers_and_clashing_columns(spark):
    rows = [(1, [1, 2, 3], "x"), (2, [3, 2, 1, None], "y"), (3, [1, 2, 3, 4], None), (4, [9], "z"), (None, [1, 2, 3], "z")]
    df = spark.createDataFrame(rows, "id int, v array<int>, s string").withColumn("k1", F.lit(0)).withColumn("gk", F.lit("g")).withColumn("tokens", F.lit(1)).withColumn("size", F.lit(7))
    assert sorted(all_pairs(similar_classes(df, "id", "v", 0.6))) == [(1, 2), (1, 3), (2, 3)]
    assert {(r["source"], r["target"]): r["n_ab"] for r in cooccurrence(df, F.col("v")).collect()}["1", "2"] == 4
    assert {r["term"]: r["records"] for r in term_frequency.array_term_counts(df, F.col("v")).collect()}["9"] == 1


def test_joins_on_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert all_pairs(similar_classes(df, "id", "skills", 0.6)) == []
    assert both_sides(cross_split.overlaps_between(df, "id", "skills", F.col("side"), 0.8)) == []


def test_full_text_index_finds_every_run():
    r = np.random.default_rng(1)
    seqs = [r.integers(0, 4, r.integers(1, 12)) for _ in range(50)]
    ix = cross_split.FullTextIndex(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), sample=3)
    for _ in range(100):
        p = r.integers(0, 4, r.integers(1, 5))
        lo, hi = ix.search(p, np.array([len(p) - 1]), np.array([len(p)]))
        want = {(k, i) for k, s in enumerate(seqs) for i in range(len(s) - len(p) + 1) if s[i : i + len(p)].tolist() == p.tolist()}
        got = ix.locate(np.arange(lo[0], max(hi[0], lo[0])))
        assert set(zip(*map(list, got))) == want
    lo, hi = ix.search(np.array([-1, 2]), np.array([1]), np.array([2]))
    assert lo[0] >= hi[0]


def test_full_text_index_is_smaller_than_its_text():
    r = np.random.default_rng(2)
    sizes = r.integers(5, 15, 20_000)
    codes = r.integers(0, 4000, sizes.sum())
    ix = cross_split.FullTextIndex(codes, np.concatenate([[0], np.cumsum(sizes)]))
    assert ix.nbytes < 4 * (len(codes) + len(sizes))


def test_longest_run_bound():
    for th in (0.6, 0.8):
        num, den = ratio(th)
        for m in range(2, 9):
            for extra, missing in itertools.product(range(5), range(m)):
                keep = m - missing
                if keep * den >= num * (m + extra) and keep:
                    for gaps in itertools.combinations(range(m), missing):
                        s = "".join("." if i in gaps else "x" for i in range(m))
                        # every added element may also cut a run
                        runs = [len(x) for x in s.split(".") if x]
                        for _ in range(extra):
                            runs.sort()
                            k = runs.pop()
                            runs += [k // 2, k - k // 2]
                        assert max(runs) >= cross_split.shortest_run(m, num, den)


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b", None]), (2, ["a"]), (2, ["a"]), (3, None), (4, [])], "id int, v array<string>").withColumn("term", F.lit("x"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency.array_term_counts(df, F.col("v")).collect()}
    assert got == {"a": (4, 3), "b": (1, 1)}
    long = df.select("id", F.explode("v").alias("t"))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency.term_counts(long, "id", F.col("t")).collect()} == {"a": (4, 2), "b": (1, 1)}
    both = {r["term"]: (r["occurrences"], r["records"]) for r in term_frequency.array_term_counts(df, F.col("v"), clean=str.upper, with_total=True).collect()}
    assert both == {"A": (4, 3), "B": (1, 1), None: (0, 3)}
    marks = term_frequency.mark_by_frequency(term_frequency.array_term_counts(df, F.col("v")), spark.createDataFrame([(3,)], "total long"), 2, 0.5)
    assert {r["term"]: r["mark"] for r in marks.collect()} == {"a": "common", "b": "rare"}
    assert term_frequency.array_term_counts(df.limit(0), F.col("v")).count() == 0


def test_cooccurrence(spark):
    rows = [(list(s),) for s in ("abc", "ab", "ab", "bd", "a", "aab")] + [(None,), ([],), ([None, "a"],)]
    df = spark.createDataFrame(rows, "skills array<string>").repartition(3)
    got = {(r["source"], r["target"]): r for r in cooccurrence(df, F.col("skills")).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == {("a", "b"): 4, ("a", "c"): 1, ("b", "c"): 1, ("b", "d"): 1}
    ab = got["a", "b"]
    assert (ab["n"], ab["n_a"], ab["n_b"]) == (5, 4, 5) and abs(ab["pmi"] - np.log(4 * 5 / 20)) < 1e-12
    k = np.array([[1.0, 3.0], [0.0, 1.0]])  # a with c
    e = k.sum(1, keepdims=True) * k.sum(0) / k.sum()
    assert abs(got["a", "c"]["llr"] - 2 * np.sum(np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / e), 0))) < 1e-9
    assert cooccurrence(df.limit(0), F.col("skills")).count() == 0


@pytest.mark.parametrize("top,pairs", [(20_000, 2_000_000), (3, 2_000_000), (5, 40), (0, 7)])
def test_cooccurrence_in_parts(spark, monkeypatch, top, pairs):
    """Bounds on what tasks hold and know don't change the counts."""
    monkeypatch.setattr(together, "TOP_ITEMS", top)
    monkeypatch.setattr(together, "STRIPE_PAIRS", pairs)
    r = random.Random(3)
    sets = [r.sample([f"i{k}" for k in range(25)], r.randint(1, 12)) for _ in range(150)]
    want = {}
    for s in sets:
        for a, b in itertools.combinations(sorted(s), 2):
            want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame([(s,) for s in sets], "skills array<string>").repartition(5)
    rows = cooccurrence(df, F.col("skills")).collect()
    assert {(x["source"], x["target"]): x["n_ab"] for x in rows} == want and len(rows) == len(want)
    long = [s for s in sets if len(s) > 1]
    assert all(x["n_a"] == sum(x["source"] in s for s in long) and x["n_b"] == sum(x["target"] in s for s in long) and x["n"] == len(long) for x in rows)


def test_strong_pairs_are_significant():
    """Five joint records at four times the chance exceed the bound of p6_found, so it drops none."""
    for n_ab in range(5, 200):
        e = n_ab / 4
        assert 2 * (n_ab * np.log(4) - (n_ab - e)) > together.SIGNIFICANT


def test_canonical(spark):
    ref = spark.createDataFrame([("Rackt",), ("Stoplus",), ("Stoplus++",), ("Kranum 2",), ("Layered Sharding",), ("Samax.js",), ("Plopest/Paedeck",), ("Tag, Sort & Shelve",), (None,)], "canonical string")
    decided = spark.createDataFrame([("ls", "Layered Sharding"), ("team", None), ("oldie", "Zisand Classic"), (None, "Stoplus")], "raw string, canonical string")
    gone = spark.createDataFrame([("Zisand Classic",), ("Stopluz",), (None,)], "name string")
    want = {
        "advanced stoplus": "Stoplus", "STOPLUS++ (2+ yrs)": "Stoplus++", "Kranum-2 v18.8": "Kranum 2", "Kranum 3": "", "layered_sharding": "Layered Sharding",
        "LayeredSharding": "Layered Sharding", "Layered Shardign": "Layered Sharding", "samaxjs": "Samax.js", "Samax js.": "Samax.js", "plopest/paedekk": "Plopest/Paedeck",
        "Tag, Sort and Shelve": "Tag, Sort & Shelve", "ls": "Layered Sharding", "team": "", "oldie": "", "Zisand Clasic": "", "Stopluz": "",
        "Nothing Known": "", "": "", "   ": "", "skills": "", "x" * 5000: "", "Tag, Sort, Shelve": "Tag, Sort & Shelve", "Räckt": "Rackt", "rakct": "Rackt", "layered shelve": "",
    }
    # what teaches the phrases: several entries with each of them
    taught = [f"{b}{n}{a}" for n in ("Rackt", "Layered Sharding", "Samax.js", "Plopest/Paedeck") for b, a in (("advanced ", ""), ("", " (3+ yrs)"), ("", " v1.2"))]
    want |= {x: next(n for n in ("Rackt", "Layered Sharding", "Samax.js", "Plopest/Paedeck") if n in x) for x in taught}
    df = spark.createDataFrame([(x,) for x in [*want, *want, None]], "raw string").withColumn("key", F.lit(1))
    for at_once in (100_000, 3, 1):
        got = {r["raw"]: r["canonical"] for r in canonical.to_canonical(df, "raw", ref, decided, gone, at_once=at_once).collect()}
        assert got == want
    assert {r["canonical"] for r in canonical.to_canonical(df, "raw", ref.limit(0)).collect()} == {""}
    assert canonical.to_canonical(df.limit(0), "raw", ref).count() == 0


def test_shards_don_t_change_ties(spark):
    ref = spark.createDataFrame([("Alpha Betanode",), ("Alphas Betanode",), ("Alphaz Gammanode",), ("Betanode",)], "name string")
    df = spark.createDataFrame([("Alphaz Betanode",), ("Alphaq Betanode",), ("Betanode Alpha",), ("betamode",)], "raw string")
    got = [sorted(tuple(r) for r in canonical.to_canonical(df, "raw", ref, at_once=k).collect()) for k in (100, 2, 1)]
    assert got[0] == got[1] == got[2] and ("Alphaq Betanode", "Alpha Betanode") in got[0] and ("betamode", "Betanode") in got[0]


def test_phrases_come_from_the_values(spark):
    names = ["Kubernetes", "Python", "Java", "Rust", "Terraform", "MySQL"]
    ref = spark.createDataFrame([(n,) for n in [*names, "MySQL Workbench", "Java Card"]], "name string")
    said = [x.format(n) for n in names for x in ("{} guru", "expert in {}", "knows {} well", "{} well", "knows {}")] + ["Blorb Suite", "Frob Suite", "Java Card guru"]
    df = spark.createDataFrame([(x,) for x in [*said, "Pyton", "Javva", "Rustt", "expert in Pyhton", "Workbench MySQL", "Java Suite", "Card"]], "raw string")
    got = {r["raw"]: r["canonical"] for r in canonical.to_canonical(df, "raw", ref).collect()}
    assert all(got[x] == next(n for n in names if n in x) for x in said if "Suite" not in x and "Card" not in x)
    assert got["Java Card guru"] == "Java Card" and got["Blorb Suite"] == "" == got["Java Suite"] == got["Card"]
    assert (got["Pyton"], got["Javva"], got["Rustt"], got["expert in Pyhton"], got["Workbench MySQL"]) == ("Python", "Java", "Rust", "Python", "MySQL Workbench")


def test_token_repair_misses_nothing():
    r = random.Random(8)
    words = {"".join(r.choices("abc1", k=r.choice([3, 5, 7, 11, 37, 39, 41, 60]))) for _ in range(150)}
    find = canonical.TokenRepair(words)
    for w in list(words)[:80]:
        t = list(w)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(t))
            r.choice([lambda: t.insert(i, "a"), lambda: t.pop(i) if len(t) > 1 else None, lambda: t.__setitem__(i, "b"), lambda: t.__setitem__(slice(i, i + 2), t[i : i + 2][::-1])])()
        t = "".join(t)
        digits = lambda x: x.count("1")
        want = {(x, d) for x in words if (d := canonical.edit_distance(t, x)) <= canonical.allowed_edits(max(len(x), len(t))) and digits(x) == digits(t)}
        assert set(find(t)) == want


def test_earlier_decisions_are_found_without_them(spark):
    m = spark.read.parquet(f"{DATA}/final_mapping.parquet").where("canonical is not null")
    v = spark.read.parquet(f"{DATA}/final_vocab.parquet").select("canonical")
    m = m.join(v, "canonical", "left_semi").where("length(raw) > 6")
    got = canonical.to_canonical(m, "raw", v).join(m.withColumnRenamed("canonical", "want"), "raw").toPandas()
    assert (got.canonical == got.want).mean() > 0.99


def test_packing(spark):
    def counter():
        return lambda texts: [len(t.split()) for t in texts]

    r = random.Random(4)
    texts = [" ".join("w" * r.randint(1, 30)) for _ in range(500)] + ["w " * 2050, "w " * 20, "", None, " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("container", F.lit("x")).coalesce(1)
    p = packing.pack(df, "doc_id", "text", lambda: counter(), capacity=100, open_bins=8).toPandas()
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == {i: len((t or "").split()) for i, t in enumerate(texts)}
    used = p[p.container.notna()].groupby("container").n_tokens.sum()
    assert used.max() <= 100 and used.sum() / (100 * len(used)) > 0.95
    whole = p[(p.n_tokens > 0) & (p.doc_id != 500)]
    assert whole.groupby("doc_id").size().max() == 1
    long = p[p.doc_id == 500].sort_values("part")
    assert long.first_token.tolist() == list(range(0, 2050, 100)) and len(long) == 21
    assert p.container.isna().sum() == 3
    assert packing.pack(df.limit(0), "doc_id", "text", lambda: counter()).count() == 0


def test_best_fit_closes_the_fullest():
    b = packing.OpenBins(10, 2)
    assert [b.place(x) for x in (6, 7, 3, 4)] == [0, 1, 1, 0]
    b = packing.OpenBins(10, 2)
    assert [b.place(x) for x in (6, 7, 8, 4, 2)] == [0, 1, 2, 0, 2]  # the bin of 7 was closed


def test_public_tokenizer(spark):
    n = packing.public_counter()()(["hello world", "", "a\r\nb", "<|endoftext|>"])
    assert n[0] == 2 and n[1] == 0 and n[3] > 1


def test_leakage(spark):
    w = [f"w{i}" for i in range(40)]
    item = " ".join(w[:30])
    docs = {
        1: "intro " + " ".join(w[5:17]) + " end", 2: " ".join(w[5:16]) + " x " + w[16], 3: "# " + ",\n// ".join(x.upper() for x in w[:14]),
        4: None, 5: "", 6: " ".join(w[10:40]), 7: ("noise " * 200_000) + " ".join(w[3:20]), 8: " ".join(reversed(w[5:17])),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([(10, item), (11, item), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["windows"] for r in leakage.leaked(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(a, b): n for a, n in ((1, 1), (3, 3), (6, 9), (7, 6)) for b in (10, 11)}
    near = leakage.leaked(d, "doc_id", "text", i, "item_id", "text", radius=8, similarity=0.5, exact=False).select("doc_id").distinct().collect()
    assert {1, 3, 6, 7} <= {r[0] for r in near}
    assert leakage.leaked(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaked(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_hamming_blocks_miss_nothing():
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 200, dtype=np.uint64)
    b = a[:100].copy()
    for k in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64)
    p, q = leakage.HammingIndex(a, 3).within(b)
    want = {(i, j) for i in range(100) for j in range(200) if bin(int(b[i] ^ a[j])).count("1") <= 3}
    assert set(zip(p.tolist(), q.tolist())) == want


@pytest.mark.parametrize("radius,flips", [(2, None), (4, 2), (8, 3)])
def test_hamming_blocks_of_any_number(radius, flips):
    r = np.random.default_rng(6)
    a = r.integers(0, 2**63, 60, dtype=np.uint64)
    b = a.copy()
    for k in range(radius + 1):
        b ^= np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)
    p, q = leakage.HammingIndex(a, radius, flips).within(b)
    assert set(zip(p.tolist(), q.tolist())) == {(i, j) for i in range(60) for j in range(60) if bin(int(b[i] ^ a[j])).count("1") <= radius}


def test_leakage_joined_by_block(spark):
    """Any number of items in one pass over the documents: the same rows as with all items in the tasks."""
    d, i = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    args = (d, "doc_id", "text", i, "item_id", "text")
    for how in ({}, {"similarity": 0.7, "exact": False, "shingle": 5, "radius": 2}):
        a = sorted((r["doc_id"], r["item_id"], r["windows"], round(r["similarity"], 9)) for r in leakage.leaked(*args, **how).collect())
        b = sorted((r["doc_id"], r["item_id"], r["windows"], round(r["similarity"], 9)) for r in leakage.leaked(*args, **how, item_chars=0).collect())
        assert a == b and a
    assert leakage.leaked(*args, item_chars=0).select("doc_id", "item_id").exceptAll(QUERIES["p9_found"](spark, DATA)).count() == 0
    assert leakage.leaked(d.limit(0), *args[1:], item_chars=0).count() == 0


def test_near_copies_of_items(spark):
    """Against brute force over all windows: recall of item-sized windows with a word changed, moved or dropped."""
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [r.choices(vocabulary, k=r.randint(30, 100)) for _ in range(40)]
    docs = []
    for k in range(200):
        t = list(r.choice(items))
        for _ in range(r.choice([0, 1, 1, 2, 6])):
            j = r.randrange(len(t))
            r.choice([lambda: t.__setitem__(j, "new"), lambda: t.pop(j), lambda: t.insert(j, "more")])()
        docs.append(r.choices(vocabulary, k=r.randint(0, 80)) + t + r.choices(vocabulary, k=r.randint(0, 80)))
    how = leakage.Windows(None, 8, 3, 0.8, False, 5)
    size = lambda x: int(how.sizes(np.array([len(x)]))[0])
    runs = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
    held = {}
    for x in items:
        for j in range(len(x) - 4):
            held[tuple(x[j : j + 5])] = held.get(tuple(x[j : j + 5]), 0) + 1
    total = sum(held.values())
    weight = lambda s: sum(math.log1p(total / held[x]) if x in held else math.log1p(total) for x in s)
    want = set()
    for di, t in enumerate(docs):
        for ii, x in enumerate(items):
            w = size(x)
            for part in {0, len(x) - w}:
                b = runs(x[part : part + w])
                if any(weight(a & b) >= 0.8 * weight(a | b) for a in (runs(t[j : j + w]) for j in range(len(t) - w + 1)) if len(a & b) > 10):
                    want.add((di, ii))
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaked(d, "doc_id", "text", i, "item_id", "text", window=None, radius=8, similarity=0.8, exact=False, shingle=5).collect()}
    assert got <= want and len(want) > 100 and len(got & want) >= 0.95 * len(want)


def test_own_text_and_words():
    t = "commit abcdef1\nAuthor: A B\n\n    Fix cello\ndiff --git a/x/violin.py b/x/violin.py\n--- a/x\n+++ b/x\n@@ -1 +1 @@ SpiceRack\n-oldLine\n+newTrumpet\n context drums\n"
    own = subjects.own_text(t)
    assert "cello" in own and own.count("violin") == 1 and "newTrumpet" in own and "drums" not in own and "Author" not in own
    row, ids, n = subjects.bucket_counts(["SpiceRack spiceRack", None, ""])
    assert row.tolist() == [0, 0] and n.tolist() == [2, 2]


def test_subjects_held_out(spark):
    r = random.Random(7)
    words = {s: [f"{s}{chr(97 + i)}term" for i in range(20)] for s in ("law", "food", "sport")}
    plain = [f"plain{chr(97 + i)}" for i in range(20)]
    docs, labels, truth = [], [], {}
    for i in range(600):
        own = r.sample(list(words), r.choice([0, 1, 1, 1, 2]))
        t = r.choices(plain, k=30)
        for s in own:
            t += r.choices(words[s], k=12)
        r.shuffle(t)
        docs.append((i, " ".join(t)))
        truth[i] = set(own)
        if i < 200:
            for s in own or ["none"]:
                labels.append((i, " Law " if s == "law" else s, "a"))
    labels += [labels[0], (None, "law", "a"), (3, None, "a"), (4, "unknown", "a"), (10**9, "law", "b")]
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    got = {}
    for x in subjects.assign_subjects(d, "doc_id", "text", l, "doc_id", "subject", "rater", ["food", "law", "sport"]).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    assert np.mean([got.get(i, set()) == truth[i] for i in range(200, 600)]) > 0.95
    assert not {1000, 1001} & set(got)
    assert subjects.assign_subjects(d, "doc_id", "text", l.limit(0), "doc_id", "subject", "rater", ["food", "law"]).count() == 0
    assert subjects.assign_subjects(d.limit(0), "doc_id", "text", l, "doc_id", "subject", "rater", ["food", "law"]).count() == 0


def test_a_document_may_have_three_subjects(spark):
    r = random.Random(9)
    words = {s: [f"{s}{chr(97 + i)}term" for i in range(20)] for s in ("law", "food", "sport", "music", "health", "travel")}
    plain = [f"plain{chr(97 + i)}" for i in range(20)]
    docs, labels = [], []
    for i in range(600):
        own = r.sample(list(words), r.choice([0, 1, 1, 2, 3]))
        docs.append((i, " ".join([w for s in own for w in r.choices(words[s], k=12)] + r.choices(plain, k=30))))
        labels += [(i, s, "a") for s in own or ["none"]] if i < 400 else []
    docs.append((1000, " ".join([w for s in ("law", "food", "sport") for w in words[s]] + plain)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    got = subjects.assign_subjects(d, "doc_id", "text", l, "doc_id", "subject", "rater", sorted(words)).where("doc_id = 1000")
    assert {x["subject"] for x in got.collect()} == {"law", "food", "sport"}
    two = subjects.assign_subjects(d, "doc_id", "text", l, "doc_id", "subject", "rater", sorted(words), each=2).where("doc_id = 1000")
    assert two.count() == 2


def test_complement_ratios():
    counts = np.array([[8.0, 0.0, 2.0], [0.0, 9.0, 1.0], [4.0, 4.0, 12.0]])
    got = subjects.complement_ratios(counts)
    s = 0.1
    want = (8 + s) / (12 + 3 * s) / ((2 + s) / (28 + 3 * s)) * math.exp(-0.5)
    assert abs(got[0, 0] - want) < 1e-12 and got[0, 1] == got[1, 0] == math.exp(-3) and got.shape == (3, 2)
    assert np.allclose(subjects.complement_ratios(counts[:1], counts.sum(0), 3), got[:1])


def test_p2_feeds_p7(spark):
    raw = split_packed(spark.read.parquet(f"{DATA}/postings.parquet"), ["posting_id"], "job_skills", "skill").select("skill").distinct().count()
    assert QUERIES["p7_found"](spark, DATA).count() == raw
