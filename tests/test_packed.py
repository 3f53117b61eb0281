import pytest

import pyarrow as pa
from pyspark.sql import functions as F

from tagloom.operators.packed import CANDIDATES, Splitter, _piece_counts, _Rows, accepted_delimiters, delimiter_scores, infer_delimiters, split_arrays, split_list, split_packed

SEPARATING = ["comma", "semicolon", "pipe", "tab", "line", "bullet", "slash"]

CASES = [
    ("a, b,c", ["a", "b", "c"]),
    ("a;b; c", ["a", "b", "c"]),
    ("a | b|c", ["a", "b", "c"]),
    ("a\tb\tc", ["a", "b", "c"]),
    ("• a\n• b\n", ["a", "b"]),
    ("* a\n- b c\n* d", ["a", "b c", "d"]),
    ("- only", ["only"]),
    ("1. a; 2. b; 3. c", ["a", "b", "c"]),
    ("1) a, 2) \"b, c\"", ["a", "b, c"]),
    ("1. a\n2. b", ["a", "b"]),
    ("a / b/c / d", ["a", "b/c", "d"]),
    ('"a, b", c', ["a, b", "c"]),
    ('"""Hands"" on", x', ['"Hands" on', "x"]),
    ("“a; b” • c", ["a; b", "c"]),
    ('["a", "b \\"c\\" d"]', ["a", 'b "c" d']),
    ("['a', 'b, c']", ["a", "b, c"]),
    ("[\"it's\", 'b']", ["it's", "b"]),
    ("[]", []),
    (", ,", []),
    (" \xa0a  , b  c ", ["a", "b  c"]),
    ("a\nb, c • d;e | f", ["a", "b", "c", "d", "e", "f"]),
    ("x, 2. y", ["x", "2. y"]),
    ('5" disk, b', ['5" disk', "b"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_split(text, want):
    s = Splitter(SEPARATING)
    t = text.strip()
    assert (split_list(text, s) if t[:1] == "[" and t[-1:] == "]" else s(text)) == want


def test_very_long_field_is_linear():
    s = Splitter(SEPARATING)
    assert len(s(", ".join(f'"v{i}, x"' for i in range(50_000)))) == 50_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (2, None, "x"), (3, " ", None), (4, "", None), (5, "c; c", "y"), (5, "c; c", "y")], "id long, f string, pos string")
    got = sorted(tuple(r) for r in split_packed(df, ["id"], "f").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (5, 1, "c"), (5, 1, "c"), (5, 2, "c"), (5, 2, "c")]
    assert split_packed(df.limit(0), ["id"], "f").count() == 0
    assert split_arrays(df.where("id = 2"), ["id"], "f").first()["values"] == []


def test_inference_leaves_out_marks_in_prose(spark):
    prose = "this is one long remark, " + "with many words that no list of short items would have in any piece " * 3
    df = spark.createDataFrame([(f"a{i}; b; c",) for i in range(20)] + [(prose + "; x",) for _ in range(60)], "f string")
    got = infer_delimiters(df, "f")["plain"]
    assert "semicolon" in got and "comma" not in got
    assert {r["delimiter"] for r in delimiter_scores(df, "f").collect()} == {"semicolon", "comma"}


def test_each_source_has_its_own_delimiters(spark):
    """Source a packs with semicolons and has commas inside values, source b packs with commas, c has no mark at all."""
    a = [("a", i, f"Tag, Sort & Shelve; item {i}; Probe and Patch; kit{i % 7}; R. U. Ready") for i in range(30)]
    b = [("b", 100 + i, f"item {i}, kit{i % 5}, tool") for i in range(30)]
    rows = [*a, *b, ("c", 200, "one, two"), (None, 201, "x | y"), ("a", 202, "Tag, Sort")]
    df = spark.createDataFrame(rows, "src string, id long, f string").withColumn("source", F.lit("clash"))
    accepted = {r["source"]: r["delimiters"] for r in accepted_delimiters(df, "f", source=F.col("src")).collect()}
    assert accepted["a"] == ["semicolon"] and accepted["b"] == ["comma"]
    got = {}
    for r in split_packed(df, ["id"], "f", source=F.col("src")).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["value"])
    assert got[0] == ["Tag, Sort & Shelve", "item 0", "Probe and Patch", "kit0", "R. U. Ready"]
    assert got[100] == ["item 0", "kit0", "tool"] and got[202] == ["Tag, Sort"] and got[201] == ["x", "y"]
    everything = Splitter(list(CANDIDATES))
    assert everything(a[0][2]) != got[0]  # all candidates at once give a wrong answer


def test_many_sources_need_no_driver(spark):
    df = spark.range(12_000).select(F.concat(F.lit("s"), "id").alias("src"), F.col("id"), F.lit("a, b").alias("f"))
    assert split_packed(df, ["id"], "f", source=F.col("src")).count() == 24_000


def test_inference_rejects_on_the_given_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/postings.parquet")
    assert infer_delimiters(df, "job_skills")["plain"] == SEPARATING
    wrong = split_packed(df, ["posting_id"], "job_skills", accepted={s: list(CANDIDATES) for s in ("list", "numbered", "bulleted", "plain")})
    assert wrong.exceptAll(split_packed(df, ["posting_id"], "job_skills")).count() > 0


def test_marks_by_bytes_equal_the_patterns():
    import re

    texts = ["a & b, c", "x – y - z", "a  b \xa0 c", "and or a and b or", "R. U. 3. x", "k: v:w", "a / b/c", "• é · ü", "", "p + q +r"]
    counted = {(name, int(row)): int(n) for name, rows, _, pieces, _ in _piece_counts(texts) for row, n in zip(rows, pieces)}
    for name, pattern in CANDIDATES.items():
        for i, t in enumerate(texts):
            parts = re.split(pattern, t)
            if len(parts) > 1 and (name, i) in counted:
                assert counted[name, i] == sum(bool(x.strip(" \xa0")) for x in parts), (name, t)
            elif (name, i) in counted:
                raise AssertionError((name, t))


def test_rows_split_together_equal_rows_split_alone():
    accepted = {s: SEPARATING for s in ("list", "numbered", "bulleted", "plain")}
    texts = [c for c, _ in CASES] + [None, "", " x\u2003;\u00a0y ", "a,,b"] * 2
    rows = _Rows(accepted)
    got = rows.by_style(pa.array(texts, pa.string())).to_pylist()
    assert got == [rows.one(t) if t else [] for t in texts]
