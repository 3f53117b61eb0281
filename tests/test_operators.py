import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import names as n
from tagloom.functions import titles as t
from tagloom.operators import cluster, evaluation, graph, matrix, profile, resume, trends
from tagloom.operators.dedup import greedy_dedup
from tagloom.sources import files, survey
from tagloom.streaming.counts import keep_counts, read_counts


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_names(spark):
    assert values(spark, n.normalize, ["  Python  ", "PYTHON", ".NET (5+)", "C++", "Node.js.", "R & D", None, ""]) == ["python", "python", ".net", "c++", "node.js", "randd", None, ""]
    assert values(spark, n.canon_key, ["Amazon Web Services (AWS)", "AWS", "React.js", "ReactJS"]) == ["aws", "aws", "react.js", "react"]
    assert values(spark, n.slash_parts, ["HTML/CSS", ".NET/C#", "Go"]) == [["HTML", "CSS"], [], []]
    assert values(spark, lambda c: n.aliases(c, n.vocabulary_key(c)), ["Google Meet", "Apache Kafka", "HTML/CSS", "Amazon Web Services (AWS)", "Visual Studio Code"]) == [
        [], ["Kafka"], ["CSS", "HTML"], ["AWS", "Amazon AWS", "Amazon Web Services", "Web Services (AWS)"], ["VS Code", "VSCode"],
    ]


def test_titles(spark):
    xs = ["Machine Learning Engineer", "Senior Staff Engineer", "Sales Engineer", "HVAC Engineer", None]
    assert values(spark, t.role_of, xs) == ["AI/ML Engineer", "Software Engineer", None, None, None]
    assert values(spark, t.level_of, xs) == ["mid", "staff", "mid", "mid", "mid"]
    assert values(spark, t.is_tech_title, ["Software Engineer", "Mechanical Design Engineer", None]) == [True, False, False]


def test_greedy_dedup_follows_arrival(spark):
    rows = [(1, "c", ["a", "b"]), (2, "c", ["a", "b", "c"]), (3, "c", ["x", "y"]), (4, None, ["a", "b"]), (5, None, ["b", "a"]), (6, "c", None), (7, "c", [])]
    df = spark.createDataFrame(rows, "k long, company string, s array<string>")
    assert sorted(r["k"] for r in greedy_dedup(df, "k", "company", "s").collect()) == [1, 3, 4, 6]
    chain = spark.createDataFrame([(1, "c", list("abc")), (2, "c", list("ab")), (3, "c", list("bcd")), (4, "c", list("bd"))], "k long, company string, s array<string>")

    def brute(rows, th=0.6):
        kept = []
        for k, s in rows:
            if all(len(s & o) / len(s | o) < th for _, o in kept):
                kept.append((k, s))
        return [k for k, _ in kept]

    assert sorted(r["k"] for r in greedy_dedup(chain, "k", "company", "s").collect()) == brute([(r["k"], set(r["s"])) for r in chain.orderBy("k").collect()])


def test_implicit_zero_scores_equal_dense(spark):
    rng = np.random.default_rng(1)
    m = np.where(rng.random((7, 7)) < 0.5, rng.random((7, 7)), 0.0)
    m[2] = 0
    df = spark.createDataFrame([(str(i), str(j), float(m[i, j])) for i in range(7) for j in range(7) if m[i, j]], "i string, j string, v double")
    nodes = spark.createDataFrame([(str(i),) for i in range(7)], "s string")
    sd = lambda x, a: np.maximum(x.std(axis=a, ddof=1, keepdims=True), 1e-8)
    z = (m - m.mean(1, keepdims=True)) / sd(m, 1)
    z = (z - z.mean(0, keepdims=True)) / sd(z, 0)
    got = np.zeros((7, 7))
    for i, j, v in matrix.row_col_standardise(df, nodes).collect():
        got[int(i), int(j)] = v
    assert np.allclose(got, z, atol=1e-9)


def test_recommend_is_invariant(spark):
    s = spark.createDataFrame([(a, b, float(ord(a) * ord(b) % 7)) for a in "abcd" for b in "abcdefg"], "i string, j string, v double")
    ask = lambda xs, k=5, **o: [(r["j"], r["score"]) for r in matrix.recommend(s, spark.createDataFrame([(x,) for x in xs], "s string"), k, **o).orderBy("rank").collect()]
    assert ask("ab") == ask("ba")
    assert ask("ab", 3) == ask("ab", 5)[:3]
    assert not {"a", "b"} & {j for j, _ in ask("ab")}
    assert ask("aab", dedupe=True) == ask("ab")
    scores = [v for _, v in ask("ab")]
    assert scores == sorted(scores, reverse=True)


def test_blocked_cosine_and_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)], "id int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.4}
    assert {(r["i"], r["j"]) for r in matrix.cosine_pairs(df, 0.4, block=7).collect()} == want
    base = spark.createDataFrame([(f"n{i:02}", v[i].tolist()) for i in range(10)], "name string, v array<double>")
    best = {r["id"]: r["name"] for r in matrix.nearest(df.where("id >= 10"), base, -1.0, block=4).collect()}
    assert best == {i: f"n{int((u[:10] @ u[i]).argmax()):02}" for i in range(10, 40)}


def test_clusters_are_average_linkage(spark):
    assert cluster.average_linkage(np.array([[1.0, 0], [1, 0], [0, 1]]), 0.1).tolist() == [0, 0, 2]
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id int")
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "i int, j int")
    assert [r["component"] for r in cluster.components(nodes, chain).orderBy("id").collect()] == [0] * 6 + [6, 7]
    m = spark.createDataFrame([(1, "MySQL", True, 5), (1, "PostgreSQL", True, 9), (1, "My SQL", False, 7), (1, "Mysql DB", False, 7)], "cluster int, name string, in_survey boolean, mentions long")
    h = {r["name"]: r["head"] for r in cluster.heads(m, cluster.blocked_pairs(cluster.never_merge(spark))).collect()}
    assert h == {"MySQL": "MySQL", "PostgreSQL": "PostgreSQL", "My SQL": "My SQL", "Mysql DB": "My SQL"}


def test_profile_levels_and_rare(spark):
    rows = spark.createDataFrame([(i, "s", "r", "a" if i < 20 else "b") for i in range(39)], "k int, s string, role string, level string")
    e = profile.role_edges(rows, 0.1)
    assert [r["level"] for r in profile.level_shares(rows, e, 20).collect()] == ["a"]
    g = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "i int, role string")
    assert [r["role"] for r in profile.null_rare(g, "role", 2).orderBy("i").collect()] == ["x", "x", None, None]


def test_trend_fits(spark):
    df = spark.createDataFrame([("a", 2019, 0.1), ("a", 2020, 0.3), ("a", 2021, 0.35), ("one", 2020, 0.2), ("flat", 2019, 0.2), ("flat", 2020, 0.2)], "tech string, year int, share double")
    r = {x["tech"]: x for x in trends.fit(df).collect()}
    assert (r["a"]["slope"], r["a"]["r2"]) == (0.125, 0.893)
    assert (r["one"]["slope"], r["one"]["r2"], r["flat"]["slope"], r["flat"]["r2"]) == (None, None, 0.0, None)
    tie = spark.createDataFrame([("a", 2019, 0.5), ("b", 2019, 0.5)], "tech string, year int, share double")
    assert {x["tech"]: x["rank"] for x in trends.ranks(tie).collect()} == {"b": 1.0, "a": 0.0}
    assert values(spark, lambda c: trends.direction(c.cast("double")), ["0.01", "0.011", "-0.011", None]) == ["flat", "rising", "falling", None]


def test_resume(spark):
    text = "Jane Roe\nPROJECTS\n- Built a tool with Python\nEngineering of things\nTechnical Skills\nPython*, Engineering, HTML\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    seg = resume.segment(resume.lines(docs, "id", "t"))
    assert [r["section"] for r in seg.orderBy("line_no").collect()] == ["other", "projects", "projects", "skills"]
    names = spark.createDataFrame([("Python",), ("Engineering",), ("HTML/CSS",)], "name string")
    best = {r["name"]: (r["section"], r["weight"]) for r in resume.best_evidence(resume.evidence(seg, resume.resolve_index(names))).collect()}
    assert best == {"Python": ("projects", 1.0), "Engineering": ("skills", 0.638), "HTML/CSS": ("skills", 0.638)}


def test_survey_layouts(spark, tmp_path):
    old = {"SubSections": [{"Title": "Most Popular", "GraphCollections": [{"Graphs": [{"Title": "All Respondents", "Data": {"AWS": 40, "Odd": "n/a"}}]}]}]}
    new = {"Platform": {"datasets": {"Platform": {"total_respondents": 9, "data": [{"response": " Amazon Web Services (AWS) ", "percent": 0.5}, {"response": "", "percent": 0.1}]}}}}
    (tmp_path / "2019.json").write_text(json.dumps(old))
    (tmp_path / "2021.json").write_text(json.dumps(new))
    docs = survey.read_years(spark, {y: str(tmp_path / f"{y}.json") for y in ("2019", "2020", "2021")})
    a = survey.legacy_rows(docs.where("year = '2019'"), F.col("doc")).select("year", "response", "percent")
    b = survey.technology_rows(survey.modern_rows(docs.where("year = '2021'"), F.col("doc"))).select("year", "response", "percent")
    got = a.unionByName(b).select("year", n.canon_key(F.col("response")).alias("key"), "percent")
    assert sorted(tuple(r) for r in got.collect()) == [("2019", "aws", 0.4), ("2021", "aws", 0.5)]
    assert survey.read_years(spark, {}).count() == 0


def test_files(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {ns}><w:body><w:p><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    src = tmp_path / "docs"
    src.mkdir()
    with zipfile.ZipFile(src / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (src / "b.txt").write_bytes(b"x\xff y")
    (src / "c.docx").write_bytes(b"no archive")
    got = {r["path"][-6:]: (r["text"], r["error"] is None) for r in files.read_documents(spark, str(src)).collect()}
    assert got["a.docx"] == ("Top\nCell", True) and got["c.docx"] == (None, False)
    assert got["/b.txt"] == ("x� y", True)
    art = str(tmp_path / "art")
    assert files.read_or_empty(spark, art, "k int, v string").count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert files.append_new(rows, art, "k").count() == 2
    files.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), art, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(art).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(k, s) for k in range(6) for s in "abc"[: 2 + k % 2]]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 3 == i], "k int, s string").write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("k int, s string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 20).parquet(str(tmp_path / "in"))
    keep_counts(stream, str(tmp_path / "out"), graph.pair_counts, str(tmp_path / "cp")).awaitTermination()
    got = read_counts(spark, str(tmp_path / "out"), ["source", "target"])
    want = graph.pair_counts(spark.createDataFrame(rows, "k int, s string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_auc_and_precision(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 6, 60).astype(float), rng.random(60) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    p, q = s[y], s[~y]
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert abs(evaluation.auc(df, "s", "y").first()["auc"] - want) < 1e-6
    ap = sum((y[s == x].sum() / y.sum()) * y[s >= x].mean() for x in np.unique(s))
    assert abs(evaluation.average_precision(df, "s", "y").first()[0] - ap) < 1e-6
    assert evaluation.auc(df.limit(0), "s", "y").first()["auc"] is None
