import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.api import BadRequest, Model, NotFound, Service, Unprocessable
from tagloom.operators import graph as g
from tagloom.operators import matrix as m
from tagloom.sources import models


@pytest.fixture(scope="module")
def service(spark):
    names = ["Python", "SQL", "Go", "Rust", "C++", "Docker"]
    vocabulary = spark.createDataFrame([(n, "tech" if i % 2 else "lang", i == 0, 100 - i) for i, n in enumerate([*names, "Cobol"])], "name string, category string, in_survey boolean, mentions long")
    edges = spark.createDataFrame([("Python", "SQL", 9, 0.5), ("Docker", "Go", 7, 0.9), ("Docker", "Python", 5, 0.2), ("Go", "Rust", 4, 1.2), ("C++", "Rust", 6, 0.7), ("C++", "Go", 3, 0.4)], "source string, target string, count long, pmi double")
    role_edges = spark.createDataFrame([("Python", "Data", 50, 0.5, 0.1), ("SQL", "Data", 80, 0.8, 0.6), ("Go", "Back", 30, 0.3, 0.9), ("Rust", "Back", 10, 0.1, 1.4)], "skill string, role string, count long, support double, lift double")
    levels = spark.createDataFrame([("SQL", "Data", "senior", 0.7), ("Python", "Data", "senior", 0.0)], "skill string, role string, level string, share double")
    totals = spark.createDataFrame([("Data", None, 100), ("Data", "senior", 40), ("Data", "lead", 5), ("Back", None, 60)], "role string, level string, n long")
    trends = spark.createDataFrame([("Python", 6, 0.5, 0.03), ("Go", 5, 0.1, -0.02), ("SQL", 3, 0.4, 0.5)], "tech string, n_years long, latest double, rank_slope double")
    mapping = spark.createDataFrame([("golang", "Go"), ("py", "Python"), ("?", None)], "raw string, canonical string")
    return Service(Model(vocabulary, edges, role_edges, levels, totals, mapping, trends))


def test_recommendations(spark, service):
    r = service.recommend(["golang", "nonsense", "Cobol"], top_k=2)
    assert (r["recognised"], r["unrecognised"]) == (["Go"], ["nonsense", "Cobol"]) and [x["rank"] for x in r["recommendations"]] == [1, 2]
    assert "Go" not in [x["skill"] for x in r["recommendations"]] and r["warning"] is None
    every = service.recommend(["Go"], top_k=10)["recommendations"]
    assert len(every) == 5 and [x["skill"] for x in every[:2]] == [x["skill"] for x in r["recommendations"]]
    assert {x["category"] for x in service.recommend(["Go"], 10, exclude_categories=["lang"])["recommendations"]} == {"tech"}
    role = service.recommend(["Go"], 10, target_role="Data")["recommendations"]
    assert {x["skill"]: x["role_support"] for x in role}["SQL"] == 0.8
    given = {x["skill"]: x["given"] for x in every}
    assert given["Docker"] == round(7 / 98, 4) and given["Python"] == 0.0


def test_errors(service):
    for call, kind, status in (
        (lambda: service.recommend([]), BadRequest, 400), (lambda: service.recommend(["nonsense"]), BadRequest, 400), (lambda: service.recommend(["Go"], target_role="No"), NotFound, 404),
        (lambda: service.recommend(["Go"], method="hybrid"), BadRequest, 400), (lambda: service.recommend(["Go"], method="odd"), BadRequest, 400), (lambda: service.skill("nonsense"), NotFound, 404),
        (lambda: service.skill("Cobol"), NotFound, 404), (lambda: service.gap("No"), NotFound, 404), (lambda: service.gap("Data", seniority="odd"), Unprocessable, 422),
        (lambda: service.gap("Data", seniority="lead"), Unprocessable, 422), (lambda: service.match(["nonsense"]), BadRequest, 400), (lambda: service.trend("Rust"), NotFound, 404), (lambda: service.trends_overview("odd"), Unprocessable, 422),
    ):
        with pytest.raises(kind) as e:
            call()
        assert e.value.status == status


def test_roles_and_trends(service):
    r = service.gap("Data", ["py"], top_k=1)
    assert (r["coverage"], [x["skill"] for x in r["you_have"]], [x["skill"] for x in r["gaps"]], r["postings_analysed"]) == (0.5, ["Python"], ["SQL"], 100)
    senior = service.gap("Data", [], "senior")
    assert [(x["skill"], x["support"]) for x in senior["gaps"]] == [("SQL", 0.7)] and senior["postings_analysed"] == 40
    assert [(x["role"], x["coverage"]) for x in service.match(["SQL", "Rust"])["roles"]] == [("Data", 0.6154), ("Back", 0.25)]
    assert {x["name"] if "name" in x else x["role"]: x["by_level"] for x in service.roles()}["Data"] == {"senior": 40, "lead": 5}
    assert service.trend("py")["tech"] == "Python" and [x["skill"] for x in service.trends_overview()] == ["Python", "Go"]
    assert [x["skill"] for x in service.trends_overview("falling", 1)] == ["Go"]


def test_names(service):
    assert [(x["canonical"], x["in_graph"]) for x in service.normalize(["PYTHON", "cobol", "?"])] == [("Python", True), ("Cobol", False), (None, False)]
    assert [x["name"] for x in service.skills("o", ["Go"], 2)] == ["Python", "Docker"]
    s = service.skill("golang", 2)
    assert (s["degree"], s["distinctive"][0]["skill"], s["frequent"][0]["skill"], s["trend"]) == (3, "Rust", "Docker", -0.02)
    h = service.health()
    assert h["ready"] and (h["skills"], h["nodes"], h["edges"], h["roles"]) == (7, 6, 6, 2) and h["errors"] == ["no vectors"]


def test_resume(service):
    r = service.resume("SKILLS\nPython, SQL, Dokcer, strange thing\n", 3, embed=models.ngram_vectors, threshold=0.3)
    found = {x["name"]: (x["section"], x["weight"]) for x in r["skills"]}
    assert found["Python"] == ("skills", 0.85) and found["Docker"] == ("inferred", 0.56) and "strange thing" in r["unmatched"] and "Dokcer" not in r["unmatched"]
    assert len(r["recommendations"]) == 3 and r["role_match"][0]["role"] == "Data"
    assert "recommendations" not in service.resume("SKILLS\nnothing at all\n")


def test_no_candidate_is_cut_before_the_mask(spark):
    """On 3,000 nodes the first after the mask stands far down before it; a dense ranking agrees."""
    rng = np.random.default_rng(5)
    n = 3000
    names = [f"n{i:04}" for i in range(n)]
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (9000, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(names[a], names[b], 3, 0.5) for a, b in pairs], "source string, target string, count long, pmi double")
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    deg = a.sum(0)
    s = a @ (a / np.maximum(deg, 1)[:, None])
    sd = lambda x, k: np.maximum(x.std(axis=k, ddof=1, keepdims=True), 1e-8)
    z = (s - s.mean(1, keepdims=True)) / sd(s, 1)
    z = (z - z.mean(0, keepdims=True)) / sd(z, 0)
    known = [names[0], names[1], names[1]]
    want = z[0] + 2 * z[1]
    nodes = spark.createDataFrame([(x,) for x in names], "s string")
    got = {r["j"]: r["score"] for r in m.known_scores(g.resource_allocation(edges), nodes, spark.createDataFrame([(x,) for x in known], "s string")).collect()}
    assert len(got) == n and np.allclose([got[x] for x in names], want, atol=1e-6)
    order = np.argsort(-want)
    lifted = int(order[1700])
    mask = np.full(n, 0.1)
    mask[lifted] = 1 + 40.0
    masked = want * mask
    masked[[0, 1]] = -np.inf
    role = spark.createDataFrame([(names[lifted], "r", 3, 0.1, 40.0)], "skill string, role string, count long, support double, lift double")
    vocabulary = nodes.select(F.col("s").alias("name"), F.lit("c").alias("category"), F.lit(True).alias("in_survey"), F.lit(1).cast("long").alias("mentions"))
    empty = spark.createDataFrame([], "skill string, role string, level string, share double")
    totals = spark.createDataFrame([("r", None, 9)], "role string, level string, n long")
    best = Service(Model(vocabulary, edges, role, empty, totals, nodes=nodes)).recommend(known, 5, target_role="r")["recommendations"]
    assert [x["skill"] for x in best] == [names[i] for i in np.argsort(-masked, kind="stable")[:5]]


def test_classification_resumes(spark, tmp_path):
    calls = []

    def client(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return "```json\n{\"items\": [" + ", ".join(f'{{"raw": "{x}", "canonical": "{x.title()}", "category": "Tech-Product"}}' for x in prompt.split("|") if x != "skipped") + "]}\n```"

    df = spark.createDataFrame([("a", 3), ("b", 2), ("skipped", 1), ("bad", 1)], "raw string, count long").coalesce(1)
    path = str(tmp_path / "classified")
    first = models.classify(df, client, "|".join, path, batch=3, tries=2, wait=0.0)
    assert sorted((r["raw"], r["canonical"], r["category"], r["count"]) for r in first.collect()) == [("a", "A", "tech-product", 3), ("b", "B", "tech-product", 2)]
    again = models.replies(df.join(spark.read.parquet(path), "raw", "left_anti"), client, "|".join, batch=1, tries=1, wait=0.0).collect()
    assert {tuple(r["strings"]): r["error"] for r in again} == {("skipped",): None, ("bad",): "OSError: down"} and calls == []


def test_embedding_of_names(spark):
    v = {r["name"]: r["v"] for r in models.embed_names(spark.createDataFrame([("Docker",), ("Dokcer",), ("Haskell",), (None,)], "name string"), "name").collect()}
    dot = lambda a, b: float(np.dot(v[a], v[b]))
    assert abs(dot("Docker", "Docker") - 1) < 1e-9 and dot("Docker", "Dokcer") > 0.3 > abs(dot("Docker", "Haskell")) and v[None] is None
