"""The service's requests as functions: parameters in, plain values out, typed errors.

A :class:`Service` is made once from tables of the model; they are written to the shared
folder, so a request reads only what it asks for.  Requests collect their answers, which
are reports of a stated number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.names import normalize
from tagloom.operators import graph as g
from tagloom.operators import matrix as m
from tagloom.operators import profile as p
from tagloom.operators import resume as r
from tagloom.plans.lineage import cut


class RequestError(Exception):
    """A request that can't be answered; ``status`` as in HTTP."""

    status = 400

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = {"error": message, **details}


class BadRequest(RequestError):
    status = 400


class NotFound(RequestError):
    status = 404


class Unprocessable(RequestError):
    status = 422


#: Postings that a level of a role must have to be asked about.
LEAST_POSTINGS = 20


@dataclass
class Model:
    """Tables of the model.

    ``vocabulary``: ``name, category, in_survey, mentions`` (category a string or null).
    ``mapping``: ``raw, canonical`` or None.  ``edges``: ``source, target, count, pmi``.
    ``role_edges``: ``skill, role, count, support, lift``.  ``levels``: ``skill, role,
    level, share``.  ``totals``: ``role, level, n``, level null for the whole role.
    ``trends``: ``tech, n_years, latest, rank_slope`` and more, or None.  ``series``:
    ``tech, year, share`` or None.  ``vectors``: ``s, v`` or None, for the hybrid method.
    ``nodes``: ``s``, all nodes of the graph; those of the edges unless given.
    """

    vocabulary: DataFrame
    edges: DataFrame
    role_edges: DataFrame
    levels: DataFrame
    totals: DataFrame
    mapping: DataFrame | None = None
    trends: DataFrame | None = None
    series: DataFrame | None = None
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    errors: list[str] = field(default_factory=list)


def _rows(df: DataFrame) -> list[dict]:
    return [x.asDict(recursive=True) for x in df.collect()]


class Service:
    """Answers requests over a model; ``alpha`` is the weight of the structural part in the hybrid."""

    def __init__(self, model: Model, alpha: float = 0.9):
        self.model, self.alpha, self.spark = model, alpha, model.edges.sparkSession
        self.vocabulary = cut(model.vocabulary)
        self.edges, self.role_edges, self.levels, self.totals = cut(model.edges), cut(model.role_edges), cut(model.levels), cut(model.totals)
        self.index = cut(r.resolve_index(self.vocabulary.select("name"), model.mapping))
        self.degree = cut(g.degree(self.edges))
        self.nodes = cut(model.nodes.select("s")) if model.nodes is not None else self.degree.select(F.col("i").alias("s"))
        self.trends = cut(model.trends) if model.trends is not None else None
        self.series = cut(model.series) if model.series is not None else None
        self._scores: dict[str, DataFrame] = {}

    # -- names ---------------------------------------------------------------------------

    def _named(self, names: Sequence[str]) -> dict[str, str | None]:
        """The canonical name of each given one: as it stands, or by its key."""
        asked = self.spark.createDataFrame([(x,) for x in dict.fromkeys(names)], "raw string")
        known = self.vocabulary.select(F.col("name").alias("raw"), F.col("name").alias("exact"))
        j = asked.withColumn("key", normalize(F.col("raw"))).join(known, "raw", "left").join(self.index, "key", "left")
        return {x["raw"]: x["c"] for x in j.select("raw", F.coalesce("exact", "name").alias("c")).collect()}

    def _in_graph(self, names: Sequence[str]) -> set[str]:
        return {x[0] for x in self.nodes.where(F.col("s").isin(*names)).collect()} if names else set()

    def _split(self, names: Sequence[str]) -> tuple[list[str], list[str]]:
        """(graph nodes, the rest) of the given names, in their order."""
        of = self._named(names)
        held = self._in_graph([c for c in of.values() if c])
        known, unknown = [], []
        for x in names:
            (known if of[x] in held else unknown).append(of[x] or x)
        return known, unknown

    def _trend(self, column: str, df: DataFrame) -> DataFrame:
        if self.trends is None:
            return df.withColumn("trend", F.lit(None).cast("double"))
        return df.join(self.trends.select(F.col("tech").alias(column), F.col("rank_slope").alias("trend")), column, "left")

    def health(self) -> dict:
        """Counts of the model, and what is missing in it."""
        missing = [n for n in ("trends", "vectors", "mapping") if getattr(self.model, n) is None]
        n = {"skills": self.vocabulary.count(), "nodes": self.nodes.count(), "edges": self.edges.count(), "roles": self.totals.where("level is null").count()}
        return {"ready": n["nodes"] > 0, **n, "errors": [*self.model.errors, *[f"no {x}" for x in missing]]}

    def normalize(self, names: Sequence[str]) -> list[dict]:
        """Each given name with its canonical one and whether the graph holds it; unknown ones have none."""
        of = self._named(names) if names else {}
        held = self._in_graph([c for c in of.values() if c])
        return [{"raw": x, "canonical": of[x], "in_graph": of[x] in held} for x in names]

    def skills(self, query: str = "", chosen: Sequence[str] = (), limit: int = 20) -> list[dict]:
        """Vocabulary entries that contain the query in any case, most mentioned first."""
        v = self.vocabulary.where(F.lower("name").contains(query.lower()) & ~F.col("name").isin(*chosen))
        return _rows(v.orderBy(F.desc_nulls_last("mentions"), "name").limit(limit).select("name", "category", "mentions"))

    def skill(self, name: str, neighbours: int = 15) -> dict:
        """A skill with its neighbours by PMI and by count, its roles by lift and its trend."""
        canonical = self._named([name])[name]
        if not canonical or canonical not in self._in_graph([canonical]):
            raise NotFound(f"unknown skill: {name}")
        meta = next(iter(_rows(self.vocabulary.where(F.col("name") == canonical).select("category", "in_survey", "mentions"))), {})
        near = g.adjacency(self.edges).where(F.col("i") == canonical)
        category = self.vocabulary.select(F.col("name").alias("j"), "category")

        def top(by: str) -> list[dict]:
            n = near.orderBy(F.desc(by), "j").limit(neighbours).join(category, "j", "left").orderBy(F.desc(by), "j")
            return _rows(n.select(F.col("j").alias("skill"), "category", "pmi", F.col("count").alias("postings")))

        roles = self.role_edges.where(F.col("skill") == canonical).orderBy(F.desc("lift"), "role").limit(8)
        trend = _rows(self._trend("skill", self.spark.createDataFrame([(canonical,)], "skill string")))[0]["trend"]
        degree = self._degree(canonical)
        return {"canonical": canonical, **meta, "degree": degree, "trend": trend, "distinctive": top("pmi"), "frequent": top("count"), "roles": _rows(roles.select("role", "support", "lift"))}

    # -- recommendations -----------------------------------------------------------------

    def _matrix(self, method: str) -> DataFrame:
        if method not in ("heuristic", "hybrid"):
            raise BadRequest(f"unknown method: {method}")
        if method == "hybrid" and self.model.vectors is None:
            raise BadRequest("the model has no vectors")
        if method not in self._scores:
            a = g.resource_allocation(self.edges)
            if method == "hybrid":
                zero = m.standardise(a, self.nodes)
                z0 = zero.agg(F.first("z0").alias("z0"))
                v = self.model.vectors.join(self.nodes, "s", "left_semi").withColumnRenamed("s", "id")
                c = m.standardise(m.cosine_pairs(v, -1.0, both=True), self.nodes).select("i", "j", "v")
                a = c.withColumnRenamed("v", "c").join(zero.select("i", "j", "v"), ["i", "j"], "left").join(F.broadcast(z0))
                a = a.select("i", "j", (self.alpha * F.coalesce("v", "z0") + (1 - self.alpha) * F.col("c")).alias("v"))
            self._scores[method] = cut(a)
        return self._scores[method]

    def recommend(self, skills: Sequence[str], top_k: int = 20, method: str = "heuristic", target_role: str | None = None, exclude_categories: Sequence[str] = ()) -> dict:
        """The best skills to add to the given ones, masked by a role and without some categories, ranked once at the end."""
        known, unknown = self._split(skills) if skills else ([], [])
        if not known:
            raise BadRequest("no recognisable skills", unknown=unknown)
        edges = self.role_edges.where(F.col("role") == target_role) if target_role is not None else None
        if edges is not None and edges.isEmpty():
            raise NotFound(f"unknown role: {target_role}")
        given = self.spark.createDataFrame([(x,) for x in known], "s string")
        s = m.unknown(m.known_scores(self._matrix(method), self.nodes, given), given)
        s = s.join(self.vocabulary.select(F.col("name").alias("j"), "category", "mentions"), "j", "left")
        if exclude_categories:
            s = s.where(F.coalesce(~F.col("category").isin(*exclude_categories), F.lit(True)))
        if edges is not None:
            s = s.join(edges.select(F.col("skill").alias("j"), "support", "lift"), "j", "left").withColumn("score", F.col("score") * m.role_mask(F.col("lift")))
        else:
            s = s.withColumn("support", F.lit(None).cast("double"))
        best = m.ranked(s.select("j", "score", "category", "mentions", F.col("support").alias("role_support")), top_k)
        share = g.conditional(self.edges, self.vocabulary.select(F.col("name").alias("s"), "mentions")).join(given.select(F.col("s").alias("i")).distinct(), "i", "left_semi")
        best = best.join(share.groupBy("j").agg(F.max("p").alias("given")), "j", "left").na.fill(0.0, ["given"])
        rows = _rows(self._trend("j", best).orderBy("rank").withColumnRenamed("j", "skill"))
        return {"method": method, "recognised": known, "unrecognised": unknown, "target_role": target_role, "recommendations": rows, "warning": self._warning(known)}

    def _degree(self, node: str) -> int:
        found = self.degree.where(F.col("i") == node).first()
        return found["d"] if found else 0

    def _warning(self, known: list[str]) -> str | None:
        """One known skill with more than twice the median of neighbours says little."""
        if len(known) != 1:
            return None
        d = self._degree(known[0])
        if d <= 2 * self.degree.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)")).first()[0]:
            return None
        return f"{known[0]} appears with {d} others; add a second skill for a more specific answer"

    # -- roles ---------------------------------------------------------------------------

    def roles(self) -> list[dict]:
        """Roles with their postings, in all and by level, and the skills they ask for."""
        by = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n")))))
        t = self.totals.groupBy("role").agg(F.max(F.when(F.col("level").isNull(), F.col("n"))).alias("postings"), by.alias("by_level"))
        n = self.role_edges.groupBy("role").agg(F.count("*").alias("distinct_skills"))
        return _rows(t.join(n, "role", "left").na.fill(0, ["distinct_skills"]).orderBy("role"))

    def gap(self, role: str, skills: Sequence[str] = (), seniority: str | None = None, top_k: int = 20) -> dict:
        """What a role, or one of its levels, asks for that the given skills don't cover."""
        edges = self.role_edges.where(F.col("role") == role)
        if edges.isEmpty():
            raise NotFound(f"unknown role: {role}")
        postings = {x["level"]: x["n"] for x in self.totals.where(F.col("role") == role).collect()}
        if seniority is not None:
            if postings.get(seniority) is None:
                raise Unprocessable("unknown seniority")
            if postings[seniority] < LEAST_POSTINGS:
                raise Unprocessable("too few postings for this seniority")
            share = self.levels.where((F.col("role") == role) & (F.col("level") == seniority) & (F.col("share") > 0)).select("skill", "share")
            edges = edges.join(share, "skill").withColumn("support", F.col("share"))
        have = self.spark.createDataFrame([(c,) for c in self._named(skills).values() if c] if skills else [], "skill string")
        rows = cut(p.gap(edges.select("skill", "role", "support", "lift"), have))
        n = rows.agg(F.count("*").alias("n"), F.count_if("have").alias("h")).first()
        show = lambda df: _rows(self._trend("skill", df).orderBy(*order).select("skill", "support", "lift", "trend"))
        order = (F.desc("support"), "skill")
        covered = show(rows.where("have").orderBy(*order).limit(30))
        order = (F.desc(p.gap_score()), "skill")
        gaps = show(rows.where("not have").orderBy(*order).limit(top_k))
        return {"role": role, "seniority": seniority, "postings_analysed": postings.get(seniority), "coverage": round(n["h"] / n["n"], 4) if n["n"] else 0.0, "you_have": covered, "gaps": gaps}

    def match(self, skills: Sequence[str]) -> dict:
        """All roles by how much of what they ask for the given skills cover, weighted by support."""
        have = sorted({c for c in self._named(skills).values() if c}) if skills else []
        if not have:
            raise BadRequest("no recognisable skills")
        rows = p.match(self.role_edges, self.spark.createDataFrame([(c,) for c in have], "skill string"))
        rows = rows.join(self.totals.where("level is null").select("role", F.col("n").alias("postings")), "role", "left")
        split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")).alias(c)
        rows = rows.select("role", F.round("coverage", 4).alias("coverage"), split("matched"), split("top_missing"), "postings")
        return {"recognised": have, "roles": _rows(rows.orderBy(F.desc("coverage"), "role"))}

    # -- trends --------------------------------------------------------------------------

    def trend(self, name: str) -> dict:
        """The fit and series of a technology, by its canonical name or as given."""
        canonical = (self._named([name])[name] or name) if self.trends is not None else name
        found = _rows(self.trends.where(F.col("tech") == canonical)) if self.trends is not None else []
        if not found:
            raise NotFound(f"no trend data for {name}")
        series = {str(x["year"]): x["share"] for x in self.series.where(F.col("tech") == canonical).orderBy("year").collect()} if self.series is not None else {}
        return {**found[0], "series": series}

    def trends_overview(self, direction: str = "rising", limit: int = 20) -> list[dict]:
        """Technologies observed in four years or more by the slope of their rank."""
        if direction not in ("rising", "falling"):
            raise Unprocessable(f"unknown direction: {direction}")
        if self.trends is None:
            return []
        t = self.trends.where("rank_slope is not null and n_years >= 4")
        order = F.desc("rank_slope") if direction == "rising" else F.asc("rank_slope")
        return _rows(t.orderBy(order, "tech").limit(limit).select(F.col("tech").alias("skill"), "rank_slope", "latest", "n_years"))

    # -- resumes -------------------------------------------------------------------------

    def resume(self, text: str, top_k: int = 20, target_role: str | None = None, embed=None, threshold: float = 0.8) -> dict:
        """Skills found in a document, what no name matches, and the recommendations and roles for those found.

        With ``embed`` (see :mod:`tagloom.sources.models`) unmatched spans are matched to
        the nearest name from ``threshold`` on, at a lower weight.
        """
        docs = self.spark.createDataFrame([(1, text)], "doc_id int, text string")
        lines = cut(r.segment(r.lines(docs, "doc_id", "text")))
        e = cut(r.evidence(lines, self.index))
        found = r.best_evidence(e)
        loose = r.unmatched(e)
        if embed is not None:
            near = cut(r.inferred(loose, self.vocabulary.select("name"), embed, threshold))
            found = found.unionByName(near.join(found.select("name"), "name", "left_anti").select(F.lit(1).alias("doc_id"), "name", F.lit("inferred").alias("section"), "span", F.lit(False).alias("elementary"), F.lit(r.INFERRED_WEIGHT).alias("weight")).dropDuplicates(["name"]))
            loose = loose.join(near.select("span"), "span", "left_anti")
        skills = _rows(self._trend("name", found.drop("doc_id")).orderBy(F.desc("weight"), "name"))
        out = {
            "sections": {x["section"]: x["count"] for x in lines.groupBy("section").count().collect()}, "skills": skills,
            "unmatched": [x["span"] for x in loose.orderBy(F.desc("n"), "span").limit(40).collect()],
        }
        names = [x["name"] for x in skills]
        if self._in_graph(names):
            out |= {"recommendations": self.recommend(names, top_k, target_role=target_role)["recommendations"], "role_match": self.match(names)["roles"][:5]}
        return out
