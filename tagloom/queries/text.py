"""Names and documents: keys, aliases, resolution, sections, spans and evidence."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.functions import names as n
from tagloom.operators import resume as r
from tagloom.plans.lineage import shared_folder
from tagloom.plans.market import table
from tagloom.queries.graph import edges, mentions, neighbours
from tagloom.queries.roles import skill_roles
from tagloom.sources import files


def tokens(spark, d):
    """``raw, company`` of the comma-separated values, trimmed, empty ones dropped."""
    t = table(spark, d, "postings").select("company", F.explode(F.split("job_skills", ",")).alias("t"))
    return t.select("company", F.regexp_replace("t", r"^\s+|\s+$", "").alias("raw")).where("raw != ''")


def token_counts(spark, d):
    return tokens(spark, d).groupBy("raw").agg(F.count("*").alias("n"))


def vocabulary(spark, d):
    return table(spark, d, "final_vocab").select(F.col("canonical").alias("name"))


def index(spark, d):
    return r.resolve_index(vocabulary(spark, d), table(spark, d, "final_mapping"))


def cascade(spark, d):
    """``raw, n, canonical, method``: by its key, else by an alias, of tokens seen three times or more."""
    counts = token_counts(spark, d).where("n >= 3").withColumn("key", n.normalize(F.col("raw")))
    v = vocabulary(spark, d)
    by_key = v.groupBy(n.normalize(F.col("name")).alias("key")).agg(F.min("name").alias("exact"))
    al = v.select("name", F.explode(n.aliases(F.col("name"), n.vocabulary_key(F.col("name")))).alias("a"))
    al = al.groupBy(n.normalize(F.col("a")).alias("key")).agg(F.min("name").alias("alias"))
    j = counts.join(by_key, "key", "left").join(al, "key", "left")
    return j.select("raw", "n", F.coalesce("exact", "alias").alias("canonical"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").alias("method"))


def resumes(spark, d):
    """Postings as documents: the title, then their skills under one of three headers."""
    h = F.element_at(F.array(F.lit("SKILLS"), F.lit("Personal Projects"), F.lit("COURSEWORK")), (F.col("posting_id") % 3 + 1).cast("int"))
    return table(spark, d, "postings").select("posting_id", F.concat_ws("\n", F.coalesce("job_title", F.lit("")), h, F.coalesce("job_skills", F.lit(""))).alias("text"))


def segmented(spark, d):
    return r.segment(r.lines(resumes(spark, d), "posting_id", "text"))


def evidence(spark, d):
    return r.evidence(segmented(spark, d), index(spark, d))


def best(spark, d):
    return r.best_evidence(evidence(spark, d))


def src_csv_roundtrip(spark, d):
    path = os.path.join(shared_folder(spark), f"csv-{uuid.uuid4().hex}")
    cols = table(spark, d, "postings").select("job_link", F.coalesce("job_title", F.lit("")).alias("job_title"), F.regexp_replace(F.coalesce("job_skills", F.lit("")), r"\r?\n", "; ").alias("job_skills"))
    files.write_csv(cols, path)
    return files.read_csv(spark, path, "job_link string, job_title string, job_skills string").na.fill("")


def autocomplete(spark, d):
    v = table(spark, d, "final_vocab").where(F.lower("canonical").contains("server"))
    chosen = table(spark, d, "final_vocab").where("in_survey").select("canonical")
    return v.join(chosen, "canonical", "left_anti").orderBy(F.desc_nulls_last("mentions"), "canonical").limit(5).select("canonical", "mentions")


def resume_by_section(spark, d):
    return best(spark, d).groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name"))), lambda x: x["name"]), "|").alias("skills"))


def resume_pipeline(spark, d):
    """Per document: skills found, their summed weight, and the strongest five."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "name")
    b = best(spark, d).withColumn("rn", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "name"))))
    return b.groupBy("doc_id").agg(F.count("*").alias("n_skills"), F.round(F.sum("weight"), 3).alias("weight"), F.array_join(F.transform(top, lambda x: x["name"]), "|").alias("top"))


def api_normalize(spark, d):
    """Each distinct token with its canonical name; unknown ones stay, with null."""
    t = token_counts(spark, d).withColumn("key", n.normalize(F.col("raw")))
    return t.join(index(spark, d), "key", "left").select("raw", F.col("name").alias("canonical"))


def api_skill_detail(spark, d):
    """Each graph node with its neighbours by PMI and by count and its roles by lift."""
    def joined(df, key, item, rank, name):
        a = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]), "|").alias(name)
        return df.groupBy(F.col(key).alias("skill")).agg(a)

    a = joined(neighbours("pmi")(spark, d), "i", "j", "rank", "distinctive")
    b = joined(neighbours("count")(spark, d), "i", "j", "rank", "frequent")
    c = joined(skill_roles(spark, d), "skill", "role", "rank", "roles")
    m = mentions(spark, d).withColumnRenamed("s", "skill")
    return a.join(b, "skill").join(c, "skill", "left").join(m, "skill").na.fill("", ["roles"])


def api_health(spark, d):
    return vocabulary(spark, d).agg(F.count("*").alias("n_skills")).join(table(spark, d, "graph_edges").agg(F.count("*").alias("n_edges"))).withColumn("ready", F.col("n_skills") > 0)


QUERIES = {
    "src_csv_roundtrip": src_csv_roundtrip,
    "doc_lines": lambda s, d: r.lines(table(s, d, "documents"), "doc_id", "text"),
    "token_counts_having": lambda s, d: token_counts(s, d).where("n >= 3"),
    "normalize": lambda s, d: table(s, d, "final_mapping").select("raw", n.normalize(F.col("raw")).alias("key")),
    "alias_generate": lambda s, d: vocabulary(s, d).select("name", F.array_join(n.aliases(F.col("name"), n.vocabulary_key(F.col("name"))), "|").alias("aliases")),
    "slash_index": lambda s, d: vocabulary(s, d).select("name", F.explode(n.slash_parts(F.col("name"))).alias("part")).select("name", n.normalize(F.col("part")).alias("key")),
    "resolve_index": index,
    "cascade_match": cascade,
    "unmatched_topk": lambda s, d: cascade(s, d).where("method is null").orderBy(F.desc("n"), "raw").limit(50).select("raw", "n"),
    "token_coverage": lambda s, d: cascade(s, d).agg(F.round(F.sum(F.when(F.col("method").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"), F.count_if(F.col("method") == "exact").alias("n_exact"), F.count_if(F.col("method") == "alias").alias("n_alias")),
    "autocomplete": autocomplete,
    "looks_like_header": lambda s, d: r.lines(table(s, d, "documents"), "doc_id", "text").where(r.looks_like_header(F.col("line"))),
    "segment_carry_forward": segmented,
    "section_counts": lambda s, d: segmented(s, d).groupBy("section").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs")),
    "candidate_spans": lambda s, d: segmented(s, d).select("doc_id", "line_no", F.explode_outer(r.candidate_spans(F.col("line"))).alias("span")).where("span is not null").groupBy("doc_id", "span").agg(F.count("*").alias("n")),
    "resume_weights": lambda s, d: evidence(s, d).where("name is not null").groupBy("section", "elementary", "weight").agg(F.count("*").alias("n")),
    "resume_best_evidence": best,
    "resume_by_section": resume_by_section,
    "resume_unmatched": lambda s, d: r.unmatched(evidence(s, d)).orderBy(F.desc("n"), "span").limit(40),
    "resume_pipeline": resume_pipeline,
    "api_normalize": api_normalize,
    "api_skills": lambda s, d: table(s, d, "final_vocab").select(F.col("canonical").alias("name"), "category", "mentions"),
    "api_skill_detail": api_skill_detail,
    "api_health": api_health,
}

from tagloom.plans.market import GRAPH, ROLE, with_  # noqa: E402
from tagloom.queries.trends import _norm, _renames  # noqa: E402


def _l(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TOK = "tok AS (SELECT company, raw FROM (SELECT company, " + _TRIM.format("unnest(string_split(job_skills, ','))") + " AS raw FROM postings) WHERE raw <> ''), tc AS (SELECT raw, count(*) AS n FROM tok GROUP BY raw)"
_BARE = r"trim(regexp_replace(name, '\(.*?\)', '', 'g'))"
_SLASH = f"CASE WHEN contains({_BARE}, '/') AND NOT starts_with({_BARE}, '.') THEN list_filter(list_transform(string_split({_BARE}, '/'), lambda x: trim(x)), lambda x: len(x) > 1) ELSE [] END"
_V = "v AS (SELECT canonical AS name FROM final_vocab)"
_CUTS = "[" + ", ".join(f"CASE WHEN starts_with(lower(name), '{p}') THEN trim(substr(name, {len(p) + 1})) END" for p in n.VENDORS) + "]"
_EXTRA = "CASE " + _renames(_norm("name"), n.VOCABULARY_RENAMES) + " " + " ".join(f"WHEN '{k}' THEN [{_l(v)}]" for k, v in n.EXTRA_ALIASES.items()) + " ELSE [] END"
_AL = f"""al AS (SELECT name, list_sort(list_filter(list_distinct(list_concat(list_filter(list_concat(list_concat([{_BARE}], {_CUTS}), {_SLASH}),
  lambda x: x IS NOT NULL AND len(x) > 1 AND lower(x) NOT IN ({_l(n.TOO_GENERAL)})), {_EXTRA})), lambda x: x <> name)) AS a FROM v)"""
_IX = f"""ixa AS (SELECT {_norm('k')} AS key, name, 0 AS prio FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in r.SPELLINGS.items())}) t(k, name)
  UNION ALL SELECT {_norm('name')}, name, 1 FROM v UNION ALL SELECT {_norm('p')}, name, 2 FROM (SELECT unnest({_SLASH}) AS p, name FROM v)
  UNION ALL SELECT {_norm('raw')}, canonical, 3 FROM final_mapping WHERE canonical IS NOT NULL),
ix AS (SELECT key, arg_min(name, (prio, name)) AS name FROM ixa WHERE key <> '' GROUP BY key)"""
_CAS = f"""cas AS (SELECT raw, n, coalesce(e.name, f.name) AS canonical, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN f.name IS NOT NULL THEN 'alias' END AS method
FROM (SELECT *, {_norm('raw')} AS key FROM tc WHERE n >= 3) c LEFT JOIN (SELECT {_norm('name')} AS key, min(name) AS name FROM v GROUP BY 1) e USING (key)
LEFT JOIN (SELECT {_norm('x')} AS key, min(name) AS name FROM (SELECT name, unnest(a) AS x FROM al) GROUP BY 1) f USING (key))"""


def _lines(src: str, id_: str) -> str:
    return f"ln AS (SELECT doc_id, line_no, line FROM (SELECT {id_} AS doc_id, generate_subscripts(l, 1) - 1 AS line_no, {_TRIM.format('unnest(l)')} AS line FROM (SELECT {id_}, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM {src} WHERE text IS NOT NULL)) WHERE line <> '')"


_UP, _LT = r"len(regexp_extract_all(line, '\p{Lu}'))", r"len(regexp_extract_all(line, '\p{L}'))"
_HDR = (
    r"(length(line) > 2 AND length(line) < 60 AND NOT (regexp_matches(line, '[.,;:]$') AND len(regexp_split_to_array(line, '\s+')) > 4) AND "
    + _LT + " > 0 AND (" + _UP + " > 0.6 * " + _LT + " OR (" + _UP + r" > 0 AND NOT regexp_matches(line, '(^|[^\p{L}])\p{Ll}') AND NOT regexp_matches(line, '\p{L}\p{Lu}'))))"
)
_SEC = "CASE WHEN " + _HDR + " THEN CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{s}'" for s, p in r.SECTIONS) + " END END"
_DOC = "doc AS (SELECT posting_id, concat_ws(chr(10), coalesce(job_title, ''), ['SKILLS', 'Personal Projects', 'COURSEWORK'][posting_id % 3 + 1], coalesce(job_skills, '')) AS text FROM postings)"
_SEG = _DOC + ", " + _lines("doc", "posting_id") + f", sg0 AS (SELECT *, {_SEC} AS h FROM ln), sg AS (SELECT doc_id, line_no, section, line FROM (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'other') AS section FROM sg0) WHERE h IS NULL)"
_STOP = f"[{_l(r.STOPWORDS)}]"
_RUN = "list_transform(list_filter(list_transform(generate_series(1, len(w) - {m}), lambda i: w[i:i + {m}]), lambda c: NOT list_contains(" + _STOP + ", lower(c[1])) AND NOT list_contains(" + _STOP + ", lower(c[{n}]))), lambda c: array_to_string(c, ' '))"
_RUNS = ", ".join(_RUN.format(m=i - 1, n=i) for i in (1, 2, 3, 4))
_SP = (
    r"bd AS (SELECT *, regexp_replace(line, '^[•\-*●▪]\s*', '') AS body FROM sg), wd AS (SELECT *, regexp_extract_all(body, '[A-Za-z0-9+#.\-]+') AS w FROM bd), "
    r"sa AS (SELECT doc_id, line_no, section, line, list_filter(flatten([list_transform(regexp_split_to_array(body, '[,;|]|\s{2,}'), lambda x: regexp_replace(x, '^[ .:]+|[ .:]+$', '', 'g')), "
    + _RUNS + "]), lambda x: length(x) > 1 AND length(x) < 40) AS a FROM wd), sps AS (SELECT doc_id, line_no, section, contains(line, '*') AS elementary, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS span FROM sa)"
)
_WT = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in r.WEIGHTS.items()) + " END"
_EV = f"""ev AS (SELECT doc_id, line_no, pos, section, span, elementary, round({_WT} * CASE WHEN elementary THEN 0.75::DOUBLE ELSE 1 END, 3) AS weight, name FROM (SELECT *, {_norm('span')} AS key FROM sps) LEFT JOIN ix USING (key)
  WHERE NOT coalesce(lower(name) IN ({_l(r.GENERIC)}) AND section NOT IN ('skills', 'coursework'), false))"""
_B = "be AS (SELECT doc_id, name, b.section, b.span, b.elementary, b.weight FROM (SELECT doc_id, name, arg_min({section: section, span: span, elementary: elementary, weight: weight}, (-weight, line_no, pos)) AS b FROM ev WHERE name IS NOT NULL GROUP BY doc_id, name))"
_FULL = "WITH " + ", ".join([_V, _IX, _SEG, _SP, _EV, _B]) + " "

ORACLE = {
    "src_csv_roundtrip": r"SELECT job_link, coalesce(job_title, '') AS job_title, regexp_replace(coalesce(job_skills, ''), '\r?\n', '; ', 'g') AS job_skills FROM postings",
    "doc_lines": "WITH " + _lines("documents", "doc_id") + " SELECT * FROM ln",
    "token_counts_having": f"WITH {_TOK} SELECT * FROM tc WHERE n >= 3",
    "normalize": f"SELECT raw, {_norm('raw')} AS key FROM final_mapping",
    "alias_generate": f"WITH {_V}, {_AL} SELECT name, array_to_string(a, '|') AS aliases FROM al",
    "slash_index": f"WITH {_V} SELECT name, {_norm('p')} AS key FROM (SELECT name, unnest({_SLASH}) AS p FROM v)",
    "resolve_index": f"WITH {_V}, {_IX} SELECT * FROM ix",
    "cascade_match": f"WITH {_TOK}, {_V}, {_AL}, {_CAS} SELECT * FROM cas",
    "unmatched_topk": f"WITH {_TOK}, {_V}, {_AL}, {_CAS} SELECT raw, n FROM cas WHERE method IS NULL ORDER BY n DESC, raw LIMIT 50",
    "token_coverage": f"WITH {_TOK}, {_V}, {_AL}, {_CAS} SELECT round(sum(CASE WHEN method IS NOT NULL THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS coverage, count_if(method = 'exact') AS n_exact, count_if(method = 'alias') AS n_alias FROM cas",
    "autocomplete": "SELECT canonical, mentions FROM final_vocab WHERE contains(lower(canonical), 'server') AND canonical NOT IN (SELECT canonical FROM final_vocab WHERE in_survey) ORDER BY mentions DESC NULLS LAST, canonical LIMIT 5",
    "looks_like_header": "WITH " + _lines("documents", "doc_id") + f" SELECT * FROM ln WHERE {_HDR}",
    "segment_carry_forward": f"WITH {_SEG} SELECT * FROM sg",
    "section_counts": f"WITH {_SEG} SELECT section, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM sg GROUP BY section",
    "candidate_spans": f"WITH {_SEG}, {_SP} SELECT doc_id, span, count(*) AS n FROM sps GROUP BY doc_id, span",
    "resume_weights": _FULL + "SELECT section, elementary, weight, count(*) AS n FROM ev WHERE name IS NOT NULL GROUP BY ALL",
    "resume_best_evidence": _FULL + "SELECT * FROM be",
    "resume_by_section": _FULL + "SELECT doc_id, section, string_agg(name, '|' ORDER BY weight DESC, name) AS skills FROM be GROUP BY doc_id, section",
    "resume_unmatched": _FULL + rf"SELECT span, count(*) AS n FROM ev WHERE name IS NULL AND len(regexp_split_to_array(span, '\s+')) <= 3 AND regexp_matches(span, '\p{{L}}') AND lower(span) NOT IN ({_l(r.STOPWORDS)}) AND length(span) > 2 GROUP BY span ORDER BY n DESC, span LIMIT 40",
    "resume_pipeline": _FULL + "SELECT doc_id, count(*) AS n_skills, round(sum(weight), 3) AS weight, array_to_string(list_slice(list(name ORDER BY weight DESC, name), 1, 5), '|') AS top FROM be GROUP BY doc_id",
    "api_normalize": f"WITH {_TOK}, {_V}, {_IX} SELECT raw, name AS canonical FROM (SELECT *, {_norm('raw')} AS key FROM tc) LEFT JOIN ix USING (key)",
    "api_skills": "SELECT canonical AS name, category, mentions FROM final_vocab",
    "api_skill_detail": with_(*GRAPH, *ROLE, "a") + """, ra AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY pmi DESC, j) AS x, row_number() OVER (PARTITION BY i ORDER BY count DESC, j) AS y FROM a),
rr AS (SELECT skill, role, row_number() OVER (PARTITION BY skill ORDER BY lift DESC, role) AS z FROM re), m AS (SELECT p_name AS skill, count(*) AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT skill, string_agg(j, '|' ORDER BY x) FILTER (x <= 15) AS distinctive, string_agg(j, '|' ORDER BY y) FILTER (y <= 15) AS frequent, any_value(coalesce(roles, '')) AS roles, any_value(mentions) AS mentions
FROM ra JOIN m ON skill = i LEFT JOIN (SELECT skill, string_agg(role, '|' ORDER BY z) FILTER (z <= 8) AS roles FROM rr GROUP BY skill) USING (skill) GROUP BY skill""",
    "api_health": "SELECT n_skills, n_edges, n_skills > 0 AS ready FROM (SELECT count(*) AS n_skills FROM final_vocab), (SELECT count(*) AS n_edges FROM graph_edges)",
}
