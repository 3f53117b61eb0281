"""Vocabulary: mentions, admission, variants, duplicates and merging of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.functions import names as n
from tagloom.operators import cluster as c
from tagloom.operators.dedup import greedy_dedup
from tagloom.operators.matrix import cosine_pairs
from tagloom.plans.market import postings, table, with_
from tagloom.queries.text import _TOK, token_counts, tokens
from tagloom.sources.survey import flat_category


def join_left(spark, d):
    """Clean postings with the columns of their raw rows, repeated links multiplied."""
    clean, raw = table(spark, d, "postings_clean"), table(spark, d, "postings").select("job_link", "posted_at")
    return clean.select("clean_id", "job_link").join(raw, "job_link", "left").groupBy("clean_id").agg(F.count("*").alias("n_rows"), F.max("posted_at").alias("last_posted"))


def mapping(spark, d):
    """``raw, canonical``: decisions made, overridden by the reference names themselves."""
    a = table(spark, d, "final_mapping").where("canonical is not null").select("raw", "canonical", F.lit(1).alias("prio"))
    b = table(spark, d, "final_vocab").select(F.col("canonical").alias("raw"), "canonical", F.lit(0).alias("prio"))
    return a.unionByName(b).groupBy("raw").agg(F.min_by("canonical", F.struct("prio", "canonical")).alias("canonical"))


def mentions(spark, d):
    counts = token_counts(spark, d)
    a = table(spark, d, "final_mapping").where("canonical is not null").join(counts, "raw").select("canonical", "n")
    b = counts.join(table(spark, d, "final_vocab").select(F.col("canonical").alias("raw")), "raw", "left_semi").select(F.col("raw").alias("canonical"), "n")
    return a.unionByName(b).groupBy("canonical").agg(F.sum("n").alias("mentions"))


def spread(spark, d):
    """Companies per name; the null company counts as one."""
    t = tokens(spark, d).join(mapping(spark, d), "raw")
    return t.groupBy("canonical").agg(F.count_distinct(F.coalesce("company", F.lit("␀"))).alias("companies"))


def admitted(spark, d):
    v = table(spark, d, "final_vocab").select("canonical", "in_survey", "category")
    j = mentions(spark, d).join(spread(spark, d), "canonical", "left").join(v, "canonical", "left")
    s, e = F.coalesce("in_survey", F.lit(False)), F.coalesce("companies", F.lit(0))
    wide = (e >= 8) & (F.coalesce("category", F.lit("")) == "tech-product")
    return j.where(s | (F.col("mentions") >= 20) | wide).select("canonical", "mentions", e.alias("companies"), s.alias("in_survey"))


def rollup(spark, d):
    """Per category of names: variants, years and the largest yearly frequency."""
    line, part, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    r = line.join(part, line["l_partkey"] == part["p_partkey"]).join(o, o["o_orderkey"] == line["l_orderkey"])
    f = r.groupBy(F.element_at(F.split("p_name", " "), -1).alias("category"), "p_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("freq"))
    return f


def vocab_rollup(spark, d):
    return rollup(spark, d).groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("variants"), F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), "|").alias("years"), F.max("freq").alias("max_frequency")
    )


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


#: Distance under which two vectors merge, on the embeddings table.
LIMIT = 0.58


def cluster_components(spark, d):
    v = vectors(spark, d)
    return c.components(v.select("id"), cosine_pairs(v, 1 - LIMIT))


def named_clusters(spark, d):
    """Vector clusters with invented names, mentions and survey flags."""
    v = vectors(spark, d)
    k = c.clusters(v, cosine_pairs(v, 1 - LIMIT), LIMIT)
    return k.select("cluster", F.concat(F.lit("name "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), (F.col("id") % 7 == 0).alias("in_survey"), (F.col("id") * 37 % 101).alias("mentions"))


def cluster_head(spark, d):
    m = named_clusters(spark, d)
    groups = m.where("mentions % 10 < 2").select((F.col("mentions") % 10).alias("group"), "name")
    return c.heads(m, c.blocked_pairs(groups))


def merge_log(spark, d):
    m = named_clusters(spark, d)
    return c.merge_log(c.heads(m, c.blocked_pairs(c.never_merge(spark))), m.select("name", "mentions"))


def dedup_input(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    s = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("p_type")).alias("s")).where(F.size("s") >= 2)
    return s.join(postings(spark, d).select("k", "company"), "k")


def _names(spark, d):
    return table(spark, d, "graph_nodes").select("name"), table(spark, d, "final_vocab").select(F.col("canonical").alias("name"))


def tech_only(spark, d):
    """Mentions of the entries whose category begins with tech, and of the others, which are dropped."""
    v = table(spark, d, "final_vocab").select("canonical", "category")
    j = mentions(spark, d).join(v, "canonical")
    kept = F.coalesce(F.lower(F.trim("category")).startswith("tech"), F.lit(False)) & (F.col("canonical") != "")
    return j.groupBy(kept.alias("kept")).agg(F.count("*").alias("terms"), F.sum("mentions").alias("mentions"))


def dropped_mentions(spark, d):
    """Terms and mentions that admission drops."""
    keep = admitted(spark, d).select("canonical")
    return mentions(spark, d).join(keep, "canonical", "left_anti").agg(F.count("*").alias("terms"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"))


def category_flatten(spark, d):
    """Every name with all categories that list it, as one string."""
    a = table(spark, d, "final_vocab").select(F.col("canonical").alias("name"), "category")
    b = table(spark, d, "graph_nodes").select("name", "category")
    c = a.unionByName(b).where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return c.select("name", flat_category(F.col("c")).alias("category"))


QUERIES = {
    "tech_only": tech_only,
    "dropped_mentions": dropped_mentions,
    "category_flatten": category_flatten,
    "vocabulary_ordered": lambda s, d: table(s, d, "final_vocab").select("canonical", "mentions", F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("mentions"))).alias("place")),
    "join_left": join_left,
    "mentions_union_sum": mentions,
    "mapping_override_union": mapping,
    "company_spread": spread,
    "vocab_rollup": vocab_rollup,
    "pick_canonical": lambda s, d: rollup(s, d).groupBy("category").agg(F.max_by("p_name", F.struct("year", "freq", F.length("p_name").alias("l"), "p_name")).alias("canonical")),
    "vocab_admission": admitted,
    "vocab_via_spread": lambda s, d: admitted(s, d).where("not in_survey and mentions < 20").orderBy(F.desc("companies"), "canonical").limit(12),
    "display_override": lambda s, d: mapping(s, d).select("raw", n.display_name(F.col("canonical")).alias("shown")),
    "raw_variants": lambda s, d: mapping(s, d).groupBy("canonical").agg(F.count("*").alias("raw_variants")),
    "classified_category_rollup": lambda s, d: token_counts(s, d).join(mapping(s, d), "raw").join(table(s, d, "final_vocab").select("canonical", "category"), "canonical").groupBy("category").agg(F.count("*").alias("n_strings"), F.sum("n").alias("n_mentions")),
    "dedup_greedy_jaccard": lambda s, d: greedy_dedup(dedup_input(s, d), "k", "company", "s").select("k", "company"),
    "blocked_pairs": lambda s, d: c.blocked_pairs(c.never_merge(s)),
    "cluster_components": cluster_components,
    "cluster_head": cluster_head,
    "merge_log": merge_log,
    "set_except": lambda s, d: _names(s, d)[0].exceptAll(_names(s, d)[1]),
    "set_distinct": lambda s, d: table(s, d, "final_mapping").where("canonical is not null").select("canonical").distinct(),
    "set_intersect": lambda s, d: _names(s, d)[0].intersect(_names(s, d)[1]),
}

_MAP = "mp AS (SELECT raw, arg_min(canonical, (prio, canonical)) AS canonical FROM (SELECT raw, canonical, 1 AS prio FROM final_mapping WHERE canonical IS NOT NULL UNION ALL SELECT canonical, canonical, 0 FROM final_vocab) GROUP BY raw)"
_MEN = "men AS (SELECT canonical, sum(n)::BIGINT AS mentions FROM (SELECT canonical, n FROM final_mapping JOIN tc USING (raw) WHERE canonical IS NOT NULL UNION ALL SELECT raw, n FROM tc WHERE raw IN (SELECT canonical FROM final_vocab)) GROUP BY canonical)"
_SPR = "spr AS (SELECT canonical, count(DISTINCT coalesce(company, '␀')) AS companies FROM tok JOIN mp USING (raw) GROUP BY canonical)"
_ADM = "adm AS (SELECT canonical, mentions, coalesce(companies, 0) AS companies, coalesce(in_survey, false) AS in_survey FROM men LEFT JOIN spr USING (canonical) LEFT JOIN final_vocab v USING (canonical) WHERE coalesce(in_survey, false) OR men.mentions >= 20 OR (coalesce(companies, 0) >= 8 AND coalesce(category, '') = 'tech-product'))".replace("SELECT canonical, mentions,", "SELECT canonical, men.mentions,")
_RU = "WITH f AS (SELECT split_part(p_name, ' ', -1) AS category, p_name, year(o_orderdate) AS year, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) "
_W = f"WITH {_TOK}, {_MAP}, {_MEN}, {_SPR}, {_ADM} "

ORACLE = {
    "tech_only": _W + "SELECT coalesce(starts_with(lower(trim(category)), 'tech'), false) AND canonical <> '' AS kept, count(*) AS terms, sum(mentions)::BIGINT AS mentions FROM men JOIN (SELECT canonical, category FROM final_vocab) USING (canonical) GROUP BY 1",
    "dropped_mentions": _W + "SELECT count(*) AS terms, coalesce(sum(mentions), 0)::BIGINT AS mentions FROM men WHERE canonical NOT IN (SELECT canonical FROM adm)",
    "category_flatten": "SELECT name, coalesce(string_agg(DISTINCT category, '/' ORDER BY category), '') AS category FROM (SELECT canonical AS name, category FROM final_vocab UNION ALL SELECT name, category FROM graph_nodes) WHERE name IS NOT NULL GROUP BY name",
    "vocabulary_ordered": "SELECT canonical, mentions, dense_rank() OVER (PARTITION BY category ORDER BY mentions DESC NULLS LAST) AS place FROM final_vocab",
    "join_left": "SELECT clean_id, count(*) AS n_rows, max(posted_at) AS last_posted FROM postings_clean LEFT JOIN postings USING (job_link) GROUP BY clean_id",
    "mentions_union_sum": _W + "SELECT * FROM men",
    "mapping_override_union": _W + "SELECT * FROM mp",
    "company_spread": _W + "SELECT * FROM spr",
    "vocab_rollup": _RU + "SELECT category, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS variants, string_agg(DISTINCT year::VARCHAR, '|' ORDER BY year::VARCHAR) AS years, max(freq) AS max_frequency FROM f GROUP BY category",
    "pick_canonical": _RU + "SELECT category, arg_max(p_name, (year, freq, length(p_name), p_name)) AS canonical FROM f GROUP BY category",
    "vocab_admission": _W + "SELECT * FROM adm",
    "vocab_via_spread": _W + "SELECT * FROM adm WHERE NOT in_survey AND mentions < 20 ORDER BY companies DESC, canonical LIMIT 12",
    "display_override": _W + "SELECT raw, CASE canonical " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in n.SHOWN_AS.items()) + " ELSE canonical END AS shown FROM mp",
    "raw_variants": _W + "SELECT canonical, count(*) AS raw_variants FROM mp GROUP BY canonical",
    "classified_category_rollup": _W + "SELECT category, count(*) AS n_strings, sum(n)::BIGINT AS n_mentions FROM tc JOIN mp USING (raw) JOIN final_vocab USING (canonical) GROUP BY category",
    "dedup_greedy_jaccard": with_("post") + """, s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(p_type))) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_type) >= 2),
c AS (SELECT company, list_reduce(list([{'k': k, 's': s}] ORDER BY k), lambda a, x: CASE WHEN len(list_filter(a, lambda y: len(list_intersect(y.s, x[1].s)) * 8 >= 3 * (len(y.s) + len(x[1].s)))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM s JOIN post USING (k) GROUP BY company)
SELECT u.k AS k, company FROM (SELECT company, unnest(kept) AS u FROM c)""",
    "blocked_pairs": "WITH g(grp, name) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, g in enumerate(c.NEVER_MERGE) for x in g) + ") SELECT DISTINCT x.name AS a, y.name AS b FROM g x JOIN g y ON x.grp = y.grp AND x.name <> y.name",
    "cluster_components": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
ed AS MATERIALIZED (SELECT x.id AS i, y.id AS j FROM u x JOIN u y ON x.id <> y.id WHERE list_dot_product(x.v, y.v) >= {1 - LIMIT}), r AS (SELECT id AS id, id AS c FROM u UNION SELECT j, c FROM r JOIN ed ON i = r.id WHERE c < j)
SELECT id, min(c) AS component FROM r GROUP BY id""",
    "set_except": "SELECT name FROM graph_nodes EXCEPT ALL SELECT canonical FROM final_vocab",
    "set_distinct": "SELECT DISTINCT canonical FROM final_mapping WHERE canonical IS NOT NULL",
    "set_intersect": "SELECT name FROM graph_nodes INTERSECT SELECT canonical FROM final_vocab",
}
