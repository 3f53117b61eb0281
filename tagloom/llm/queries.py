"""Queries pN_ of the operators for training data, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import fold, squeeze
from tagloom.llm.canonical import to_canonical
from tagloom.llm.cooccurrence import cooccurrence
from tagloom.llm.cross_split import overlaps_between
from tagloom.llm.leakage import leaked
from tagloom.llm.packing import pack, public_counter
from tagloom.llm.set_join import class_links, expand, expand_between, similar_classes
from tagloom.llm.subjects import MOST_SUBJECTS, assign_subjects
from tagloom.llm.term_frequency import array_term_counts, mark_by_frequency
from tagloom.operators.packed import unpacked
from tagloom.plans.lineage import cut


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    clean = _t(spark, d, "postings_clean").select("clean_id", "company", "skills")
    pairs, of = similar_classes(clean, "clean_id", "skills", 0.6, group=fold(F.col("company")))
    return expand(pairs, of).toDF("clean_id_a", "clean_id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with its class of equal sets and the number of postings it is similar to."""
    clean = _t(spark, d, "postings_clean").select("clean_id", "company", "skills")
    return class_links(*similar_classes(clean, "clean_id", "skills", 0.6, group=fold(F.col("company")))).withColumnRenamed("id", "clean_id")


def _split_side() -> Column:
    """0 for train, 1 for val and test, null for any other split."""
    split = fold(F.col("split"))
    return F.when(split == "train", 0).when(split.isin("val", "test"), 1)


def _p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    clean = _t(spark, d, "postings_clean").select("clean_id", "split", "skills")
    pairs, of = overlaps_between(clean, "clean_id", "skills", _split_side(), 0.8)
    return expand_between(pairs, of)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_pairs(spark, d).select(F.least("a", "b").alias("clean_id_a"), F.greatest("a", "b").alias("clean_id_b"))


def _p4_by_company(spark: SparkSession, d: str, *figures: Column) -> DataFrame:
    """Per split and company: evaluation rows joined with figures of their pairs."""
    clean = _t(spark, d, "postings_clean").select("clean_id", fold(F.col("split")).alias("split"), fold(F.col("company")).alias("company"))
    hits = _p4_pairs(spark, d).groupBy("b").agg(*figures)
    held = clean.where(F.col("split").isin("val", "test"))
    return held.join(hits, held["clean_id"] == hits["b"], "left").groupBy("split", "company")


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and company: evaluation rows, those that recur in train, their train rows, and the equal sets among these."""
    same = F.expr("overlap = size_a and overlap = size_b")
    by = _p4_by_company(spark, d, F.count("*").alias("pairs"), F.count_if(same).alias("exact"))
    return by.agg(F.count("*").alias("n_rows"), F.count("b").alias("n_leaked"), _sum("pairs").alias("n_pairs"), _sum("exact").alias("n_exact"))


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """Per split and company: maximal matches with train rows, and the longest of them."""
    by = _p4_by_company(spark, d, F.sum("spans").alias("spans"), F.max("longest").alias("longest"))
    return by.agg(_sum("spans").alias("n_spans"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest_span"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    """Distinct skills of the train rows with two or more."""
    s = F.array_distinct(F.filter("skills", lambda x: x.isNotNull()))
    clean = _t(spark, d, "postings_clean")
    return clean.where(fold(F.col("split")) == "train").select(s.alias("skills")).where(F.size("skills") >= 2)


def _p3_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    packed, unpack = unpacked(_t(spark, d, "postings"), "job_skills")
    # one row per term, written as both the terms and the total are read from it
    counts = cut(array_term_counts(packed, F.col("packed"), unpack, lambda x: " ".join(x.split()).lower(), with_total=True))
    return counts.where("term is not null"), counts.where("term is null").agg(F.sum("records").alias("total"))


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return mark_by_frequency(*_p3_counts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    useless = mark_by_frequency(*_p3_counts(spark, d)).where("mark is not null").select("term", "mark")
    held = array_term_counts(_train(spark, d), F.col("skills")).select(F.col("term").alias("name"), F.col("records").alias("n"))
    nodes = _t(spark, d, "graph_nodes").select("name", "doc_freq").where("name is not null")
    right = nodes.join(held, "name", "left").select("name", "doc_freq", F.coalesce("n", F.lit(0)).alias("n"))
    wrong = right.where("doc_freq is null or doc_freq != n").select(F.col("name").alias("term"), F.lit("wrong").alias("mark")).distinct()
    return useless.unionByName(wrong)


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence(_train(spark, d), F.col("skills"))
    return pairs.select("source", "target", "n_ab", "n_a", "n_b", "n", F.round("pmi", 6).alias("pmi"), F.round("llr", 4).alias("llr"), "significant")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Strong pairs, all of which are significant at this bound, and stale edges; the stripes are made once."""
    pairs = cooccurrence(_train(spark, d), F.col("skills")).select("source", "target", "n_ab", "n_a", "n_b", "n", "pmi", "significant")
    edges = _t(spark, d, "graph_edges").where("source is not null and target is not null")
    edges = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.col("count").alias("c"), F.nanvl("pmi", F.lit(None)).alias("p"))
    published = edges.select("source", "target", F.lit(True).alias("published")).distinct()
    strong = F.col("significant") & F.expr("n_ab >= 5 and n_ab * n >= 4 * n_a * n_b")
    # what either mark needs: the strong pairs and those with an edge
    now = cut(pairs.join(published, ["source", "target"], "left").withColumn("strong", strong).where("strong or published"))
    seen = edges.join(now.select("source", "target", "n_ab", "pmi"), ["source", "target"], "left").withColumn("n_ab", F.coalesce("n_ab", F.lit(0)))
    off = F.col("c").isNull() | (F.col("c") != F.col("n_ab"))
    off |= F.when(F.col("n_ab") > 0, F.col("p").isNull() | (F.abs(F.col("p") - F.col("pmi")) > 0.001)).otherwise(F.col("p").isNotNull())
    stale = seen.where(off).select("source", "target", F.lit("stale").alias("mark")).distinct()
    return now.where("strong").select("source", "target", F.lit("strong").alias("mark")).unionByName(stale)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed, unpack = unpacked(_t(spark, d, "postings"), "job_skills")
    skills = array_term_counts(packed, F.col("packed"), unpack).select("term")
    decided = _t(spark, d, "final_mapping").select("raw", "canonical")
    gone = _t(spark, d, "graph_nodes").select("name").unionByName(decided.select(F.col("canonical").alias("name")))
    return to_canonical(skills, "term", _t(spark, d, "final_vocab").select("canonical"), decided, gone)


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no entry, to be reported."""
    return p7_found(spark, d).where("canonical = ''").select("raw")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_t(spark, d, "documents"), "doc_id", "text", public_counter())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaked(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_items"), "item_id", "text")
    return hits.select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that carry a passage of it, and windows found in all."""
    hits = leaked(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_items"), "item_id", "text")
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("windows").alias("windows"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry a whole item, but for a word or two: windows of the item's size, shingles of five words, 0.8."""
    hits = leaked(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "eval_items"), "item_id", "text", window=None, radius=8, similarity=0.8, exact=False, shingle=5)
    return hits.select("doc_id", "item_id", "windows", F.round("similarity", 6).alias("similarity"))


def _p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    names = sorted(r[0] for r in _t(spark, d, "subjects").select("subject").where("subject is not null").distinct().take(MOST_SUBJECTS + 1))
    return assign_subjects(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "subject_labels"), "doc_id", "subject", "rater", names)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _p10_subjects(spark, d).select("doc_id", "subject").distinct()


def p10_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Composition of the corpus: documents and summed posteriors per subject."""
    return _p10_subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("posterior").alias("weight"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_spans": p4_spans,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_unmatched": p7_unmatched,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_near": p9_near,
    "p10_found": p10_found,
    "p10_corpus": p10_corpus,
}

_FOLD = r"nullif(trim(regexp_replace(lower({}), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x{{001C}}-\x{{001F}}]+', ' ', 'g')), '')"

_SETS = f"""sets AS (SELECT clean_id AS id, coalesce({_FOLD.format('company')}, '') AS g, {_FOLD.format('split')} AS sp,
  list_distinct(list_filter(skills, lambda x: x IS NOT NULL)) AS s FROM postings_clean),
  k AS (SELECT id, g, sp, len(s) AS n, unnest(s) AS tok FROM sets WHERE len(s) >= 2)"""

_PAIRS_1 = """pr AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.g = b.g AND a.tok = b.tok AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 8 >= 3 * (a.n + b.n))"""
_PAIRS_4 = """pr AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM k a JOIN k b ON a.tok = b.tok
  WHERE a.sp = 'train' AND b.sp IN ('val', 'test') GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 9 >= 4 * (a.n + b.n))"""
_PAIRS_6 = """t AS (SELECT id, tok FROM k WHERE sp = 'train'), tot AS (SELECT count(DISTINCT id) AS n FROM t),
one AS (SELECT tok, count(*) AS n FROM t GROUP BY tok),
p AS (SELECT a.tok AS source, b.tok AS target, count(*) AS n_ab FROM t a JOIN t b ON a.id = b.id AND a.tok < b.tok GROUP BY 1, 2),
q AS (SELECT source, target, n_ab, x.n AS n_a, y.n AS n_b, tot.n AS n, ln(n_ab::DOUBLE * tot.n / (x.n::DOUBLE * y.n)) AS pmi
  FROM p JOIN one x ON x.tok = source JOIN one y ON y.tok = target CROSS JOIN tot)"""


def _cell(k: str, row: str, col: str) -> str:
    return f"CASE WHEN {k} > 0 THEN ({k}) * ln(({k})::DOUBLE * n / (({row})::DOUBLE * ({col}))) ELSE 0 END"


_LLR = "greatest(2 * (" + " + ".join([
    _cell("n_ab", "n_a", "n_b"), _cell("n_a - n_ab", "n_a", "n - n_b"), _cell("n_b - n_ab", "n - n_a", "n_b"), _cell("n - n_a - n_b + n_ab", "n - n_a", "n - n_b"),
]) + "), 0)"

ORACLE = {
    "p1_found": f"WITH {_SETS}, {_PAIRS_1} SELECT a AS clean_id_a, b AS clean_id_b FROM pr",
    "p1_classes": f"""WITH {_SETS}, {_PAIRS_1}, c AS (SELECT id, min(id) OVER w AS rep, count(*) OVER w AS copies FROM sets WHERE len(s) >= 2 WINDOW w AS (PARTITION BY g, list_sort(s)))
SELECT id AS clean_id, rep, copies, (SELECT count(*) FROM pr WHERE a = id OR b = id) AS links FROM c""",
    "p4_found": f"WITH {_SETS}, {_PAIRS_4} SELECT least(a, b) AS clean_id_a, greatest(a, b) AS clean_id_b FROM pr",
    "p4_report": f"""WITH {_SETS}, {_PAIRS_4}, h AS (SELECT b, count(*) AS pairs, count_if(o = na AND o = nb) AS exact FROM pr GROUP BY b)
SELECT sp AS split, nullif(g, '') AS company, count(*) AS n_rows, count(b) AS n_leaked, coalesce(sum(pairs), 0)::BIGINT AS n_pairs, coalesce(sum(exact), 0)::BIGINT AS n_exact
FROM sets LEFT JOIN h ON b = id WHERE sp IN ('val', 'test') GROUP BY 1, 2""",
    "p6_pairs": f"""WITH {_SETS}, {_PAIRS_6}, l AS (SELECT *, {_LLR} AS llr FROM q)
SELECT source, target, n_ab, n_a, n_b, n, round(pmi, 6) AS pmi, round(llr, 4) AS llr, llr >= 3.841 AND n_ab::DOUBLE * n > n_a::DOUBLE * n_b AS significant FROM l""",
    "p6_found": f"""WITH {_SETS}, {_PAIRS_6},
e AS (SELECT least(source, target) AS source, greatest(source, target) AS target, "count" AS c, CASE WHEN isnan(pmi) THEN NULL ELSE pmi END AS p FROM graph_edges)
SELECT source, target, 'strong' AS mark FROM q WHERE n_ab >= 5 AND n_ab * n >= 4 * n_a * n_b
UNION ALL
SELECT DISTINCT source, target, 'stale' FROM (SELECT e.source, e.target, e.c, e.p, q.pmi, coalesce(q.n_ab, 0) AS m FROM e LEFT JOIN q USING (source, target))
WHERE c IS NULL OR c <> m OR (m > 0 AND (p IS NULL OR abs(p - pmi) > 0.001)) OR (m = 0 AND p IS NOT NULL)""",
    "p9_found": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dw AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x:x + 11], ' '))) AS p FROM d WHERE len(w) >= 12),
iw AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x:x + 11], ' '))) AS p FROM i WHERE len(w) >= 12)
SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (p) WHERE dw.id IS NOT NULL AND iw.id IS NOT NULL""",
}
