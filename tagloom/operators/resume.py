"""Skills in documents: lines, sections, candidate spans, best evidence.

Everything is a column expression or an ordinary join; a document is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.names import normalize, slash_parts

# Section headers in the order they are tried, weights of sections, the
# factor of lines marked as elementary, words too general to be credited outside some
# sections, spellings of resumes, and words no span begins or ends with.
SECTIONS = (
    ("experience", r"experience|employment|work history|internship|professional"),
    ("projects", r"projects?|portfolio|personal work"),
    ("skills", r"skills?|expertise|technical|technolog|competenc|proficien"),
    ("education", r"education|academic|qualification"),
    ("coursework", r"coursework|courses|curriculum|subjects"),
    ("achievements", r"achievement|award|honou?r|certification|competition|conference"),
)
WEIGHTS = {"experience": 1.00, "projects": 1.00, "skills": 0.85, "achievements": 0.75, "coursework": 0.60, "education": 0.60, "other": 0.70}
ELEMENTARY = 0.75
GENERIC = (
    "engineering", "computing", "architecture", "analytics", "graphics", "programming", "linear", "audio", "monitoring",
    "simulation", "design", "development", "software", "systems", "system", "data", "web", "accessibility", "performance",
    "documentation", "research", "analysis", "mathematics", "stack overflow", "programming languages", "web technologies",
    "backend services", "databases",
)
GENERIC_SECTIONS = ("skills", "coursework")
INFERRED_WEIGHT = 0.56
SPELLINGS = {
    "express.js": "Express",
    "expressjs": "Express",
    "unity": "Unity 3D",
    "jupyter notebook": "Jupyter Nb/JupyterLab",
    "jupyter": "Jupyter Nb/JupyterLab",
    "google colab": "Jupyter Nb/JupyterLab",
    "node": "Node.js",
    "nodejs": "Node.js",
    "postgres": "PostgreSQL",
    "js": "JavaScript",
    "ts": "TypeScript",
    "k8s": "Kubernetes",
    "sklearn": "Scikit-Learn",
    "tf": "TensorFlow",
    "cv2": "Opencv",
    "vs code": "Visual Studio Code",
    "vscode": "Visual Studio Code",
}
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "using", "via", "by", "at", "as", "is", "was",
    "were", "be", "been", "from", "into", "over", "under", "this", "that", "these", "those", "it", "its", "prof", "dr",
    "project", "built", "designed", "developed", "implemented", "achieved", "performed", "conducted", "created", "used",
    "study", "based", "real", "time", "custom", "advanced", "multi", "core",
)


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, line_no, line``: trimmed lines with content; null texts give none."""
    x = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "line"))
    return x.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line != ''")


def looks_like_header(line: Column) -> Column:
    """Short, without the punctuation of a sentence, and mostly upper or title case."""
    letters, upper = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    long_ = line.rlike(r"[.,;:]$") & (F.size(F.split(line, r"\s+")) > 4)
    title = (upper > 0) & ~line.rlike(r"(^|[^\p{L}])\p{Ll}") & ~line.rlike(r"\p{L}\p{Lu}")
    n = F.length(line)
    return (n > 2) & (n < 60) & ~long_ & (letters > 0) & ((upper > 0.6 * letters) | title)


def header_section(line: Column) -> Column:
    """Section that a header line opens; null for other lines and unknown headers."""
    low, out = F.lower(line), None
    for name, pattern in SECTIONS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.when(looks_like_header(line), out)


def segment(ls: DataFrame) -> DataFrame:
    """``doc_id, line_no, section, line``: content lines under the last known header, else 'other'."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    # a stated number: small bytes here mean much work in the spans that follow, so these
    # partitions must not be merged by their size
    n = int(ls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = ls.repartition(n, "doc_id").withColumn("h", header_section(F.col("line"))).withColumn("section", F.coalesce(F.last("h", ignorenulls=True).over(w), F.lit("other")))
    return s.where("h is null").select("doc_id", "line_no", "section", "line")


def candidate_spans(line: Column) -> Column:
    """Pieces between delimiters, then runs of one to four words that don't begin or end with a stop word."""
    body = F.regexp_replace(line, r"^[•\-*●▪]\s*", "")
    pieces = F.transform(F.split(body, r"[,;|]|\s{2,}"), lambda x: F.regexp_replace(x, r"^[ .:]+|[ .:]+$", ""))
    words = F.regexp_extract_all(body, F.lit(r"[A-Za-z0-9+#.\-]+"), F.lit(0))
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), F.lower(w).isin(*STOPWORDS).alias("stop")))

    def runs(m: Column) -> Column:
        """Runs of every length from the words and their stop marks, which are made once per line."""

        def of(n: int) -> Column:
            starts = F.when(F.size(m) >= n, F.sequence(F.lit(1), F.size(m) - (n - 1))).otherwise(F.array().cast("array<int>"))
            kept = F.filter(starts, lambda i: ~F.get(m, i - 1)["stop"] & ~F.get(m, i + (n - 2))["stop"])
            return F.transform(kept, lambda i: F.array_join(F.transform(F.slice(m, i, n), lambda x: x["w"]), " "))

        return F.concat(*[of(n) for n in (1, 2, 3, 4)])

    # the one-element array binds the marked words to a variable, else each run would cut the line anew
    all_ = F.concat(pieces, F.flatten(F.transform(F.array(marked), runs)))
    return F.filter(all_, lambda x: (F.length(x) > 1) & (F.length(x) < 40))


def resolve_index(names: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """``key, name``: resumes' spellings, then names, parts of compounds and raw mappings; the first wins.

    ``names``: column ``name``; ``mapping``: ``raw, canonical``.  Ties go to the smaller name.
    """
    spark = names.sparkSession
    parts = [spark.createDataFrame(list(SPELLINGS.items()), "key string, name string").select(normalize(F.col("key")).alias("key"), "name", F.lit(0).alias("prio"))]
    parts.append(names.select(normalize(F.col("name")).alias("key"), "name", F.lit(1).alias("prio")))
    parts.append(names.select(F.explode(slash_parts(F.col("name"))).alias("p"), "name").select(normalize(F.col("p")).alias("key"), "name", F.lit(2).alias("prio")))
    if mapping is not None:
        parts.append(mapping.where("canonical is not null").select(normalize(F.col("raw")).alias("key"), F.col("canonical").alias("name"), F.lit(3).alias("prio")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("key != ''").groupBy("key").agg(F.min(F.struct("prio", "name")).alias("x")).select("key", F.col("x.name").alias("name"))


def evidence(segmented: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, line_no, pos, section, span, elementary, weight, name``; name null where nothing matches.

    Words too general are credited only in sections that list skills.
    """
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    # outer: the filter that Catalyst infers for a plain explode would make the spans twice more
    e = segmented.select("doc_id", "line_no", "section", F.col("line").contains("*").alias("elementary"), F.posexplode_outer(candidate_spans(F.col("line"))).alias("pos", "span")).where("span is not null")
    e = e.withColumn("key", normalize(F.col("span"))).join(index, "key", "left")
    general = F.lower("name").isin(*GENERIC) & ~F.col("section").isin(*GENERIC_SECTIONS)
    weight = F.round(F.element_at(w, F.col("section")) * F.when(F.col("elementary"), ELEMENTARY).otherwise(1.0), 3)
    return e.where(~F.coalesce(general, F.lit(False))).select("doc_id", "line_no", "pos", "section", "span", "elementary", weight.alias("weight"), "name")


def best_evidence(e: DataFrame) -> DataFrame:
    """The strongest span of each name in a document; the first of equal ones."""
    best = F.min_by(F.struct("section", "span", "elementary", "weight"), F.struct(-F.col("weight"), F.col("line_no"), F.col("pos")))
    return e.where("name is not null").groupBy("doc_id", "name").agg(best.alias("b")).select("doc_id", "name", "b.section", "b.span", "b.elementary", "b.weight")


def unmatched(e: DataFrame) -> DataFrame:
    """``span, n``: short spans without a name, counted."""
    s = F.col("span")
    ok = (F.size(F.split(s, r"\s+")) <= 3) & s.rlike(r"\p{L}") & ~F.lower(s).isin(*STOPWORDS) & (F.length(s) > 2)
    return e.where(F.col("name").isNull() & ok).groupBy("span").agg(F.count("*").alias("n"))


def inferred(spans: DataFrame, names: DataFrame, embed, threshold: float) -> DataFrame:
    """``span, name, v``: the nearest name of each unmatched span whose cosine reaches ``threshold``."""
    from tagloom.operators.matrix import nearest
    from tagloom.sources.models import embed_names

    q = embed_names(spans.select("span"), "span", embed).withColumnRenamed("span", "id")
    return nearest(q, embed_names(names.select("name"), "name", embed), threshold).withColumnRenamed("id", "span")
