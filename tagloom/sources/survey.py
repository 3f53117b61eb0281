"""Survey files: one JSON document per year, in a current and in a legacy layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.names import aliases, canon_key, is_no_answer, vocabulary_key

MODERN = "map<string, struct<datasets: map<string, struct<total_respondents: bigint, data: array<struct<response: string, frequency: bigint, percent: double, percent1: double>>>>>>"
LEGACY = "struct<SubSections: array<struct<Title: string, GraphCollections: array<struct<Graphs: array<struct<Title: string, Data: map<string, string>>>>>>>>"

# The blocks that list technologies, with their category; two more count
# for the vocabulary only, and blocks of what is desired begin alike.
BLOCKS = {
    "Language": "Language",
    "Database": "Database",
    "Platform": "Platform",
    "Webframe": "WebFramework",
    "Embedded": "Embedded",
    "MiscTech": "Library/Framework",
    "ToolsTech": "Tool",
    "NEWCollabTools": "IDE",
    "DevEnvs": "IDE",
    "OpSys": "OS",
    "VersionControlSystem": "Tool",
    "AISearchDev": "AITool",
    "AIDev": "AITool",
    "AISearch": "AITool",
    "AIModels": "AIModel",
    "OfficeStackAsync": "Collaboration",
    "OfficeStackSync": "Collaboration",
}
VOCABULARY_ONLY = {
    "CommPlatform": "Collaboration",
    "SOTags": "Topic",
}
DESIRE = "DA_"


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The years whose file exists, on whatever file system it lies."""

    def there(name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return {y: p for y, p in paths.items() if there(p)}


def read_years(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``year, doc`` of the files that exist; no file gives an empty table."""
    out = spark.createDataFrame([], "year string, doc string")
    for year, path in existing(spark, paths).items():
        out = out.unionByName(spark.read.text(path, wholetext=True).select(F.lit(year).alias("year"), F.col("value").alias("doc")))
    return out


def modern_rows(docs: DataFrame, doc: Column) -> DataFrame:
    """``year, block, dataset, pos, total_respondents, response, frequency, percent, percent1``.

    Each level is exploded by Catalyst; rows of another shape become null and are left out.
    """
    a = docs.select("year", F.explode(F.from_json(doc, MODERN)).alias("block", "b"))
    b = a.select("year", "block", F.explode("b.datasets").alias("dataset", "d"))
    c = b.select("year", "block", "dataset", "d.total_respondents", F.posexplode("d.data").alias("pos", "r"))
    name = F.trim("r.response")
    return c.where(name != "").select("year", "block", "dataset", "pos", "total_respondents", name.alias("response"), "r.frequency", "r.percent", "r.percent1")


def technology_rows(rows: DataFrame, blocks: dict[str, str] | None = None) -> DataFrame:
    """Rows of the blocks that list technologies (of trends unless given), with their category."""
    blocks = BLOCKS if blocks is None else blocks
    known = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    return rows.where((F.col("block") == F.col("dataset")) & F.col("block").isin(*blocks)).withColumn("category", F.element_at(known, F.col("block")))


def respondents(rows: DataFrame) -> DataFrame:
    """``year, respondents``: the most respondents that a technology block of the year had."""
    return technology_rows(rows).groupBy("year").agg(F.coalesce(F.max("total_respondents"), F.lit(0)).alias("respondents"))


def desire_rows(rows: DataFrame) -> DataFrame:
    """``tech, year, share``: what is wanted, from the desire blocks of any dataset; of several rows the largest share."""
    wanted = rows.where(F.col("block").startswith(DESIRE) & F.col("percent1").isNotNull())
    return wanted.groupBy(canon_key(F.col("response")).alias("tech"), "year").agg(F.max("percent1").alias("share")).where("tech != ''")


def adoption_rows(rows: DataFrame) -> DataFrame:
    """``tech, year, share, name, category``: the largest share of a year over the blocks; name and category first seen."""
    x = technology_rows(rows).where("percent is not null").withColumn("tech", canon_key(F.col("response"))).where("tech != ''")
    first = F.struct("year", F.array_position(F.array(*map(F.lit, BLOCKS)), F.col("block")).alias("b"), "pos")
    seen = x.groupBy("tech").agg(F.min_by("response", first).alias("name"), F.min_by("category", first).alias("category"))
    return x.groupBy("tech", "year").agg(F.max("percent").alias("share")).join(seen, "tech")


def vocabulary(rows: DataFrame) -> DataFrame:
    """``canonical, key, aliases, category, years, max_frequency`` of a survey archive.

    Variants of one key, renames between years included, become one entry; its name is
    the variant of the latest year, then the most frequent, the longest, the last by
    name.  Several categories are joined by a slash.  Answers that are no technology are
    left out.
    """
    x = technology_rows(rows, {**BLOCKS, **VOCABULARY_ONLY}).where(~is_no_answer(F.col("response")))
    x = x.withColumn("key", vocabulary_key(F.col("response"))).where("key != ''").withColumn("f", F.coalesce("frequency", F.lit(0)))
    best = F.max_by("response", F.struct("year", "f", F.length("response").alias("n"), "response"))
    v = x.groupBy("key").agg(best.alias("canonical"), F.collect_set("response").alias("variants"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("year")).alias("years"), F.max("f").alias("max_frequency"))
    every = F.array_sort(F.array_union("variants", aliases(F.col("canonical"), F.col("key"))))
    return v.select("canonical", "key", every.alias("aliases"), flat_category(F.col("categories")).alias("category"), "years", "max_frequency")


def flat_category(categories: Column) -> Column:
    """Several categories as one string."""
    return F.array_join(categories, "/")


def legacy_rows(docs: DataFrame, doc: Column) -> DataFrame:
    """``year, response, percent`` of the legacy layout, percentages as shares; what is no number is left out."""
    a = docs.select("year", F.explode(F.from_json(doc, LEGACY)["SubSections"]).alias("s"))
    a = a.where(F.col("s.Title").contains("Popular") | F.col("s.Title").contains("Environments"))
    b = a.select("year", F.explode("s.GraphCollections").alias("c")).select("year", F.explode("c.Graphs").alias("g"))
    c = b.where(F.col("g.Title") == "All Respondents").select("year", F.explode("g.Data").alias("response", "v"))
    return c.select("year", "response", (F.col("v").try_cast("double") / 100).alias("percent")).where("percent is not null")
