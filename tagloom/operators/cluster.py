"""Merging names by embedding: components of a similarity graph, linkage, heads and log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.plans.lineage import cut

# Names that look alike and must never merge, in lower case.
NEVER_MERGE = (
    ("java", "javascript"), ("c", "c#"), ("c", "c++"), ("c#", "c++"), ("r", "ruby"), ("go", "golang", "django"),
    ("react", "react native"), ("angular", "angularjs"), ("mysql", "postgresql"), ("aws", "azure", "google cloud"),
    ("sas", "sass"), ("swift", "swiftui"), ("nix", "nixos"), ("ada", "adas"), ("jax", "jaxb"), ("nat", "nats"),
    ("couchbase", "couch db", "couchdb"), ("frontend frameworks", "backend frameworks"),
    ("frontend development", "backend development"), ("front-end development", "back-end development"),
    ("high-level design", "low-level design"), ("analytics", "google analytics"), ("cloud storage", "google cloud storage"),
    ("command line", "linux command line"), ("github", "git/github"), ("gitlab", "gitlab ci"), ("rollout", "rollup"),
    ("iec 61850", "iec 61131"), ("nist sp 800-53", "nist sp 800-171", "nist sp 800-37"), ("arp4754", "arp4754a", "arp4761"),
    ("ethernet", "ethernet/ip"), ("tcp", "tcp/ip"), ("tacacs", "tacacs+"),
    ("software-defined networking", "software-defined wide area networking"), ("ros", "ros 2"),
    ("schema design", "schematic design"), ("threat modeling", "threat analysis"),
    ("computer architecture", "hardware architecture"), ("unit testing", "integration testing", "system testing"),
    ("mvc", "asp.net mvc"), ("database administration", "database management system", "database management systems", "dbms"),
    ("application security", "security applications"),
)


def blocked_pairs(groups: DataFrame) -> DataFrame:
    """``a, b`` (both ways, lower case) from rows ``group, name``: names in one group that never merge."""
    g = groups.select("group", F.lower("name").alias("name")).distinct()
    return g.select("group", F.col("name").alias("a")).join(g.select("group", F.col("name").alias("b")), "group").where("a != b").select("a", "b").distinct()


def never_merge(spark) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, g in enumerate(NEVER_MERGE) for n in g], "group int, name string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id): labels spread over the edges and jump ahead until none changes."""
    both = cut(edges.select("i", "j").union(edges.select("j", "i")).distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.min("component").alias("m"))
        step = label.join(near, "id", "left").select("id", F.least("component", "m").alias("c"))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(step.join(jump, "c", "left").select("id", F.least("c", "cc").alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "id").where("component < old").isEmpty():
            return new
        label = new


def average_linkage(v: np.ndarray, limit: float) -> np.ndarray:
    """Clusters of unit vectors: the two with the least average cosine distance merge while it is below ``limit``."""
    n = len(v)
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    while n > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] < limit:
            break
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


def clusters(vectors: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """``id, cluster`` (smallest id) by average linkage below ``limit``; ``edges`` hold all pairs nearer than it.

    An average below the limit needs a pair below it, so clusters lie within components,
    and each component is linked by itself, exactly.
    """
    comp = components(vectors.select("id"), edges)
    kind = dict(vectors.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        at = average_linkage(m, limit)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": ids[at]})

    single = comp.groupBy("component").agg(F.count("*").alias("n"))
    j = comp.join(single, "component")
    alone = j.where("n = 1").select("id", F.col("id").alias("cluster"))
    linked = j.where("n > 1").join(vectors, "id").groupBy("component").applyInPandas(run, f"id {kind}, cluster {kind}")
    return alone.unionByName(linked)


def heads(members: DataFrame, blocked: DataFrame) -> DataFrame:
    """``cluster, name, head`` from ``cluster, name, in_survey, mentions``.

    Names blocked by another member stay their own head; of the others the head is the one
    of the survey, then the most mentioned, the shortest, and the first by name.
    """
    low = members.withColumn("low", F.lower("name"))
    other = low.select("cluster", F.col("low").alias("b")).distinct()
    bad = low.join(blocked.withColumnRenamed("a", "low"), "low").join(other, ["cluster", "b"], "left_semi").select("cluster", "name").distinct()
    free = members.join(bad, ["cluster", "name"], "left_anti")
    w = Window.partitionBy("cluster").orderBy(F.desc("in_survey"), F.desc("mentions"), F.length("name"), "name")
    head = free.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cluster", F.col("name").alias("head"))
    return free.join(head, "cluster").select("cluster", "name", "head").unionByName(bad.select("cluster", "name", F.col("name").alias("head")))


def merge_log(h: DataFrame, mentions: DataFrame) -> DataFrame:
    """One text per head that absorbed others: its mentions and name, then theirs."""
    m = h.join(mentions, "name")
    top = m.where("name = head").select("head", F.col("mentions").alias("hm"))
    rest = m.where("name != head").groupBy("head").agg(F.array_join(F.array_sort(F.collect_list(F.printf(F.lit("<- %s (%d)"), "name", "mentions"))), "; ").alias("absorbed"))
    return top.join(rest, "head").select(F.printf(F.lit("%d %s "), "hm", "head").alias("a"), "absorbed").select(F.concat("a", "absorbed").alias("entry"))
