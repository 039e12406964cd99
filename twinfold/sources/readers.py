"""Input shapes: JSON lines, ground truth, probe text, tables, configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLICATION = "coreId string, doi string, title string, datePublished string, authors array<string>"
TRUTH = "core_id string, doi string, labelled_duplicates array<string>"


def publications(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON lines, one publication each; the schema is given, so nothing is read twice."""
    return spark.read.schema(PUBLICATION).json(path)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) pairs of labelled duplicates, each record with itself among them."""
    rows = spark.read.schema(TRUTH).json(path)
    return rows.select(F.col("core_id").alias("a"), F.explode(F.concat(F.array("core_id"), F.coalesce("labelled_duplicates", F.array().cast("array<string>")))).alias("b"))


def doi_status(spark: SparkSession, path: str) -> DataFrame:
    """doi, code, legal of probe lines ``doi protocol code``; a line with one token was missed, 202 and 302 are legal."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("doi"), F.get(parts, F.lit(2)).try_cast("int").alias("code"))
    return rows.select("doi", "code", F.coalesce(F.col("code").isin(202, 302), F.lit(False)).cast("int").alias("legal"))


def author_names(df: DataFrame) -> DataFrame:
    return df.select("mentionIDIndex", "rIDIndex", "l", "l_", "f1", "f1_", "f2", "f2_", "f3", "f3_")


def institutions(df: DataFrame) -> DataFrame:
    """All columns but the bookkeeping ones are features, whatever they are called."""
    return df.drop(*(c for c in df.columns if c.lower() in ("rowid", "mentionid", "id", "string")))


def combine(frames: list[DataFrame]) -> DataFrame:
    """Shards of one table."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def parse_types(text: str) -> dict[str, list[str]]:
    """``group:column column`` lines."""
    return {g.strip(): c.split() for g, _, c in (line.partition(":") for line in text.splitlines() if line.strip())}


def parse_restrictions(text: str) -> list[list[str]]:
    """A restriction to a line: columns of which one must be there."""
    return [line.split() for line in text.splitlines() if line.strip()]


def parse_hierarchy(text: str) -> dict[str, int]:
    return {name: int(level) for name, level in (line.split() for line in text.splitlines() if line.strip())}


def parse_constraints(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """``a > b``: a requires b; ``a - b``: a forbids b."""
    requires, forbids = [], []
    for line in text.splitlines():
        if line.strip():
            a, kind, b = line.split()
            (requires if kind == ">" else forbids).append((a, b))
    return requires, forbids


def parse_config(text: str) -> dict:
    return json.loads(text)


def duplicate_documents(components: DataFrame, minels: DataFrame) -> DataFrame:
    """One JSON document for each record: id, the cluster that its duplicates share, the cluster's size and the record's minimal elements.

    A cluster's members are the documents with its id: a list of them in each would grow with the square of a cluster.
    """
    sizes = components.groupBy("label").agg(F.count("*").alias("size"))
    own = minels.groupBy("rep_id").agg(F.array_sort(F.collect_set("minel")).alias("min_els"))
    return as_documents(components.join(sizes, "label").join(own, "rep_id", "left"))


def as_documents(rows: DataFrame) -> DataFrame:
    """The documents of rows with rep_id, label, size and min_els."""
    doc = F.struct(F.col("rep_id").alias("id"), F.col("label").alias("cluster"), "size", "min_els", F.lit("duplicates").alias("class"))
    return rows.select("rep_id", F.to_json(doc).alias("document"))
