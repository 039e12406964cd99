"""Mentions to representations: sets of ``group:value`` features known by a content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = chr(31)


def bundle(*columns) -> Column:
    """The distinct, non-null values of a group's columns, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*columns))))


def features(groups: dict[str, list[Column]]) -> Column:
    """Sorted distinct ``group:value`` strings over all groups; null cells are no features."""
    cells = [F.when(c.isNotNull(), F.concat(F.lit(f"{g}:"), c.cast("string"))) for g, columns in groups.items() for c in columns]
    return bundle(*cells)


def text(groups: dict[str, Column]) -> Column:
    """Sorted ``group:value`` strings joined by UNIT, where every group has one column: what ``rep_id`` is the hash of."""
    ordered = sorted(groups, key=lambda g: f"{g}:".encode())
    return F.concat_ws(UNIT, *(F.concat(F.lit(f"{g}:"), groups[g].cast("string")) for g in ordered))


def rep_id(features: Column | str) -> Column:
    return F.sha1(F.array_join(features, UNIT).cast("binary"))


def with_reps(mentions: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mentions with ``features`` and ``rep_id``: the mention to representation map."""
    made = mentions.withColumn("features", features({g: [F.col(c) for c in columns] for g, columns in groups.items()}))
    return made.withColumn("rep_id", rep_id("features"))


def represent(mapped: DataFrame, freq: str = "freq") -> DataFrame:
    """One row for each representation; frequencies of equal sets add up (map-side first)."""
    summed = mapped.groupBy("rep_id", "features").agg(F.sum(freq).alias("freq"))
    return summed.withColumn("n", F.size("features"))


def unpivot(reps: DataFrame) -> DataFrame:
    """Wide to long: rep_id, feature, grp, val."""
    long = reps.select("rep_id", F.explode("features").alias("feature"))
    return long.withColumns({"grp": F.split_part("feature", F.lit(":"), F.lit(1)), "val": F.expr("substring(feature, instr(feature, ':') + 1)")})


def feature_index(reps: DataFrame) -> DataFrame:
    """Each feature of each group once, with the number of representations that have it."""
    return unpivot(reps).groupBy("grp", "val").agg(F.count("*").alias("n_reps"))


def size_histogram(reps: DataFrame) -> DataFrame:
    """Two-level count: representations by set size, empty ones left out."""
    return reps.where("n > 0").groupBy("n").agg(F.count("*").alias("reps"))


def missing_features_filter(reps: DataFrame) -> DataFrame:
    """Only representations with at least one feature are indexed."""
    return reps.where(F.size("features") > 0)
