"""Make under-specified rows unique, so that they link nothing, and related filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.functions.udfs import osa_distance


def violated(columns: list[str]) -> Column:
    """A restriction, a list of columns, is violated if all are null."""
    return reduce(lambda a, b: a & b, (F.col(c).isNull() for c in columns))


def specify(df: DataFrame, restrictions: list[list[str]], token: Column) -> DataFrame:
    """For the first violated restriction, judged on the row as it comes, its first column gets the row's token."""
    first = F.coalesce(*(F.when(violated(r), F.lit(i)) for i, r in enumerate(restrictions)))
    changed: dict[str, Column] = {}
    for i, r in enumerate(restrictions):
        changed[r[0]] = F.when(first == i, token).otherwise(changed.get(r[0], F.col(r[0])))
    return df.withColumns(changed)


def specify_by_frequency(reps: DataFrame) -> DataFrame:
    """Representations of one or two features: ``score``, their frequency divided by the number
    of representations that have all of these, and ``unique``, whether it is under 1.

    Both features' postings meet by the first, the rarer one, so that common features don't multiply.
    """
    postings = reps.select("rep_id", F.explode("features").alias("feature"))
    counts = postings.groupBy("feature").agg(F.count("*").alias("c"))
    small = reps.where("n between 1 and 2").select("rep_id", "features", "freq", "n")
    ranked = small.select("rep_id", F.explode("features").alias("feature")).join(counts, "feature").groupBy("rep_id").agg(F.min(F.struct("c", "feature")).alias("rare"))
    keyed = small.join(ranked, "rep_id").select("rep_id", "features", "freq", "n", F.col("rare.feature").alias("key"), F.col("rare.c").alias("c"))
    pairs = keyed.where("n = 2").withColumn("other", F.element_at(F.array_except("features", F.array("key")), 1))
    # all pairs of features that some small representation asks for, counted once each
    wanted = pairs.select("key", "other").distinct()
    has_key = postings.join(wanted.select(F.col("key").alias("feature")).distinct(), "feature", "left_semi").select("rep_id", F.col("feature").alias("key"))
    has_other = postings.join(wanted.select(F.col("other").alias("feature")).distinct(), "feature", "left_semi").select("rep_id", F.col("feature").alias("other"))
    both = has_key.join(has_other, "rep_id").join(wanted, ["key", "other"], "left_semi").groupBy("key", "other").agg(F.count("*").alias("both"))
    two = pairs.join(both, ["key", "other"]).select("rep_id", "freq", F.col("both").alias("matching"))
    one = keyed.where("n = 1").select("rep_id", "freq", F.col("c").alias("matching"))
    scored = one.union(two).withColumn("score", F.col("freq") / F.col("matching"))
    return scored.withColumn("unique", F.col("score") < 1)


def valid_author(df: DataFrame) -> DataFrame:
    """A last name is there, and no slot is filled whose predecessor's full name is missing."""
    return df.where("l is not null and not (l_ is null and f1 is not null) and not (f1_ is null and f2 is not null) and not (f2_ is null and f3 is not null)")


def satisfies(restrictions: list[list[str]]) -> Column:
    """Whether a row violates none of the restrictions."""
    return reduce(lambda a, b: a & b, (~violated(r) for r in restrictions))


def has_value(columns: list[str], value) -> Column:
    """Whether any of a group's columns has the value."""
    return F.coalesce(F.exists(F.array(*columns), lambda x: x == F.lit(value)), F.lit(False))


def licensed(features: Column, requires: list[tuple[str, str]], forbids: list[tuple[str, str]], per_group: int = 4) -> Column:
    """At least two features, constraints between groups kept, no group with more than ``per_group``."""
    groups = F.transform(features, lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
    ok = F.size(features) >= 2
    for a, b in requires:
        ok &= ~F.array_contains(groups, a) | F.array_contains(groups, b)
    for a, b in forbids:
        ok &= ~(F.array_contains(groups, a) & F.array_contains(groups, b))
    return ok & F.forall(F.array_distinct(groups), lambda g: F.size(F.filter(groups, lambda x: x == g)) <= per_group)


def clean_gold(mentions: DataFrame, dois: DataFrame, types: DataFrame | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Gold ids become null unless they are legal and, with a whitelist, of an allowed type."""
    legal = dois.where("legal = 1").select(F.col("doi").alias("ok_")).distinct()
    if types is not None and allowed is not None:
        legal = legal.join(types.where(F.col("type").isin(allowed)), legal.ok_ == types.doi, "left_semi")
    joined = mentions.join(legal, mentions.gold_id == legal.ok_, "left")
    return joined.withColumn("gold_id", F.when(F.col("ok_").isNotNull(), F.col("gold_id"))).drop("ok_")


def verify_groups(members: DataFrame, least: float = 0.9, years: int = 1, most: int = 5) -> DataFrame:
    """Gold groups of 2 to ``most`` members whose titles are close in all pairs, years too, and sources all differ.

    ``members`` has gold_id, source, year, title. Lower-cased titles are close by edit distance with swaps, over the longer
    length, or by their common beginning, over the shorter. Unknown years don't speak against a group; a null title is unlike all others.
    """
    sized = members.withColumn("k_", F.count("*").over(Window.partitionBy("gold_id"))).where(F.col("k_").between(2, most))
    sized = sized.withColumn("i_", F.row_number().over(Window.partitionBy("gold_id").orderBy("title", "source", "year")))
    a, b = sized.alias("a"), sized.alias("b")
    pairs = a.join(b, (F.col("a.gold_id") == F.col("b.gold_id")) & (F.col("a.i_") < F.col("b.i_")))
    x, y = F.lower("a.title"), F.lower("b.title")
    shorter = F.least(F.length(x), F.length(y))
    edit = 1 - osa_distance(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))
    prefix = F.when(shorter > 0, common / shorter).otherwise(0.0)
    checks = pairs.groupBy(F.col("a.gold_id").alias("gold_id")).agg(
        F.min(F.coalesce(F.greatest(edit, prefix), F.lit(0.0))).alias("similarity"), F.max(F.abs(F.col("a.year") - F.col("b.year"))).alias("year_gap"), F.bool_or(F.col("a.source") == F.col("b.source")).alias("same_source")
    )
    return checks.withColumn("verified", (F.col("similarity") >= least) & F.coalesce(F.col("year_gap") <= years, F.lit(True)) & ~F.coalesce("same_source", F.lit(False)))
