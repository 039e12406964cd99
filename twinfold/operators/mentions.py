"""Publication records to mentions: authors, title terms, year windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.text import normal_title, publication_year, words, year_windows
from twinfold.functions.udfs import finish_authors, split_authors

AUTHORS, TERMS = 4, 6


def swap_by_frequency(authors: DataFrame, surnames: DataFrame, firsts: DataFrame) -> DataFrame:
    """Surname and first name change places where each is more frequent as the other.

    ``authors`` has a struct ``a``; ``surnames`` and ``firsts`` have name and
    freq, each name once. A name that a table lacks has frequency 0 there. Both
    names need more than two letters.
    """
    out = authors.withColumns({"s_": F.col("a.surname"), "f_": F.col("a.first")})
    for column, table, name in (("s_", surnames, "ss_"), ("s_", firsts, "sf_"), ("f_", surnames, "fs_"), ("f_", firsts, "ff_")):
        known = table.select(F.col("name").alias("n_"), F.col("freq").alias(name))
        out = out.join(known, F.col(column) == F.col("n_"), "left").drop("n_").fillna(0, [name])
    swap = (F.length("s_") > 2) & (F.length("f_") > 2) & (F.col("ss_") < F.col("sf_")) & (F.col("ff_") < F.col("fs_"))
    other = F.struct(F.col("f_").alias("surname"), F.substring("s_", 1, 1).alias("init"), F.col("s_").alias("first"))
    return out.withColumn("a", F.when(swap, other).otherwise(F.col("a"))).drop("s_", "f_", "ss_", "sf_", "fs_", "ff_")


def parsed_authors(records: DataFrame, surnames: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """coreId and its first ``AUTHORS`` parsed authors in order; a record without any is not listed."""
    long = records.select("coreId", F.posexplode(F.slice("authors", 1, AUTHORS)).alias("at", "name")).select("coreId", "at", split_authors("name").alias("a"))
    if surnames is not None and firsts is not None:
        long = swap_by_frequency(long, surnames, firsts)
    done = long.select("coreId", "at", finish_authors("a").alias("a"))
    return done.groupBy("coreId").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("parsed"))


def name_frequencies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each name is written as a surname and as a first name."""
    long = records.select(F.explode("authors").alias("name")).select(split_authors("name").alias("a"))
    count = lambda c: long.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("freq"))
    return count("a.surname"), count("a.first")


def publication_mentions(records: DataFrame, surnames: DataFrame | None = None, firsts: DataFrame | None = None, terms: Column | None = None) -> DataFrame:
    """The 31 columns of a mention for each record: ids, frequency, title, two year windows, four authors of three features, six terms and their generalisations.

    ``records`` has coreId (unique), doi, title, datePublished and authors.
    ``terms`` is an array of the title's features, by default its words. Author
    features beyond the surname need the first author's surname. What is empty is null.
    """
    title = normal_title(F.col("title"))
    found = words(F.col("title")) if terms is None else terms
    rows = records.join(parsed_authors(records, surnames, firsts), "coreId", "left").withColumn("terms_", F.coalesce(found, F.array().cast("array<string>")))
    one, two = year_windows(publication_year(F.col("datePublished")))
    columns = [F.col("coreId").alias("mention_id"), F.col("coreId").alias("original_id"), F.col("doi").alias("gold_id"), F.lit(1.0).alias("freq"), title.alias("title"), one.alias("year1"), two.alias("year2")]
    lead = F.get("parsed", F.lit(0))["surname"]
    for k in range(AUTHORS):
        own = F.get("parsed", F.lit(k))
        sur = own["surname"]
        joint = lambda x, sur=sur: F.when(lead.isNotNull() & sur.isNotNull() & x.isNotNull(), F.concat_ws("_", sur, x))
        columns += [sur.alias(f"a{k + 1}sur"), joint(own["init"]).alias(f"a{k + 1}init"), joint(own["first"]).alias(f"a{k + 1}first")]
    columns += [F.get("terms_", F.lit(k)).alias(f"term{k + 1}") for k in range(TERMS)]
    columns += [F.lit(None).cast("string").alias(f"term{k + 1}gen") for k in range(TERMS)]
    out = rows.select(*columns)
    return out.select(*(F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes))


def mention_groups() -> dict[str, list[str]]:
    """Columns of each feature group, for representations."""
    parts = [f"a{k}{p}" for k in range(1, AUTHORS + 1) for p in ("sur", "init", "first")]
    return {"author": parts, "term": [f"term{k}" for k in range(1, TERMS + 1)], "year": ["year1", "year2"]}
