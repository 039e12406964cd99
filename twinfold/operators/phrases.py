"""Term, name and phrase statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.functions.text import windows
from twinfold.functions.udfs import osa_distance
from twinfold.operators.components import connected_components
from twinfold.plans.storage import save


def frequencies(df: DataFrame, items: Column, name: str = "term") -> DataFrame:
    """How often each item of an array column occurs."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("freq"))


def ngram_counts(df: DataFrame, words: str, sizes: tuple[int, ...] = (1, 2), by: tuple[str, ...] = (), reverse: bool = False) -> DataFrame:
    """n-grams of a word array with their counts, by language or other columns."""
    source = F.reverse(words) if reverse else F.col(words)
    out = None
    for n in sizes:
        one = df.select(*by, F.explode(windows(source, n)).alias("gram")).select(*by, F.lit(n).alias("n"), F.array_join("gram", " ").alias("gram"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by, "n", "gram").agg(F.count("*").alias("freq"))


def bigram_probabilities(bigrams: DataFrame) -> DataFrame:
    """P(second | first), P(first | second) of counted pairs w1, w2, freq."""
    first = bigrams.groupBy("w1").agg(F.sum("freq").alias("n1"))
    second = bigrams.groupBy("w2").agg(F.sum("freq").alias("n2"))
    return bigrams.join(first, "w1").join(second, "w2").select("w1", "w2", "freq", (F.col("freq") / F.col("n1")).alias("forward"), (F.col("freq") / F.col("n2")).alias("backward"))


def select_phrases(probabilities: DataFrame, least: float, certain: float) -> DataFrame:
    """Pairs probable both ways, or certain one way and more than nothing the other: (fwd and bwd) or (certain one and minimal other)."""
    fwd, bwd, low = F.col("forward"), F.col("backward"), least / 10
    return probabilities.where(((fwd >= least) & (bwd >= least)) | ((fwd >= certain) & (bwd >= low)) | ((fwd >= low) & (bwd >= certain))).select("w1", "w2", "freq")


def neighbours(terms: DataFrame, window: int = 1, order: str = "term") -> DataFrame:
    """Sorted-neighbourhood pairs: each term with the next ``window`` in order.

    Ranges are cut and sorted in parallel; each range lends its first
    ``window`` terms to the one before, so no task sees the whole order.
    """
    spark = terms.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = terms.select(F.col(order).alias("term")).distinct().repartitionByRange(n, "term").sortWithinPartitions("term")
    placed = save(placed.withColumn("at", F.monotonically_increasing_id()), "order").withColumn("part", F.shiftright("at", 33))
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each range
    bases, total = [], 0
    for part, c in counts:
        bases.append((part, total))
        total += c
    base = spark.createDataFrame(bases, "part long, base long")
    ranked = placed.join(F.broadcast(base), "part").select("term", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    ahead = ranked.select(F.col("term").alias("other"), F.explode(F.sequence(F.col("rank") - window, F.col("rank") - 1)).alias("rank"))
    return ranked.join(ahead, "rank").select("term", "other")


def similar_neighbours(terms: DataFrame, window: int = 20, least: float = 0.8) -> DataFrame:
    """Neighbours whose normalised distance, swaps allowed, leaves at least that similarity."""
    pairs = neighbours(terms, window)
    similarity = 1 - osa_distance("term", "other") / F.greatest(F.length("term"), F.length("other"))
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= least)


def term_groups(pairs: DataFrame, frequency: DataFrame) -> DataFrame:
    """Replacement pairs closed to groups; each term gets its group's most frequent term, the greater on ties."""
    groups = connected_components(pairs, "term", "other").withColumnRenamed("id", "term")
    best = groups.join(frequency, "term", "left").groupBy("component").agg(F.max_by("term", F.struct(F.coalesce("freq", F.lit(0)), "term")).alias("chosen"))
    return groups.join(best, "component").select("term", "chosen")


def transitions(pairs: DataFrame, frequency: DataFrame) -> DataFrame:
    """Weights of replacing a term by a similar one: frequency share times similarity, normalised for each term."""
    weighed = pairs.join(frequency.withColumnRenamed("term", "other"), "other").withColumn("raw", F.col("freq") * F.col("similarity"))
    return weighed.select("term", "other", (F.col("raw") / F.sum("raw").over(Window.partitionBy("term"))).alias("weight"))


def replace_until_stable(words: DataFrame, mapping: DataFrame, rounds: int = 100) -> DataFrame:
    """Apply (term, chosen) to (id, pos, term) rows until nothing changes; replacements that run in a circle raise."""
    now = words
    for _ in range(rounds):
        joined = now.join(mapping, "term", "left").select("id", "pos", F.coalesce("chosen", "term").alias("term"), (F.coalesce("chosen", "term") != F.col("term")).alias("changed"))
        joined = save(joined, "replaced")
        now = joined.drop("changed")
        if joined.where("changed").isEmpty():
            return now
    raise ValueError(f"terms still change after {rounds} rounds: the replacements run in a circle")


def substitutions(rows: DataFrame, terms: str, weights: DataFrame) -> DataFrame:
    """All versions of each row's term list with one transition for each slot, and the product of their weights.

    The lists are short by design (a handful of terms), and so is each term's list of transitions.
    """
    options = weights.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("other", "weight"))).alias("options"))
    long = rows.select("id", F.posexplode(terms).alias("pos", "term")).join(options, "term", "left")
    own = F.array(F.struct(F.col("term").alias("other"), F.lit(1.0).alias("weight")))
    slots = long.withColumn("options", F.coalesce("options", own)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("slots"))
    empty = F.array(F.struct(F.array().cast("array<string>").alias("terms"), F.lit(1.0).alias("weight")))
    grow = lambda acc, s: F.flatten(F.transform(acc, lambda a: F.transform(s["options"], lambda o: F.struct(F.array_append(a["terms"], o["other"]).alias("terms"), (a["weight"] * o["weight"]).alias("weight")))))
    return slots.select("id", F.explode(F.aggregate("slots", empty, grow)).alias("v")).select("id", "v.terms", "v.weight")
