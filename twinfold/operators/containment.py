"""The partial order of representations by set inclusion, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinfold.operators.components import connected_components
from twinfold.plans.storage import save


def containment_pairs(reps: DataFrame) -> DataFrame:
    """(sub, sup) for all proper inclusions between non-empty sets.

    A superset has the subset's rarest feature, so that is the join key: each
    set asks in one posting list only, and only lists that are asked for travel.
    Sizes and the inclusion itself are checked in the join.
    """
    sets = reps.where("n > 0").select("rep_id", "features", "n")
    long = sets.select("rep_id", F.explode("features").alias("feature"))
    counts = long.groupBy("feature").agg(F.count("*").alias("c"))
    rarest = long.join(counts, "feature").groupBy("rep_id").agg(F.min(F.struct("c", "feature")).alias("key"))
    asking = sets.join(rarest.where("key.c > 1").select("rep_id", F.col("key.feature").alias("feature")), "rep_id")
    asked = asking.select("feature").distinct()
    answering = sets.select("rep_id", "features", "n", F.explode("features").alias("feature")).join(asked, "feature", "left_semi")
    a, b = asking.alias("a"), answering.alias("b")
    inside = (F.col("a.feature") == F.col("b.feature")) & (F.col("a.n") < F.col("b.n")) & (F.size(F.array_except("a.features", "b.features")) == 0)
    return a.join(b, inside).select(F.col("a.rep_id").alias("sub"), F.col("b.rep_id").alias("sup"))


def minimal_elements(pairs: DataFrame) -> DataFrame:
    """Representations with a proper superset and no proper subset."""
    return pairs.select(F.col("sub").alias("minel")).distinct().join(pairs.select(F.col("sup").alias("minel")).distinct(), "minel", "left_anti")


def minel_edges(pairs: DataFrame) -> DataFrame:
    """Minimal elements with all their supersets: as connected as the whole order, with fewer edges."""
    return pairs.withColumnRenamed("sub", "minel").join(minimal_elements(pairs), "minel", "left_semi").select("minel", F.col("sup").alias("rep_id"))


def minel_statistics(edges: DataFrame) -> DataFrame:
    """For each minimal element: supersets, those shared with other minimal elements, the rest, and the shared share."""
    shared = edges.groupBy("rep_id").agg(F.count("*").alias("minels"))
    per = edges.join(shared, "rep_id").groupBy("minel").agg(
        F.count("*").alias("any"), F.sum(F.when(F.col("minels") > 1, 1).otherwise(0)).alias("multi"), F.sum(F.when(F.col("minels") == 1, 1).otherwise(0)).alias("single")
    )
    return per.withColumn("prob", F.col("multi") / F.col("any"))


def cut_overconnected(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Edges without those to shared supersets of minimal elements that have more than ``most`` of these."""
    over = minel_statistics(edges).where(F.col("multi") > most).select("minel")
    shared = edges.groupBy("rep_id").agg(F.count("*").alias("c_")).where("c_ > 1").select("rep_id")
    return edges.join(edges.join(over, "minel", "left_semi").join(shared, "rep_id", "left_semi"), ["minel", "rep_id"], "left_anti")


def poset_components(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep_id, label) for every non-empty representation; the label is the component's least id, singletons are their own."""
    found = connected_components(edges, "minel", "rep_id").withColumnRenamed("id", "rep_id")
    return reps.where("n > 0").select("rep_id").join(found, "rep_id", "left").select("rep_id", F.coalesce("component", "rep_id").alias("label"))


def single_components(reps: DataFrame) -> DataFrame:
    """Every feature is a label; a representation may have several."""
    return reps.select(F.explode("features").alias("label"), "rep_id")


def direct_edges(pairs: DataFrame) -> DataFrame:
    """Transitive reduction: inclusions with no set in between. The pairs are closed, so two steps show all."""
    a, b = pairs.alias("a"), pairs.alias("b")
    between = a.join(b, F.col("a.sup") == F.col("b.sub")).select(F.col("a.sub").alias("sub"), F.col("b.sup").alias("sup"))
    return pairs.join(between, ["sub", "sup"], "left_anti")


def carried(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """obs, the own frequency, and car, with that of all supersets."""
    above = pairs.join(reps.select(F.col("rep_id").alias("sup"), "freq"), "sup").groupBy(F.col("sub").alias("rep_id")).agg(F.sum("freq").alias("more"))
    return reps.where("n > 0").join(above, "rep_id", "left").select("rep_id", "n", F.col("freq").alias("obs"), (F.col("freq") + F.coalesce("more", F.lit(0.0))).alias("car"))


def weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each direct edge the share of the general set's frequency that the special one carries; loops have obs/car. No frequency gives 0."""
    g, s = nodes.select(F.col("rep_id").alias("sub"), F.col("car").alias("car_g")), nodes.select(F.col("rep_id").alias("sup"), F.col("car").alias("car_s"))
    ratio = lambda x, y: F.when(F.col(y) == 0, F.lit(0.0)).otherwise(F.col(x) / F.col(y))
    own = nodes.select(F.col("rep_id").alias("sub"), F.col("rep_id").alias("sup"), ratio("obs", "car").alias("weight"))
    return edges.join(g, "sub").join(s, "sup").select("sub", "sup", ratio("car_s", "car_g").alias("weight")).union(own)


def spanning_parents(weighted: DataFrame) -> DataFrame:
    """For each set the generaliser with the greatest weight, the greater id on ties."""
    return weighted.where("sub <> sup").groupBy("sup").agg(F.max_by("sub", F.struct("weight", "sub")).alias("parent"))


def levels(pairs: DataFrame) -> DataFrame:
    """How many direct steps the shortest way from a set down to each of its subsets takes.

    (rep_id, general, level) from 1 on; the set itself is not listed. Rounds are bounded by the longest chain.
    """
    edges = direct_edges(pairs).select(F.col("sup").alias("from"), F.col("sub").alias("to"))
    now = edges.select("from", "to", F.lit(1).alias("level"))
    seen = now
    while True:
        nxt = now.alias("x").join(edges.alias("e"), F.col("x.to") == F.col("e.from")).select("x.from", "e.to", (F.col("level") + 1).alias("level")).distinct()
        nxt = save(nxt.join(seen.select("from", "to"), ["from", "to"], "left_anti"), "levels")
        if nxt.isEmpty():
            break
        seen, now = seen.union(nxt), nxt
    return seen.select(F.col("from").alias("rep_id"), F.col("to").alias("general"), "level")


def node_levels(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep_id, level): the longest chain of inclusions that ends in each set; sets that include none are at 0. Rounds are bounded by the longest chain."""
    edges = direct_edges(pairs)
    now = save(reps.where("n > 0").select("rep_id", F.lit(0).alias("level")), "node-levels")
    front = now
    while True:
        deeper = edges.join(front.select(F.col("rep_id").alias("sub"), "level"), "sub").groupBy(F.col("sup").alias("rep_id")).agg((F.max("level") + 1).alias("level"))
        front = save(deeper, "node-front")  # a chain one longer than the last round's ends in each of these
        if front.isEmpty():
            return now
        now = save(now.join(front.withColumnRenamed("level", "new"), "rep_id", "left").select("rep_id", F.coalesce("new", "level").alias("level")), "node-levels")


def gini(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Gini coefficient of a column within groups: (2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n).

    Only distinct values are sorted: equal ones have neighbouring ranks, whose sum is known from their count.
    """
    counted = df.groupBy(*by, F.col(value).alias("x_")).agg(F.count("*").alias("c_"))
    before = Window.partitionBy(*by).orderBy("x_").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("b_", F.coalesce(F.sum("c_").over(before), F.lit(0)))
    ranks = F.col("c_") * F.col("b_") + F.col("c_") * (F.col("c_") + 1) / 2
    total = ranked.groupBy(*by).agg(F.sum("c_").alias("n"), F.sum(F.col("c_") * F.col("x_")).alias("total"), F.sum(ranks * F.col("x_")).alias("moment"))
    return total.select(*by, "n", (2 * F.col("moment") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"))
