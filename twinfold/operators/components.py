"""Connected components by contraction.

Every round points each vertex to its least neighbour, follows the pointers
twice by doubling, and replaces the edges by edges between what they point to.
Star-like graphs are gone after one round and chains shrink sixteenfold, so all
rounds together handle little more than the edges once. Rounds are stored tables: no
long lineage, and a lost executor repeats one round at most. Hubs meet no
single task: minima are taken before the shuffle, and the joins can be split
where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.plans.storage import save


def _tidy(edges: DataFrame, a, b) -> DataFrame:
    """Each undirected edge once, without loops and nulls."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for each vertex of an undirected edge list; the component is its least id.

    Vertices without an edge to another are the caller's to add. Loops and
    repeated edges are allowed, nulls are not links; no edges give no rows.
    """
    left = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    left = save(_tidy(left, F.col(src), F.col(dst)), "edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("other")).union(left.select("b", "a"))
        to = save(ends.groupBy("id").agg(F.min("other").alias("near")).select("id", F.least("id", "near").alias("to")), "pointers")
        for _ in range(2):
            up = to.select(F.col("id").alias("up"), F.col("to").alias("top"))
            to = to.join(up, to["to"] == up.up).select("id", F.col("top").alias("to"))
        to = save(to, "pointers")
        if labels is None:
            labels = to.withColumnRenamed("to", "component")
        else:
            by = to.select(F.col("id").alias("old"), F.col("to").alias("new"))
            labels = save(labels.join(by, labels.component == by.old, "left").select("id", F.coalesce("new", "component").alias("component")), "labels")
        of_a = to.select(F.col("id").alias("ida"), F.col("to").alias("toa"))
        of_b = to.select(F.col("id").alias("idb"), F.col("to").alias("tob"))
        mapped = left.join(of_a, F.col("a") == F.col("ida")).join(of_b, F.col("b") == F.col("idb"))
        left = save(_tidy(mapped, F.col("toa"), F.col("tob")), "edges")
        if left.isEmpty():
            return labels
