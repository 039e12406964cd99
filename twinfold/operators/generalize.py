"""Declarative row expansion: more general representations by rules."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.represent import rep_id

Counts = dict[str, int]


def parse_scheme(text: str) -> list[tuple[Counts, list[Counts]]]:
    """Lines ``n group n group --> n group | n group``: exact counts, and what to keep of them."""
    side = lambda s: {g: int(n) for n, g in zip(*[iter(s.split())] * 2, strict=True)}
    rules = []
    for line in text.splitlines():
        if line.strip():
            left, _, right = line.partition("-->")
            rules.append((side(left), [side(x) for x in right.split("|")]))
    return rules


def masks(left: Counts, right: Counts) -> list[list[tuple[str, int]]]:
    """Every way to drop the surplus of each group, as (group, place among its sorted values) pairs."""
    each = [[[(g, i) for i in drop] for drop in combinations(range(n), n - right.get(g, n))] for g, n in left.items()]
    return [sum(choice, []) for choice in product(*each)]


def in_group(group: Column | str):
    """Whether a feature is of a group."""
    prefix = F.concat(group, F.lit(":")) if isinstance(group, Column) else F.lit(f"{group}:")
    return lambda x: F.startswith(x, prefix)


def generalize(reps: DataFrame, rules: list[tuple[Counts, list[Counts]]], drop_always: tuple[str, ...] = ()) -> DataFrame:
    """Originals and what the rules make of them in one step, frequencies of equal sets added up; made ones bring none.

    A rule's counts must be met exactly in its groups; other groups stay. The
    masks depend on the rules alone, so they are constants of the plan.
    """
    made = []
    for left, rights in rules:
        drops = [m for r in rights for m in masks(left, r)]
        fits = F.lit(True)
        for g, n in left.items():
            fits &= F.size(F.filter("features", in_group(g))) == n
        if not drops:
            continue
        constant = F.array(*(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")) for g, i in m)) for m in drops if m))
        made.append(reps.where(fits).select("features", F.explode(constant).alias("mask")))
    out = reps.select("features", "freq")
    for one in made:
        # the features to drop: for each pair of the mask the i-th of the group's
        of_group = lambda d: F.get(F.filter("features", in_group(d["g"])), d["i"])
        left = one.select(F.array_except("features", F.transform("mask", of_group)).alias("features"))
        for g in drop_always:
            left = left.select(F.array_except("features", F.filter("features", in_group(g))).alias("features"))
        out = out.unionByName(left.select("features", F.lit(0.0).alias("freq")))
    return out.withColumn("rep_id", rep_id("features")).groupBy("rep_id", "features").agg(F.sum("freq").alias("freq")).withColumn("n", F.size("features"))


def one_class(reps: DataFrame, kept: list[str]) -> DataFrame:
    """Class generaliser: for each group of ``kept`` the set of its features and the first group's alone."""
    first, *others = kept
    group = F.explode(F.array(*map(F.lit, others))).alias("g")
    rows = reps.select("features", group)
    only = F.filter("features", lambda x: F.startswith(x, F.lit(f"{first}:")) | F.startswith(x, F.concat(F.col("g"), F.lit(":"))))
    return rows.select(only.alias("features")).where("size(features) > 0").distinct()


def drop_author_parts(df: DataFrame) -> DataFrame:
    """Author generaliser: last name, its initial and the first initial stay."""
    return df.withColumns({c: F.lit(None).cast("string") for c in ("f1_", "f2", "f2_", "f3", "f3_")})


def schemes(spark, limits: Counts, weights: Counts, least: int, ordered: list[tuple[str, str]] = ()) -> DataFrame:
    """Kept counts of least weight that reach a bound, for every tuple of upper bounds.

    The domains are small, so all (upper, kept) pairs are listed and the best
    kept for each upper bound: columns ``u_g``, ``k_g``, ``weight``, ``footprint``
    (how many sets the rule makes). ``ordered`` pairs (a, b) ask for k_a <= k_b.
    """
    table = None
    for g, n in limits.items():
        own = spark.range(n + 1).select(F.col("id").cast("int").alias(f"u_{g}")).withColumn(f"k_{g}", F.explode(F.sequence(F.lit(0), F.col(f"u_{g}"))))
        table = own if table is None else table.crossJoin(own)  # domains of a few numbers each
    total = sum((F.col(f"k_{g}") * w for g, w in weights.items()), F.lit(0))
    fits = total >= least
    for a, b in ordered:
        fits &= F.col(f"k_{a}") <= F.col(f"k_{b}")
    footprint = F.lit(1.0)
    for g in limits:
        footprint = footprint * F.factorial(f"u_{g}") / (F.factorial(f"k_{g}") * F.factorial(F.col(f"u_{g}") - F.col(f"k_{g}")))
    uppers, kepts = [f"u_{g}" for g in limits], [f"k_{g}" for g in limits]
    best = table.where(fits).withColumns({"weight": total, "footprint": footprint}).groupBy(*uppers).agg(F.min(F.struct("weight", "footprint", *kepts)).alias("b"))
    return best.select(*uppers, "b.weight", "b.footprint", *(f"b.{k}" for k in kepts))
