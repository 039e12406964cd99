"""SimHash blocking: fingerprints, block permutations, components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.udfs import simhash
from twinfold.operators.components import connected_components


def fingerprints(reps: DataFrame) -> DataFrame:
    return reps.where("n > 0").select("rep_id", simhash("features").alias("hash"))


def similar_pairs(hashes: DataFrame, k: int = 3) -> DataFrame:
    """Pairs of fingerprints that differ in at most k of 64 bits.

    Equal fingerprints are one before the join, so copies make no pairs. Of k + 2
    blocks of bits at least two agree, so every two blocks are a key; the pair
    that several keys bring counts once.
    """
    one = hashes.groupBy("hash").agg(F.min("rep_id").alias("rep_id"))
    cuts = [64 * i // (k + 2) for i in range(k + 3)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = lambda n, m: F.struct(F.lit(n).alias("n"), F.col("hash").bitwiseAND(F.lit(signed(m))).alias("bits"))
    keys = F.array(*(key(n, x | y) for n, (x, y) in enumerate(combinations(masks, 2))))
    blocks = one.select("rep_id", "hash", F.explode(keys).alias("key")).select("rep_id", "hash", "key.n", "key.bits")
    a, b = blocks.alias("a"), blocks.alias("b")
    close = (F.col("a.n") == F.col("b.n")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.rep_id") < F.col("b.rep_id")) & (F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash"))) <= k)
    return a.join(b, close).select(F.col("a.rep_id").alias("a"), F.col("b.rep_id").alias("b")).distinct()


def copies(hashes: DataFrame) -> DataFrame:
    """Links of each fingerprint to the least that is equal to it."""
    one = hashes.groupBy("hash").agg(F.min("rep_id").alias("a"))
    return hashes.join(one, "hash").where("rep_id <> a").select("a", F.col("rep_id").alias("b"))


def simhash_components(reps: DataFrame, k: int = 3) -> DataFrame:
    """(rep_id, label): components of similar pairs; those without one are their own."""
    hashes = fingerprints(reps)
    found = connected_components(similar_pairs(hashes, k).union(copies(hashes)), "a", "b")
    return hashes.join(found.withColumnRenamed("id", "rep_id"), "rep_id", "left").select("rep_id", F.coalesce("component", "rep_id").alias("label"))


def hyperplane_labels(reps: DataFrame, planes: int = 50) -> DataFrame:
    """Bit labels by signs against pseudo-random hyperplanes whose entries are +1 or -1 by hash; equal labels are a component."""
    long = reps.where("n > 0").select("rep_id", F.explode("features").alias("f"))
    sums = [F.sum(F.when(F.shiftright(F.xxhash64("f", F.lit(p // 64)), p % 64).bitwiseAND(1) == 1, 1).otherwise(-1)) for p in range(planes)]
    signs = F.concat(*(F.when(s >= 0, "1").otherwise("0") for s in sums))
    return long.groupBy("rep_id").agg(signs.alias("label"))
