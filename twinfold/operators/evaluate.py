"""Clusterings against gold ids: pairwise and mapping-based precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_labels(mapped: DataFrame, components: DataFrame) -> DataFrame:
    """Mentions that have a gold id with their representation's label; one without a label is alone with its like."""
    gold = mapped.where("gold_id is not null")
    return gold.join(components.select("rep_id", "label"), "rep_id", "left").withColumn("label", F.coalesce("label", "rep_id"))


def percent(part: Column, whole: Column) -> Column:
    """Cut, not rounded, to two decimals; null over nothing."""
    return F.floor(10000 * part / whole) / 100


def _effective(labelled: DataFrame, max_label: int | None) -> DataFrame:
    if max_label is None:
        return labelled.withColumn("cluster", F.concat(F.lit("l"), "label"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("label_size"))
    joined = labelled.join(sizes, "label")
    return joined.withColumn("cluster", F.when(F.col("label_size") > max_label, F.concat(F.lit("r"), "rep_id")).otherwise(F.concat(F.lit("l"), "label")))


def _gold(labelled: DataFrame, min_gold: int, max_gold: int | None) -> DataFrame:
    sizes = labelled.groupBy("gold_id").agg(F.count("*").alias("gold_size"))
    legal = sizes.where((F.col("gold_size") >= min_gold) & (F.lit(True) if max_gold is None else F.col("gold_size") <= max_gold))
    return labelled.join(legal.select("gold_id"), "gold_id", "left_semi")


def pair_counts(rows: DataFrame, by: str) -> DataFrame:
    """One row: T, P and TP, the ordered pairs of members with themselves of gold groups, clusters and both; and the members."""
    cells = rows.groupBy(by, "gold_id").agg(F.count("*").alias("c"))
    p = cells.groupBy(by).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("tp")).agg(F.sum(F.col("c") * F.col("c")).alias("p"), F.sum("tp").alias("tp"), F.sum("c").alias("used"))
    t = cells.groupBy("gold_id").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("t"))
    return p.crossJoin(t)  # one row each


def gold_pairs(sizes: DataFrame) -> DataFrame:
    """One row: T from the sizes (c) of the gold groups."""
    return sizes.agg(F.sum(F.col("c") * F.col("c")).alias("t"))


def pair_rates(counts: DataFrame) -> DataFrame:
    return counts.select("t", "p", "tp", "used", percent(F.col("tp"), F.col("p")).alias("prec"), percent(F.col("tp"), F.col("t")).alias("rec"))


def pairwise(labelled: DataFrame, min_gold: int = 1, max_gold: int | None = None, max_label: int | None = None) -> DataFrame:
    """Precision and recall of the clusters, clusters over ``max_label`` split into their representations."""
    rows = _gold(_effective(labelled, max_label), min_gold, max_gold)
    return pair_rates(pair_counts(rows, "cluster"))


def rep_baseline(labelled: DataFrame, min_gold: int = 1, max_gold: int | None = None) -> DataFrame:
    """The same for clusters of equal representations, and the recall of mentions alone."""
    counts = pair_counts(_gold(labelled, min_gold, max_gold), "rep_id")
    return counts.select("t", "p", "tp", percent(F.col("tp"), F.col("p")).alias("prec"), percent(F.col("tp"), F.col("t")).alias("rec"), percent(F.col("used"), F.col("t")).alias("base_rec"))


def cells(labelled: DataFrame) -> DataFrame:
    """Mentions by label, representation and gold id (c), with those of the label (nl) and of the label and gold id (nc)."""
    counted = labelled.groupBy("label", "rep_id", "gold_id").agg(F.count("*").alias("c"))
    label_sizes = counted.groupBy("label").agg(F.sum("c").alias("nl"))
    both = counted.groupBy("label", "gold_id").agg(F.sum("c").alias("nc"))
    return counted.join(label_sizes, "label").join(both, ["label", "gold_id"])


def gold_sized(counted: DataFrame) -> DataFrame:
    """Cells with the mentions of their gold id (ng)."""
    return counted.join(counted.groupBy("gold_id").agg(F.sum("c").alias("ng")), "gold_id")


def sweep(labelled: DataFrame, min_golds: list[int], max_golds: list[int], max_labels: list[int]) -> DataFrame:
    """Pairwise results for all settings in one pass over (label, rep, gold) counts."""
    return sweep_cells(gold_sized(cells(labelled)), min_golds, max_golds, max_labels)


def sweep_cells(sized: DataFrame, min_golds: list[int], max_golds: list[int], max_labels: list[int]) -> DataFrame:
    """``sweep`` from cells, which are never repeated for the settings.

    The limits cut gold sizes into a few bands. Each representation and each label
    has the sum of its mentions by band, and a setting's pairs are squares of sums
    of neighbouring bands; what has the same gold id adds up over bands. Labels are
    then summed by the band of their own size.
    """
    cuts = sorted({*min_golds, *(m + 1 for m in max_golds)})
    bands = range(len(cuts) - 1)
    legal = {(a, b): [i for i in bands if a <= cuts[i] and cuts[i + 1] <= b + 1] for a in min_golds for b in max_golds}
    inside = lambda i: F.col("ng").between(cuts[i], cuts[i + 1] - 1)
    add = lambda names: sum(names, F.lit(0).cast("long"))
    c = F.col("c")
    rows = sized.select("label", "rep_id", "c", "nl", "nc", "ng").repartition("label")
    each = {"c": c, "w": c * F.col("nc"), "v": c * c, "t": c * F.col("ng")}
    reps = rows.groupBy("label", "rep_id").agg(F.max("nl").alias("nl"), *(F.sum(F.when(inside(i), x).otherwise(0)).alias(f"{k}{i}") for k, x in each.items() for i in bands))
    whole = {j: add(F.col(f"c{i}") for i in own) for j, own in enumerate(legal.values())}
    labels = reps.groupBy("label").agg(F.max("nl").alias("nl"), *(F.sum(f"{k}{i}").alias(f"{k}{i}") for k in each for i in bands), *(F.sum(x * x).alias(f"q{j}") for j, x in whole.items()))
    over = add(F.when(F.col("nl") > m, 1).otherwise(0) for m in sorted(max_labels)).alias("over")
    sums = labels.groupBy(over).agg(*(F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "wvt" for i in bands), *(F.sum(x * x).alias(f"p{j}") for j, x in whole.items()), *(F.sum(f"q{j}").alias(f"q{j}") for j in whole))
    settings = []
    for j, ((a, b), own) in enumerate(legal.items()):
        of = lambda k: add(F.col(f"{k}{i}") for i in own)  # noqa: B023, E731
        for m in max_labels:
            split = F.col("over") > sorted(max_labels).index(m)
            settings.append(F.struct(F.lit(a).alias("min_gold"), F.lit(b).alias("max_gold"), F.lit(m).alias("max_label"), of("t").alias("t"), F.when(split, F.col(f"q{j}")).otherwise(F.col(f"p{j}")).alias("p"), F.when(split, of("v")).otherwise(of("w")).alias("tp")))
    keys = ["min_gold", "max_gold", "max_label"]
    found = sums.select(F.inline(F.array(*settings))).groupBy(*keys).agg(*(F.sum(x).alias(x) for x in ("t", "p", "tp"))).where("t > 0")
    return found.select(*keys, "t", "p", "tp", percent(F.col("tp"), F.col("p")).alias("prec"), percent(F.col("tp"), F.col("t")).alias("rec"))


def core_counts(labelled: DataFrame, id: str = "mention_id") -> DataFrame:
    """Mapping-based TP, FP, TN and FN over the mentions.

    A mention's cluster holds all its gold duplicates (TP) iff its label group is
    as large as the union with its gold group. Sizes come from group counts, so
    no duplicate pair is ever listed.
    """
    return core_cells(gold_sized(cells(labelled)))


def core_cells(sized: DataFrame) -> DataFrame:
    """``core_counts`` from cells: nl - 1 others share the label, ng - 1 the gold id, nc - 1 both."""
    in_label, in_gold, union = F.col("nl") > 1, F.col("ng") > 1, F.col("nl") + F.col("ng") - F.col("nc")
    count = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    return sized.agg(
        count(in_label & (F.col("nl") == union)).alias("tp"), count(in_label & (F.col("nl") < union)).alias("fp"), count(~in_label & ~in_gold).alias("tn"), count(~in_label & in_gold).alias("fn")
    )


def core_rates(counts: DataFrame) -> DataFrame:
    """Precision and recall of both classes."""
    c = F.col
    return counts.select("*", percent(c("tp"), c("tp") + c("fp")).alias("prec"), percent(c("tp"), c("tp") + c("fn")).alias("rec"), percent(c("tn"), c("tn") + c("fn")).alias("neg_prec"), percent(c("tn"), c("tn") + c("fp")).alias("neg_rec"))


def negatives(labelled: DataFrame) -> DataFrame:
    """Groups of one, by gold id, label and representation."""
    out = None
    for kind in ("gold_id", "label", "rep_id"):
        one = labelled.groupBy(kind).agg(F.count("*").alias("c")).where("c = 1").agg(F.count("*").alias("singletons")).select(F.lit(kind).alias("kind"), "singletons")
        out = one if out is None else out.unionByName(one)
    return out


def report_table(results: DataFrame) -> DataFrame:
    """Precision by gold and label limits: one row for each gold limit, one column for each label limit."""
    return results.groupBy("max_gold").pivot("max_label").agg(F.first("prec"))


def gold_labels(labelled: DataFrame) -> DataFrame:
    """Each gold id with its distinct labels, sorted; binary ones are shown as hexadecimal digits."""
    found = labelled.groupBy("gold_id").agg(F.array_sort(F.collect_set("label")).alias("found"))
    texts = F.transform("found", lambda x: F.lower(F.hex(x))) if dict(labelled.dtypes)["label"] == "binary" else F.col("found")
    return found.select("gold_id", F.array_join(texts, ",").alias("labels"), F.size("found").cast("long").alias("n_labels"))


def minel_combinations(edges: DataFrame, mapped: DataFrame) -> DataFrame:
    """How often each gold id has each combination of minimal elements; a representation without any stands for itself."""
    combos = edges.groupBy("rep_id").agg(F.array_join(F.array_sort(F.collect_set("minel")), ",").alias("comb"))
    rows = mapped.where("gold_id is not null").join(combos, "rep_id", "left").withColumn("comb", F.coalesce("comb", "rep_id"))
    return rows.groupBy("gold_id", "comb").agg(F.count("*").alias("freq"))


def combination_rates(combinations: DataFrame) -> DataFrame:
    """One row: pairwise counts of the blocks that the combinations make, their precision and recall over all pairs (micro), and the mean precision of a block (macro)."""
    c = F.col("freq")
    blocks = combinations.groupBy("comb").agg(F.sum(c).alias("size"), F.sum(c * c).alias("tp"))
    square = F.col("size") * F.col("size")
    p = blocks.agg(F.sum("tp").alias("tp"), F.sum(square).alias("p"), F.round(F.avg(F.col("tp") / square), 6).alias("macro_prec"))
    t = combinations.groupBy("gold_id").agg(F.sum(c).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    return combination_percents(p.crossJoin(t))  # one row each


def combination_percents(rates: DataFrame) -> DataFrame:
    return rates.select("tp", "p", "t", percent(F.col("tp"), F.col("p")).alias("micro_prec"), percent(F.col("tp"), F.col("t")).alias("micro_rec"), "macro_prec")
