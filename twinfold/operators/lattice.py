"""Lattice disambiguation of components: merge by threshold, discount, measure.

Components are small and independent, so each is one group of ``applyInPandas``;
those with more than ``max_nodes`` representations are reported, not refined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "label string, iteration int, thr double, blocks int, prec double, rec double, f1 double, gini double"


def _steps(spec: np.ndarray) -> np.ndarray:
    """The direct steps of an order."""
    strict = spec & ~np.eye(len(spec), dtype=bool)
    return strict & ~_product(strict)


def _product(a: np.ndarray) -> np.ndarray:
    """The relation twice in a row. Counts of ways stay whole in 32-bit floats, whose products are fast."""
    f = a.astype(np.float32)
    return f @ f > 0.5


def _inclusion(sets: list[frozenset]) -> np.ndarray:
    """Which sets are in which, from the sizes of their intersections."""
    index = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    table = np.zeros((len(sets), len(index)), np.float32)
    for i, s in enumerate(sets):
        table[i, [index[x] for x in s]] = 1
    return table @ table.T >= table.sum(axis=1)[:, None]


def _weights(spec: np.ndarray, step: np.ndarray, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """car and the weights over the order's direct steps, loops with obs/car; nothing carried weighs nothing."""
    car = spec @ obs
    safe = np.where(car > 0, car, 1)
    w = np.where(step, car[None, :] / safe[:, None], 0)
    np.fill_diagonal(w, obs / safe)
    return car, np.where(car[:, None] > 0, w, 0)


def _closure(spec: np.ndarray) -> np.ndarray:
    while True:
        more = _product(spec)
        if (more == spec).all():
            return spec
        spec = more


def block_rates(cells: np.ndarray) -> tuple[float, float, float]:
    """Pairwise precision, recall and their mean over a block by gold matrix; 1 for nothing."""
    tp, p, t = float((cells**2).sum()), float((cells.sum(1) ** 2).sum()), float((cells.sum(0) ** 2).sum())
    prec, rec = tp / p if p else 1.0, tp / t if t else 1.0
    return prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0


def gini(x: np.ndarray) -> float:
    x = np.sort(x)
    n, total = len(x), x.sum()
    return float(2 * (np.arange(1, n + 1) * x).sum() / (n * total) - (n + 1) / n) if total else 0.0


def _merged(over: np.ndarray, obs: np.ndarray, max_size: float) -> list[list[int]]:
    """The groups of what ``over`` joins; one that would be too large stays apart."""
    parent = list(range(len(obs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(over), strict=True):
        x, y = sorted((find(int(a)), find(int(b))))
        parent[y] = x
    groups: dict[int, list[int]] = {}
    for i in range(len(obs)):
        groups.setdefault(find(i), []).append(i)
    merged = [g if len(g) == 1 or obs[g].sum() <= max_size else None for g in groups.values()]
    return [g for m, own in zip(merged, groups.values(), strict=True) for g in ([m] if m else [[i] for i in own])]


def refine(nodes: pd.DataFrame, step: float = 0.01, max_size: float = 1000, discount: float = 1.0) -> list[tuple]:
    """(iteration, thr, blocks, prec, rec, f1, gini) for falling thresholds over one component.

    ``nodes`` has features, freq and gold, one row for each representation and gold id.
    """
    by = nodes.groupby("rep_id", sort=True)
    features = [frozenset(g.features.iloc[0]) for _, g in by]
    obs = np.asarray([g.freq.sum() for _, g in by], float)
    golds = {g: i for i, g in enumerate(sorted(nodes.gold.dropna().unique()))}
    cells = np.zeros((len(obs), max(1, len(golds))))
    for i, (_, g) in enumerate(by):
        for gold, freq in zip(g.gold, g.freq, strict=True):
            if isinstance(gold, str):
                cells[i, golds[gold]] += freq
    spec = _inclusion(features)
    direct, found = _steps(spec), (int((cells.sum(1) > 0).sum()), *block_rates(cells))
    out = []
    for it in range(1, int(round(1 / step)) + 1):
        thr = 1 - it * step
        if len(obs) == 1:  # neither merging nor discounting changes a single block
            out.append((it, round(thr, 4), *found, gini(obs)))
            continue
        _, w = _weights(spec, direct, obs)
        over = w > max(thr, 0)
        np.fill_diagonal(over, False)
        if over.any():
            final = _merged(over, obs, max_size)
            if len(final) < len(obs):
                join = np.zeros((len(final), len(obs)))
                for k, g in enumerate(final):
                    join[k, g] = 1
                spec = _closure((join @ spec @ join.T) > 0)
                obs, cells = join @ obs, join @ cells
                direct, found = _steps(spec), (int((cells.sum(1) > 0).sum()), *block_rates(cells))
                _, w = _weights(spec, direct, obs)
        out.append((it, round(thr, 4), *found, gini(obs)))
        rows = w.sum(1, keepdims=True)
        share = np.divide(w, rows, out=np.zeros_like(w), where=rows > 0)
        stays = discount * obs * (rows[:, 0] == 0)
        obs = obs - discount * obs + share.T @ (discount * obs) + stays
    return out


def disambiguate(reps: DataFrame, components: DataFrame, golds: DataFrame, max_nodes: int = 6000, step: float = 0.01, max_size: float = 1000) -> DataFrame:
    """Results by iteration for every component of at most ``max_nodes`` representations.

    ``golds`` has rep_id, gold_id, freq. Larger components have one row with
    iteration 0, so that none is lost silently.
    """
    rows = components.join(reps.select("rep_id", "features"), "rep_id").join(golds.select("rep_id", F.col("gold_id").alias("gold"), "freq"), "rep_id", "left")
    rows = rows.select("label", "rep_id", "features", "gold", F.coalesce("freq", F.lit(0.0)).alias("freq"))
    sizes = components.groupBy("label").agg(F.count("*").alias("size"))
    small = rows.join(sizes.where(F.col("size") <= max_nodes).select("label"), "label", "left_semi")

    def run(key, nodes: pd.DataFrame) -> pd.DataFrame:
        found = refine(nodes, step, max_size)
        return pd.DataFrame([(key[0], *r) for r in found], columns=["label", "iteration", "thr", "blocks", "prec", "rec", "f1", "gini"])

    done = small.groupBy("label").applyInPandas(run, RESULT)
    null = F.lit(None).cast("double")
    skipped = sizes.where(F.col("size") > max_nodes).select("label", F.lit(0).alias("iteration"), null.alias("thr"), F.col("size").cast("int").alias("blocks"), *(null.alias(c) for c in ("prec", "rec", "f1", "gini")))
    return done.unionByName(skipped)


def slot_statistics(reps: DataFrame) -> DataFrame:
    """Representations and frequency for each set of groups."""
    groups = F.array_join(F.array_sort(F.array_distinct(F.transform("features", lambda x: F.split_part(x, F.lit(":"), F.lit(1))))), "+")
    return reps.where("n > 0").groupBy(groups.alias("slots")).agg(F.count("*").alias("types"), F.sum("freq").alias("freq"))


def threshold(kind: str, n: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """Merge thresholds as functions of the size: root, logistic, double logistic."""
    if kind == "root":
        return F.pow(n, F.lit(-1 / a))
    if kind == "logistic":
        return 1 / (1 + F.exp(-(n - b) / a))
    return F.signum(n - b) * (1 - F.exp(-F.pow((n - b) / a, 2))) / 2 + 0.5


def probability_similarity(long: DataFrame, smooth: float = 0.0) -> DataFrame:
    """Mean over a pair's groups of the probability to draw the same value of a group from both; ``long`` has rep_id, grp, val."""
    sizes = long.groupBy("rep_id", "grp").agg(F.count("*").alias("k"))
    rows = long.join(sizes, ["rep_id", "grp"]).withColumn("p", (1 + F.lit(smooth)) / (F.col("k") + F.lit(smooth)))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.val") == F.col("b.val")) & (F.col("a.rep_id") < F.col("b.rep_id")))
    by_group = both.groupBy(F.col("a.rep_id").alias("a"), F.col("b.rep_id").alias("b"), F.col("a.grp").alias("grp")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("s"))
    return by_group.groupBy("a", "b").agg(F.avg("s").alias("similarity"))


def minel_query(reps: DataFrame) -> DataFrame:
    """The boolean query text that finds what a minimal element generalises."""
    part = F.transform("features", lambda x: F.concat(F.split_part(x, F.lit(":"), F.lit(1)), F.lit(" = '"), F.replace(F.substring_index(x, ":", -1), F.lit("'"), F.lit("''")), F.lit("'")))
    return reps.select("rep_id", F.array_join(part, " AND ").alias("query"))
