"""Sharding by Hilbert-curve ordering (operator 6), with DataFrame functions only.

Each metadata column is quantised to ``2**bits`` cells: numbers by quantiles of
the whole column, text in its order by the six bytes after the common
beginning of all values, null always in cell 0. The cells' place on a
Hilbert curve is found bit by bit; rows are dealt by ranges of (place, ties),
numbered through prefix sums over the ranges' counts, and the numbered line is
cut into runs of equal length. A run is compact in all columns at once, so that
the least and greatest values of its columns let a reader skip it.

Law: ``rows`` (run lengths differ by one at most). Defined results: a null text
has no bytes; null metadata and null ids are cells and ties like others; equal
rows keep one place each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import fresh, save, shuffle_partitions

BITS = 6


def cell(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """The cell of a column: 1 to 2**bits - 1 in the order of its values, 0 for null; one pass for the quantiles, for text one for its bounds before."""
    if isinstance(df.schema[column].dataType, NumericType):
        value = F.col(column).cast("double")
    else:  # the six bytes after what all values begin with, as a number
        raw = F.col(column).cast("string").cast("binary")
        least, most = df.agg(F.min(raw), F.max(raw)).first()
        same = len(os.path.commonprefix([bytes(least or b""), bytes(most or b"")]))
        value = F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 6)), 12, "0"), 16, 10).cast("double")
    steps = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    # quantiles that repeat stay, so that a few frequent values are spread over all cells
    edges = df.agg(F.percentile_approx(value, steps, 10_000)).first()[0] or []
    ascending = sorted(set(edges))
    below = F.array(*(F.lit(1 + bisect_left(edges, e)) for e in [*ascending, float("inf")]))
    above = F.element_at(below, F.size(F.filter(F.array(*(F.lit(float(e)) for e in ascending)), lambda e: e < value)) + 1) if edges else F.lit(1)
    return F.when(F.col(column).isNull(), 0).otherwise(above).cast("int")


def curve_index(df: DataFrame, cells: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """Add the place on the Hilbert curve of the cells' dimensions (Skilling's transposed form).

    Every step is a projection of its own; Spark fuses them into one stage.
    """
    n = len(cells)
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            first, own = F.col(cells[0]), F.col(cells[i])
            swap = first.bitwiseXOR(own).bitwiseAND(p)
            upper = own.bitwiseAND(q) != 0
            changed = {cells[0]: F.when(upper, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap))}
            if i:
                changed[cells[i]] = F.when(upper, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(changed)
    for i in range(1, n):
        df = df.withColumn(cells[i], F.col(cells[i]).bitwiseXOR(F.col(cells[i - 1])))
    turn = F.lit(0)
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(cells[-1]).bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0))
    df = df.withColumn(name, turn)
    df = df.withColumns({c: F.col(c).bitwiseXOR(F.col(name)) for c in cells})
    place = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for c in cells:
            place = place * 2 + F.shiftright(F.col(c), level).bitwiseAND(1)
    return df.withColumn(name, place).drop(*cells)


def order_and_cut(rows: DataFrame, dims: list[str], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0 up within each shard) to rows with the metadata columns ``dims``.

    ``ties`` order rows of one cell, so that a cell of any size can be dealt to
    several tasks. All further columns travel along: leave only small ones.
    """
    spark = rows.sparkSession
    cells = [fresh(rows, f"cell{i}_") for i in range(len(dims))]
    curve, at, part_, base_, rank = (fresh(rows, c) for c in ("curve_", "at_", "part_", "base_", "rank_"))
    placed = rows.withColumns({c: cell(rows, d, bits) for c, d in zip(cells, dims, strict=True)})
    placed = curve_index(placed, cells, bits, curve)
    dealt = placed.repartitionByRange(shuffle_partitions(spark), curve, *ties).sortWithinPartitions(curve, *ties)
    # The number has the range above bit 33 and the row's place in it below; stored, so that it never changes.
    dealt = save(dealt.withColumn(at, F.monotonically_increasing_id()).drop(curve), "curve")
    part, nth = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row for each range
    total, base = 0, []
    for p in sorted(counts):
        base.append((p, total))
        total += counts[p]
    bases = spark.createDataFrame(base, f"`{part_}` long, `{base_}` long")
    numbered = dealt.withColumn(part_, part).join(F.broadcast(bases), part_).withColumn(rank, F.col(base_) + nth)
    # shard s holds the ranks from ceil(s * total / shards) on
    numbered = numbered.withColumn("shard", F.expr(f"(`{rank}` * {shards}) div {max(total, 1)}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return numbered.withColumn("slot", F.col(rank) - first).drop(part_, base_, rank, at)


def shard_documents(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the metadata columns of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *(F.col(d).alias(f"dim_{d}") for d in dims))
    return order_and_cut(rows, [f"dim_{d}" for d in dims], shards, ["doc_id", "text_crc32", "size"])


def shard_ranges(sharded: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """Each shard's least and greatest metadata values: what a reader prunes by."""
    bounds = [f(f"dim_{d}").alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)


def write_shards(docs: DataFrame, sharded: DataFrame, out: str) -> None:
    """Write the documents as one folder for each shard, in slot order; ids must be unique.

    A column of the documents that is called shard or slot keeps its name; the folders' column then has one more underscore.
    """
    key, shard, slot = (fresh(docs, c) for c in ("id_", "shard", "slot"))
    at = sharded.select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    whole = docs.join(at, docs["doc_id"].eqNullSafe(F.col(key))).drop(key)
    whole.repartition(shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(out)
