"""Best-fit packing (operator 10).

Documents become pieces of at most ``capacity`` tokens. Where a piece goes
depends on its length alone, so the packing is computed from the histogram of
lengths, which has at most ``capacity`` entries however many documents there
are: items above a third of the capacity are matched greedily, the longest with
the longest that fits beside it, at most two to a bin; shorter ones go, in
descending length, to the fullest bin that still takes them. The plan says for
each run of ranks within a length which bins and offset it gets; ranks come
from counts by partition and their prefix sums. No group of equal lengths meets
in one task.

Defined results: a null text is an empty document, a piece of the end id alone;
null and repeated document ids each keep their rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import ByteEncoder, encoder
from .common import id_and_text, raw_bytes, save, slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset) for all items of a histogram of lengths.

    Bins of the same content are handled as one group with a count, so the work
    depends on the number of distinct lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    by_gap: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and a + b <= capacity and left[b] > (b == a)), None)
            if b is None:
                by_gap[capacity - a][(a,)] += left[a]
                left[a] = 0
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                by_gap[capacity - a - b][(a, b)] += n
                left[a] -= n
                left[b] -= n
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        for gap in range(n, capacity + 1):
            if not c:
                break
            each = gap // n
            for items in sorted(by_gap[gap]):
                if not c:
                    break
                bins = by_gap[gap].pop(items)
                full = min(bins, c // each)
                if full:
                    by_gap[gap - n * each][items + (n,) * each] += full
                    c -= full * each
                    bins -= full
                if bins and c:
                    by_gap[gap - n * c][items + (n,) * c] += 1
                    c, bins = 0, bins - 1
                if bins:
                    by_gap[gap][items] += bins
        each = capacity // n
        if c // each:
            by_gap[capacity - n * each][(n,) * each] += c // each
        if c % each:
            by_gap[capacity - n * (c % each)][(n,) * (c % each)] += 1
    plan, rank, first = [], defaultdict(int), 0
    for groups in by_gap:
        for items, bins in sorted(groups.items()):
            offset = 0
            for n in items:
                plan.append((n, rank[n], bins, first, offset))
                rank[n] += bins
                offset += n
            first += bins
    return plan


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, kind: type = ByteEncoder, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents. Only documents longer than ``capacity`` are cut,
    and all their pieces but the first are full. ``part`` and ``nth`` number the
    pieces of a length within a task. ``keep_ids`` adds the ids themselves."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    fields = [(c, pa.int32() if c == "piece" else pa.int64()) for c in names]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(kind, tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches, 512):
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), enc.encode_all(raw_bytes(batch.column("text"))), strict=True):
                ids = np.empty(len(own) + 1, "<u4")
                ids[:-1], ids[-1] = own, end_id
                head = (len(ids) - 1) % capacity + 1
                at = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a], *([ids[a:b].astype(np.int32)] if keep_ids else [])))
                    seen[b - a] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(pieces, PIECE + (", ids array<int>" if keep_ids else ""))


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (rereading them must give the same rows)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = save(counts, "piece-counts")
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = np.asarray(sorted(plan_packing(hist, capacity)), dtype=np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # never broadcast: ``base`` grows with the tasks; a (part, length) has no more pieces than one task made
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    sent = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan[:, 3] - plan[:, 1], plan[:, 4]))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, offset = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            columns = [batch.column(c) for c in kept] + [pa.array(shift[at] + rank), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(look_up, f"{out}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, kind: type = ByteEncoder, keep_ids: bool = False) -> DataFrame:
    """Cut and place all documents; one row for each piece."""
    return place(save(cut(docs, tokenizer, capacity, end_id, kind, keep_ids), "pieces"), capacity)
