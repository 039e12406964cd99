"""MinHash near-dedup (operator 8): bottom-k sketches from one hash function.

1. Every document gets its set of five-word shingles, a 128-bit fingerprint of the
   whole set, and the ``K`` smallest shingle hashes. Equal sets are one class
   from here on, so copies never meet in a group.
2. Inverted lists of retained values: a class is in the lists of its ``FRONT``
   smallest. At a similarity of 0.8 two classes miss all common lists with a
   chance of 0.2^8 = 3e-6. Lists of one class are dropped by their counts. The
   members of a list of more than ``BLOCK`` classes (a common passage) are listed
   anew by this value and each of the ``NEXT`` that follow it; where that still
   gives more than ``BLOCK``, every two parts of the list meet in a task.
3. Within a list the sketches' overlaps, and of what overlaps enough the
   similarity estimated from the union sketch, tell which classes are near.
   Stars, a centre and all that is near it, cover the near pairs, so pairs never
   leave a task, and a group of copies needs about one star.
4. The full sets of a star meet once; exact intersections decide, every two
   blocks of a large star in a task of their own, and only a spanning forest of
   true links leaves.
5. Union-find over the true links.

Defined results: without words or text the set is empty, linked with nothing;
with fewer than five words the whole sequence is the one shingle; null ids rank
after all others; repeated ids each keep their rows; an empty table gives no
rows; other columns, whatever their names, are ignored (``components``) or kept
(``deduplicate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from twinfold.operators.components import connected_components

from .common import BitFilter, fresh, id_and_text, raw_bytes, release, save, shuffle_partitions, slices
from .wordhash import Words, chunks, distinct, mix

WORDS = 5
K = 64
FRONT, NEXT = 8, 8
BLOCK = 4096
#: Lists beyond this many first give the stars of a few centres and drop what nearly equals one.
MANY, CENTRES = 1024, 32
#: Entries of the largest 0-1 matrix that stands for some sets (4 bytes each).
MATRIX = 1 << 23
#: Estimated similarity from which two classes are near (0.8 is four deviations above), and from which one stands for the other in a long list.
NEAR, EQUAL = 0.6, 0.95

SIGNED = "row long, doc_id long, n_shingles long, f1 long, f2 long, sketch array<float>, front array<long>"
_SALT1, _SALT2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w = Words([t.lower() for t in texts[lo:hi]])
        at, key = w.shingles(words)
        cut = np.searchsorted(w.doc[at], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = key[cut[i] : cut[i + 1]]
            if not len(own) and w.first[i + 1] > w.first[i]:
                total = np.uint64(w.first[i + 1] - w.first[i])
                with np.errstate(over="ignore"):
                    for h in w.hash[w.first[i] : w.first[i + 1]]:
                        total = total * np.uint64(0x9E3779B97F4A7C15) + h
                own = mix(np.asarray([total], np.uint64))
            out.append(distinct(own))
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    return int(mix(own ^ _SALT1).sum(dtype=np.uint64).astype(np.int64)), int(mix(own ^ _SALT2).sum(dtype=np.uint64).astype(np.int64))


def sign(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Set size, fingerprint, sketch and the first retained values of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1024):
            rows = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(raw_bytes(batch.column("text")), words), strict=True):
                rows.append((row, doc, len(own), *fingerprint(own), own[:K].astype(np.float32), own[: FRONT + NEXT].astype(np.int64)))
                row += 1
            kinds = [pa.int64()] * 5 + [pa.list_(pa.float32()), pa.list_(pa.int64())]
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SIGNED.split(", ")])

    return id_and_text(docs).mapInArrow(each, SIGNED)


def union_estimate(sketches: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of each row to ``other`` by the K smallest values of the two sketches' union. Rows are ascending, padded with infinity."""
    both = np.sort(np.concatenate([sketches, np.broadcast_to(other, sketches.shape)], axis=1), axis=1)
    real = np.isfinite(both)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    distinct_ = np.cumsum(real & ~again, axis=1)
    within = distinct_ <= K
    return (again & within).sum(1) / np.maximum(1, np.minimum(distinct_[:, -1], K))


def overlaps(sketches: np.ndarray) -> np.ndarray:
    """How many retained values every two rows share."""
    real = np.isfinite(sketches)
    row = np.nonzero(real)[0]
    _, ids, count = np.unique(sketches[real], return_inverse=True, return_counts=True)
    many = count > 1
    row, ids = row[many[ids]], (np.cumsum(many) - 1)[ids[many[ids]]]
    total, width = np.zeros((len(sketches), len(sketches)), np.float32), 4096
    order = np.argsort(ids, kind="stable")
    row, ids = row[order], ids[order]
    for lo in range(0, int(many.sum()), width):
        a, b = np.searchsorted(ids, (lo, lo + width))
        table = np.zeros((len(sketches), width), np.float32)
        table[row[a:b], ids[a:b] - lo] = 1
        total += table @ table.T
    return total


def _alike(sizes: np.ndarray, other: int) -> np.ndarray:
    """Sizes that a similarity of a half allows."""
    return 2 * np.minimum(sizes, other) >= np.maximum(sizes, other)


def stars(sketches: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(centre, members) so that every two near rows are in one star together; if
    stars had many rows twice, all rows that have a neighbour are one."""
    rest, sent = np.arange(len(sketches)), 0
    for _ in range(CENTRES):
        if len(rest) <= MANY:
            break
        if sent > 2 * len(sketches):
            yield 0, np.arange(len(sketches))
            return
        guess = np.where(_alike(sizes[rest], sizes[rest[0]]), union_estimate(sketches[rest], sketches[rest[0]]), 0)
        guess[0] = 1  # the centre
        if (guess >= NEAR).sum() > 1:
            yield int(rest[0]), rest[guess >= NEAR]
            sent += int((guess >= NEAR).sum())
        rest = rest[1:][guess[1:] < EQUAL]
    have = np.isfinite(sketches[rest]).sum(1)
    own, left = sizes[rest], np.triu(overlaps(sketches[rest]) >= np.maximum(1, 0.4 * np.minimum(have, have[:, None])), 1)
    left &= _alike(own, own[:, None])
    near = left | left.T
    some, out, sent = int(near.any(axis=1).sum()), [], 0
    for p in np.flatnonzero(left.any(axis=1)).tolist():
        if not left[p].any():
            continue
        maybe = np.flatnonzero(near[p])
        star = maybe[union_estimate(sketches[rest[maybe]], sketches[rest[p]]) >= NEAR]
        left[p] = False
        if not len(star):
            continue
        star = np.append(p, star)
        left[np.ix_(star, star)] = False
        sent += len(star)
        if sent > 2 * some:
            yield int(rest[p]), rest[near.any(axis=1)]
            return
        out.append((int(rest[p]), rest[star]))
    yield from out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each key, of input that is sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
    del held
    release()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], *columns: str) -> Iterator[tuple[list, ...]]:
    """The same as lists of some columns' values, for input of many small groups."""
    held: tuple[list, ...] = tuple([] for _ in columns)
    now = None
    for batch in slices(batches, 2048):
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        values = [batch.column(c).to_pylist() for c in columns]
        cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(c[a] for c in own)
            if key != now and held[0]:
                yield held
                held = tuple([] for _ in columns)
            now = key
            for x, v in zip(held, values, strict=True):
                x += v[a:b]
    if held[0]:
        yield held


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(x, np.float32) for x in lists.to_pylist()]
    out = np.full((len(rows), K), np.inf, np.float32)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def listed(reps: DataFrame) -> DataFrame:
    """(key, i, j, row): who meets in which list; ``reps`` has row and front."""
    light = reps.select("row", F.explode(F.slice("front", 1, FRONT)).alias("key"))
    counted = save(light.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    cold = light.join(counted.where(F.col("size") <= BLOCK), "key").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "row")
    hot = light.join(counted.where(F.col("size") > BLOCK), "key").select("key", "row")
    after = F.slice("front", F.array_position("front", F.col("key")).cast("int") + 1, NEXT)
    again = hot.join(reps.select("row", "front"), "row").select("row", "key", F.explode(after).alias("next"))
    again = save(again.select("row", F.xxhash64("key", "next").alias("key")), "hot")
    parts = again.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    dealt = again.join(save(parts, "hot-lists"), "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("key", "row", "own", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row")
    return cold.union(dealt)


def candidates(reps: DataFrame) -> DataFrame:
    """(cluster, row): stars of near classes; ``reps`` has row, n_shingles, sketch, front."""
    n = shuffle_partitions(reps.sparkSession)
    full = listed(reps).join(reps.select("row", "n_shingles", "sketch"), "row")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, ["key", "i", "j"]):
            rows = table.column("row").to_numpy()
            rows, one = np.unique(rows, return_index=True)
            if len(rows) < 2:
                continue
            found = list(stars(_padded(table.column("sketch").take(one)), table.column("n_shingles").to_numpy()[one]))
            if found:
                centre = np.concatenate([np.full(len(s), rows[c]) for c, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(np.concatenate([rows[s] for _, s in found]))], names=["cluster", "row"])

    return full.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(each, "cluster long, row long").distinct()


def linked_sets(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted sets with den * intersection >= num * union."""
    b = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, b)
    if b == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common and den * common >= num * (len(sets[0]) + len(sets[1]) - common) else []
    flat = np.concatenate(sets) if b else np.empty(0, np.uint64)
    order = np.argsort(flat)
    value, owner = flat[order], np.repeat(np.arange(b), sizes)[order]
    del flat
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(value)))
    near = _by_product(sizes, owner, count, num, den) if b * int((count > 1).sum()) <= MATRIX else _ByLists(sizes, owner, count, order, num, den)
    free, forest = np.ones(b, bool), []
    for root in range(b):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue and free.any():
            new = np.flatnonzero(near(queue.pop(), free) & free)
            forest += [(root, int(i)) for i in new]
            free[new] = False
            queue += new.tolist()
    return forest


def _by_product(sizes: np.ndarray, owner: np.ndarray, count: np.ndarray, num: int, den: int):
    """All intersections as a product of 0-1 matrices over the elements that several sets have."""
    many = count > 1
    shared = np.repeat(many, count)
    table = np.zeros((len(sizes), int(many.sum())), np.float32)
    table[owner[shared], np.repeat(np.arange(table.shape[1]), count[many])] = 1
    common = (table @ table.T).astype(np.int64)
    near = (den * common >= num * (sizes[:, None] + sizes - common)) & (common > 0)
    return lambda x, free: near[x]


class _ByLists:
    """One set's intersections with the free sets, from the inverted lists of its
    elements. The lists are made anew whenever half of the sets in them are free no more."""

    def __init__(self, sizes: np.ndarray, owner: np.ndarray, count: np.ndarray, order: np.ndarray, num: int, den: int):
        self.sizes, self.num, self.den = sizes, num, den
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.owner, self.element = owner, np.repeat(np.arange(len(count)), count)
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = self.element
        self.elements = len(count)
        self._lists(np.ones(len(sizes), bool))

    def _lists(self, free: np.ndarray) -> None:
        own = free[self.owner]
        self.owner, self.element = self.owner[own], self.element[own]
        self.count = np.bincount(self.element, minlength=self.elements)
        self.begin = np.cumsum(self.count) - self.count
        self.held = int(free.sum())

    def __call__(self, x: int, free: np.ndarray) -> np.ndarray:
        if 2 * int(free.sum()) < self.held:
            self._lists(free)
        own = self.ids[self.first[x] : self.first[x + 1]]
        n = self.count[own]
        at = np.repeat(self.begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return (self.den * common >= self.num * (self.sizes + self.sizes[x] - common)) & (common > 0)


def to_blocks(members: DataFrame, row: str = "row", block: int = BLOCK, most: int = 32 << 20) -> DataFrame:
    """Add ``blocks``, how many parts a member's cluster is compared in, and ``block``, the member's.

    ``members`` has row, cluster and bytes; a block has about ``block`` members and
    ``most`` bytes at most. A cluster of one is dropped.
    """
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / most)).cast("int")
    sizes = members.groupBy("cluster").agg(F.least(parts, F.count("*").cast("int")).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.drop("bytes").join(save(sizes, "clusters"), "cluster").withColumn("block", F.pmod(F.xxhash64(row), F.col("blocks")).cast("int"))


def exact_forest(full: DataFrame, payload: str, to_sets, num: int, den: int) -> DataFrame:
    """(src, dst): a spanning forest of the true links of each cluster.

    ``full`` has row, cluster, blocks, block and a payload from which
    ``to_sets`` makes shingle sets. Every two blocks of a cluster meet in one
    task, so each member is sent once for each block of its cluster.
    """
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = full.select("row", payload, "cluster", F.explode(others).alias("pair")).select("cluster", "pair.i", "pair.j", "row", payload)
    n = shuffle_partitions(full.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[int], list[bytes]]] = []

        def done() -> Iterator[pa.RecordBatch]:
            sets = to_sets([x for _, own in held for x in own])
            at, src, dst = 0, [], []
            for rows, _ in held:
                for a, b in linked_sets(sets[at : at + len(rows)], num, den):
                    src.append(rows[a])
                    dst.append(rows[b])
                at += len(rows)
            held.clear()
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        waiting = 0
        for rows, payloads in groups(batches, ["cluster", "i", "j"], "row", payload):
            one = dict(zip(rows, payloads, strict=True))  # what came twice counts once
            if len(one) > 1:
                held.append((list(one), list(one.values())))
                waiting += len(one)
            if waiting >= 512:
                yield from done()
                waiting = 0
        if held:
            yield from done()

    return dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(link, "src long, dst long")


def true_links(docs: DataFrame, classes: DataFrame, members: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Exact links within stars; ``members`` has cluster and row, ``classes`` row, doc_id, n_shingles, f1, f2."""
    some = save(classes.join(members.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "n_shingles", "f1", "f2"), "near-classes")
    wanted = some.select(F.col("doc_id").alias("id"))
    texts = BitFilter(wanted, "id").keep(id_and_text(docs), "doc_id")
    texts = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.id), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            own = shingle_sets(raw_bytes(batch.column("text")), words)
            prints = [fingerprint(s) for s in own]
            columns = [[len(s) for s in own], [p[0] for p in prints], [p[1] for p in prints]]
            arrays = [pa.array(c, type=pa.int64()) for c in columns] + [pa.array([s.tobytes() for s in own], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["n_shingles", "f1", "f2", "set"])

    made = texts.mapInArrow(sets, "n_shingles long, f1 long, f2 long, set binary").join(some.drop("doc_id"), ["n_shingles", "f1", "f2"])
    # an id with several rows may have given a set more than once
    made = save(made.groupBy("row").agg(F.first("set").alias("set")), "sets")
    sized = members.join(some.select("row", (8 * F.col("n_shingles")).alias("bytes")), "row")
    full = to_blocks(save(sized, "members")).join(made, "row")
    return exact_forest(full, "set", lambda rows: [np.frombuffer(x, np.uint64) for x in rows], num, den)


def components(docs: DataFrame, num: int = 85, den: int = 100, words: int = WORDS) -> DataFrame:
    """One row for each document: row, doc_id, n_shingles, f1, f2, component_id, and component_row, the row that stands for the component."""
    signed = save(sign(docs, words), "signed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(best)
    classes = save(classes.select("n_shingles", "f1", "f2", "best.none", "best.doc_id", "best.row"), "classes")
    reps = save(signed.join(classes.select("row"), "row", "left_semi").select("row", "n_shingles", "sketch", "front"), "sketches")
    members = save(candidates(reps), "stars")
    joined = connected_components(true_links(docs, classes, members, num, den, words))
    of = classes.join(joined.select(F.col("id").alias("row"), F.col("component").alias("root")), "row", "left").withColumn("root", F.coalesce("root", "row"))
    of = save(of, "roots")
    least = of.groupBy("root").agg(F.min(F.struct("none", "doc_id", "row")).alias("least"))
    of = of.join(least, "root").select("n_shingles", "f1", "f2", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("component_row"))
    out = signed.select("row", "doc_id", "n_shingles", "f1", "f2").join(save(of, "classes"), ["n_shingles", "f1", "f2"], "left")
    alone = F.col("component_row").isNull()
    return out.select(
        "row", "doc_id", "n_shingles", "f1", "f2",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("row")).otherwise(F.col("component_row")).alias("component_row"),
    )


def deduplicate(docs: DataFrame, num: int = 80, den: int = 100, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component left, with all their columns."""
    found = save(components(docs, num, den, words), "components")
    # An id with several rows loses only those whose set is not kept; rows that agree in id and text are one.
    gone = found.groupBy("doc_id").agg(F.sum((F.col("row") != F.col("component_row")).cast("long")).alias("lost"), F.count("*").alias("rows")).where("lost > 0")
    gone = save(gone, "gone")
    key, repeated = fresh(docs, "gone_id"), gone.where("rows > 1")
    whole = docs.join(gone.where("rows = 1").select(F.col("doc_id").alias(key)), docs[doc_id].eqNullSafe(F.col(key)), "left_anti")
    if repeated.isEmpty():
        return whole
    names = docs.columns
    mark, nth = fresh(docs, "mark"), fresh(docs, "nth")
    few = docs.join(repeated.select(F.col("doc_id").alias(key)), docs[doc_id].eqNullSafe(F.col(key)), "left_semi")
    rest = whole.join(repeated.select(F.col("doc_id").alias(key)), whole[doc_id].eqNullSafe(F.col(key)), "left_anti")
    kept = found.where("row = component_row").join(repeated.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            sets = shingle_sets(raw_bytes(batch.column(names.index(text))), words)
            tags = pa.array([f"{len(s)}:{a}:{b}" for s in sets for a, b in [fingerprint(s)]], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, tags], names=[*names, mark])

    few = few.mapInArrow(prints, StructType([*docs.schema.fields, StructField(mark, StringType())]))
    order = Window.partitionBy(doc_id, mark).orderBy(text)
    few = few.withColumn(nth, F.row_number().over(order))
    tag, left = fresh(few, "tag"), fresh(few, "left")
    tags = kept.groupBy(F.col("doc_id").alias(key), F.concat_ws(":", "n_shingles", "f1", "f2").alias(tag)).agg(F.count("*").alias(left))
    few = few.join(tags, few[doc_id].eqNullSafe(F.col(key)) & (few[mark] == F.col(tag)) & (few[nth] <= F.col(left)), "left_semi")
    return rest.unionByName(few.select(*names))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
ends AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
lab AS (SELECT doc_id AS v, doc_id AS l FROM documents UNION SELECT ends.b, lab.l FROM lab JOIN ends ON ends.a = lab.v AND lab.l < ends.b),
comp AS (SELECT v, min(l) AS component_id FROM lab GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.v = d.doc_id
"""
