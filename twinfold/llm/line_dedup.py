"""Fuzzy line dedup by MinHash (operator 7).

A line is what ``\\n`` divides; it counts if it has at least ``min_words`` words:
one in the query and the pipeline, ``MIN_WORDS`` unless stated. Lines are
compared in lower case with single spaces, by the sets of their five-character
shingles.

1. ``BANDS`` bands of ``ROWS`` MinHash values each give a line its keys: two lines
   of similarity 0.8 share no band with a chance of 1.8e-4, of 0.85 with 1.2e-5.
   The keys travel packed by bucket, 24 bytes each, and meet in lists. Words of 32
   two-bit fields tell which lines of a list are near (lines of similarity 0.8
   aren't with a chance of 2e-4). A list is covered by stars, a centre and all
   that is near it, until every near pair is in a star together: copies of one
   line need one star, however many they are.
2. The texts of the lines that occur again or are in a star are read a second
   time. Exact Jaccard similarity decides within each star, every two blocks of
   a large one in a task of its own, and only a spanning forest of true links
   leaves: what merely resembles is never joined.
3. Distributed union-find over the true links gives the components. Of each the
   first line stays, by (document id, line number).

Equal lines are one by 128 bits of their hash. Lines of fewer characters than a
shingle take part by equality only.

Defined results: lines with fewer words stay and are never compared; null and
empty texts have no lines; null ids rank after all others; rows that agree in id
and text are one document (128 bits) and get one result; an empty table gives no
rows; other columns, whatever their names, stay (``remove_lines``) or are ignored
(``line_counts``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from twinfold.operators.components import connected_components

from .common import BitFilter, fresh, id_and_text, raw_bytes, release, save, shuffle_partitions, slices
from .near_dup import exact_forest, to_blocks
from .wordhash import chunks, distinct, mix

SHINGLE = 5
MIN_WORDS = 5
BANDS, ROWS = 16, 4
#: Of 32 two-bit fields; lines of similarity 0.8 differ in about 5, others in about 24.
MOST_UNLIKE, ALL_BUT_EQUAL = 11, 2
#: Lists of up to this many lines compare all pairs of words; longer ones begin with the stars of a few centres.
MANY, CENTRES = 4096, 64
#: Longer ones first drop the lines that are near no other, by all pairs up to this many lines, beyond it within cuts by further fields.
THINNED = 1 << 15
#: A task compares two blocks of a group at most; each has this many lines and bytes of text at most (one longer line is a block).
LINES, BYTES = 1024, 8 << 20
NUM, DEN = 80, 100
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32) | np.uint64(1)).astype(np.uint32)
#: Lines whose ids a task remembers, and entries that it packs at once.
REMEMBERED, PACKED = 200_000, 1 << 18


def compared(line: bytes, min_words: int = MIN_WORDS) -> bytes:
    """The form in which lines are compared; empty for one that is never compared."""
    words = line.lower().split()
    return b" ".join(words) if len(words) >= min_words else b""


def compared_lines(text: bytes, min_words: int = MIN_WORDS) -> list[bytes]:
    """``compared`` of every line of a text."""
    lines = text.lower().split(b"\n")
    odd = b"  " in text or b" \n" in text or b"\n " in text or text[:1] == b" " or text[-1:] == b" " or any(c in text for c in (b"\t", b"\r", b"\x0b", b"\x0c"))
    if odd:
        return [compared(x, min_words) for x in lines]
    return lines if min_words <= 1 else [x if x.count(b" ") + 1 >= min_words else b"" for x in lines]


def shingled(form: bytes) -> bool:
    """Whether a form has a shingle; a character has at most four bytes."""
    return len(form) >= 4 * SHINGLE or len(form.decode("utf-8", "replace")) >= SHINGLE


class Shingles:
    """Character-shingle hashes of several lines that have some, and where each line's begin."""

    def __init__(self, lines: list[bytes], kind: type = np.uint64):
        texts = [x.decode("utf-8", "replace") for x in lines]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(kind)
        at = np.cumsum([0, *map(len, texts)])
        n = len(chars) - SHINGLE + 1
        # a shingle begins at each character that has enough after it in its line; each line is long enough for one
        whole = np.ones(n + SHINGLE - 1, bool)
        for j in range(1, SHINGLE):
            whole[at[1:] - j] = False
        total = chars[:n].copy()
        for j in range(1, SHINGLE):
            total *= kind(0x9E3779B97F4A7C15 & np.iinfo(kind).max)
            total += chars[j : j + n]
        self.hash = _mixed(total[whole[:n]])
        self.first = np.concatenate([[0], np.cumsum(np.diff(at) - SHINGLE + 1)])

    def sets(self) -> list[np.ndarray]:
        return [distinct(self.hash[a:b]) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for either width, in place."""
    if x.dtype == np.uint64:
        return mix(x)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def min_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of MinHash values for each line. Lines of like length stand side
    by side, a column each, so that minima are taken over whole rows."""
    size = np.diff(first)
    out = np.empty((len(size), BANDS * ROWS), np.uint32)
    order = np.argsort(size, kind="stable")
    ordered = size[order]
    lo = 0
    while lo < len(order):
        least = int(ordered[lo])
        if least > 4096:
            own = values[first[order[lo]] : first[order[lo] + 1]]
            out[order[lo]] = [(own * odd).min() for odd in _ODD]
            lo += 1
            continue
        hi = min(int(np.searchsorted(ordered, least + 4 + least // 8, side="right")), lo + max(16, (1 << 17) // least))
        own = order[lo:hi]
        # a line's last shingle stands for those it lacks
        table = values[first[own] + np.minimum(np.arange(ordered[hi - 1])[:, None], ordered[lo:hi] - 1)]
        room = np.empty_like(table)
        best = np.empty((BANDS * ROWS, hi - lo), np.uint32)
        for k, odd in enumerate(_ODD):
            np.multiply(table, odd, out=room)
            np.minimum.reduce(room, axis=0, out=best[k])
        out[own] = best.T
        lo = hi
    return out


def bands(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row of band keys for each line, and the lines' words of 32 two-bit fields."""
    s = Shingles(lines, np.uint32)
    least = min_hashes(s.hash, s.first).astype(np.uint64)
    keys = np.zeros((len(least), BANDS), np.uint64)
    for r in range(ROWS):
        keys = keys * _BASE + least[:, r::ROWS]
    word = np.zeros(len(least), np.uint64)
    for r in range(32):
        word = word << np.uint64(2) | mix(least[:, r].copy()) & np.uint64(3)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _BASE), word


def line_id(form: bytes) -> bytes:
    return blake2b(form, digest_size=16).digest()


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi in chunks(lines):
        out += Shingles(lines[lo:hi]).sets()
    return out


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, and ``doc`` and ``twin``, the two hashes by which a document is known."""
    return id_and_text(docs, doc_id, text).select("doc_id", "text", *_known("doc_id", "text", "doc", "twin"))


def _known(doc_id: str, text: str, doc: str, twin: str) -> list:
    key, value = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return [F.xxhash64(key, value).alias(doc), F.xxhash64(value, F.lit(1), key).alias(twin)]


class _Packer:
    """Collects a task's arrays and gives them back as rows (bucket, kind, blob), a row for each bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, {}, 0

    def add(self, kind: int, table: np.ndarray) -> None:
        self.held.setdefault(kind, []).append(table)
        self.n += len(table)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``table`` rows go by their first column."""
        for kind, tables in self.held.items():
            table = np.concatenate(tables)
            to = (table[:, 0] >> np.uint64(33)) % np.uint64(self.buckets)
            order = np.argsort(to, kind="stable")
            table, to = table[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
            blobs = [x.tobytes() for x in np.split(table, cut[1:])] if len(to) else []
            yield pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), pa.array(blobs, type=pa.binary())], names=["bucket", "kind", "blob"])
        self.held, self.n = {}, 0


LINE, KEY = 0, 1


def packed_keys(docs: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """Rows of packed entries: ids of lines (twice if a line occurs again in the task), and (band key, line, word)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = _Packer(buckets), set()
        for batch in slices(batches, 512):
            forms = Counter(chain.from_iterable(compared_lines(text, min_words) for text in raw_bytes(batch.column(0))))
            forms.pop(b"", None)
            if not forms:
                continue
            ids = [line_id(f) for f in forms]
            short = np.frombuffer(b"".join(ids), "<u8")[::2]
            old = np.fromiter((i in seen for i in ids), bool, len(ids))
            count = np.fromiter(forms.values(), np.int64, len(ids))
            pack.add(LINE, np.concatenate([short[~old], short[old | (count > 1)]])[:, None])
            new = [(f, i) for f, i, o in zip(forms, short, old, strict=True) if not o and shingled(f)]
            for lo, hi in chunks([f for f, _ in new], 1 << 21):
                keys, words = bands([f for f, _ in new[lo:hi]])
                lines = np.fromiter((i for _, i in new[lo:hi]), np.uint64, hi - lo)
                pack.add(KEY, np.stack([keys.ravel(), lines.repeat(BANDS), words.repeat(BANDS)], axis=1))
            seen.update(ids)
            if len(seen) > REMEMBERED:
                seen.clear()
            if pack.n >= PACKED:
                yield from pack.rows()
        yield from pack.rows()

    return docs.select("text").mapInArrow(each, "bucket int, kind int, blob binary")


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of 32 two-bit fields words differ."""
    bits = a ^ b
    bits |= bits >> np.uint64(1)
    return np.bitwise_count(bits & np.uint64(0x5555555555555555))


def stars(word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(centre, members) so that every two near words are in one star together.

    A long list first gives the stars of a few centres and drops what all but
    equals a centre, whose neighbours are in that star too. What then is still
    long is freed of lines without a neighbour, or cut by further fields first.
    """
    rest, sent = np.arange(len(word)), 0
    for _ in range(CENTRES):
        if len(rest) <= MANY:
            break
        if sent > 2 * len(word):  # the whole list at once is less than so many stars
            yield 0, np.arange(len(word))
            return
        far = unlike(word[rest], word[rest[0]])
        if (far <= MOST_UNLIKE).sum() > 1:
            yield int(rest[0]), rest[far <= MOST_UNLIKE]
            sent += int((far <= MOST_UNLIKE).sum())
        rest = rest[1:][far[1:] > ALL_BUT_EQUAL]
    for own in [rest] if len(rest) <= THINNED else _cuts(word, rest):
        own = _near_any(word, own) if MANY < len(own) <= THINNED else own
        if len(own) > MANY:
            yield int(own[0]), own
        else:
            for centre, star in _covering(word[own]):
                yield int(own[centre]), own[star]


def _cuts(word: np.ndarray, rest: np.ndarray) -> Iterator[np.ndarray]:
    """Lines that agree in five fields, for 18 choices of five; words of similarity 0.8 agree in none of them with a chance of about 3e-5."""
    fields = (word[rest, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(np.int64)
    for stride in (1, 5, 11):
        turned = fields[:, np.arange(32) * stride % 32]
        for k in range(0, 30, 5):
            sub = turned[:, k : k + 5] @ (1 << np.arange(0, 10, 2))
            order = np.argsort(sub, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(sub[order])) + 1):
                yield rest[np.sort(own)]


def _near_any(word: np.ndarray, own: np.ndarray) -> np.ndarray:
    some = [(unlike(word[own[lo : lo + 64], None], word[own]) <= MOST_UNLIKE).sum(axis=1) > 1 for lo in range(0, len(own), 64)]
    return own[np.concatenate(some)]


def _covering(word: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Stars; or if these had many lines twice, all lines that have a neighbour as one."""
    n = len(word)
    near = np.empty((n, n), bool)
    for lo in range(0, n, 256):
        near[lo : lo + 256] = unlike(word[lo : lo + 256, None], word) <= MOST_UNLIKE
    left = np.triu(near, 1)
    some = np.flatnonzero(near.sum(axis=1) > 1)
    out, sent = [], 0
    for p in some.tolist():
        if left[p].any():
            star = np.flatnonzero(near[p])
            sent += len(star)
            if sent > 2 * len(some):
                return [(int(some[0]), some)]
            out.append((p, star))
            left[np.ix_(star, star)] = False
    return out


def groups_of_lists(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, line) of stars; ``table`` has (key, line, word) of whole lists."""
    table = table[np.argsort(table[:, 0], kind="stable")]
    same = table[1:, 0] == table[:-1, 0]
    table = table[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(table) else table
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    new = np.ones(len(table), bool)
    new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)  # a line that came from several tasks
    key, line, word = np.ascontiguousarray(table[new].T)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    nth = np.repeat(np.arange(len(begin)), size)
    # the near pairs of short lists; where there is one pair, it is the star
    few, pairs = np.repeat(size <= 8, size), []
    for d in range(1, 8):
        at = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
        at = at[unlike(word[at], word[at + d]) <= MOST_UNLIKE]
        pairs.append(np.stack([at, at + d], axis=1))
    pairs = np.concatenate(pairs)
    of = nth[pairs[:, 0]]
    found = np.bincount(of, minlength=len(begin))
    lone = pairs[found[of] == 1]
    centres, members = [line[lone[:, 0]].repeat(2)], [line[lone.ravel()]]
    for k in np.flatnonzero((found > 1) | (size > 8)).tolist():
        a, n = int(begin[k]), int(size[k])
        own = line[a : a + n]
        for centre, star in stars(word[a : a + n]):
            centres.append(np.full(len(star), own[centre]))
            members.append(own[star])
    return np.concatenate(centres).astype(np.int64), np.concatenate(members).astype(np.int64)


def unpacked(packed: DataFrame, n: int) -> DataFrame:
    """(cluster, line) of the lines in groups, and (null, line) of those that occur again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            ids, many = np.unique(np.frombuffer(b"".join(held.pop(LINE, [])), "<u8"), return_counts=True)
            again = ids[many > 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.array(again)], names=["cluster", "line"])
            cluster, line = groups_of_lists(np.frombuffer(b"".join(held.pop(KEY, [])), "<u8").reshape(-1, 3))
            if len(line):
                order = np.lexsort((line, cluster))
                cluster, line = cluster[order], line[order]
                new = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (line[1:] != line[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(cluster[new]), pa.array(line[new])], names=["cluster", "line"])

        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
                if bucket != now and held:
                    yield from done()
                now = bucket
                held.setdefault(kind, []).append(blob)
        if held:
            yield from done()
        release()

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(each, "cluster long, line long")


_FOUND = pa.schema([("line", pa.binary()), ("short", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("form", pa.binary())])


def occurrences(docs: DataFrame, wanted: BitFilter, in_groups: BitFilter, min_words: int) -> DataFrame:
    """Where the lines that may be wanted occur, and for those in groups the form at least once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, 512):
            forms, row, nth = [], [], []
            for i, text in enumerate(raw_bytes(batch.column("text"))):
                for k, form in enumerate(compared_lines(text, min_words)):
                    if form:
                        forms.append(form)
                        row.append(i)
                        nth.append(k)
            if not forms:
                continue
            ids = [line_id(f) for f in forms]
            short = np.frombuffer(b"".join(ids), "<i8")[::2]
            some = np.flatnonzero(wanted.hit(short))
            full = in_groups.hit(short[some])
            sent = []
            for i, g in zip(some.tolist(), full.tolist(), strict=True):
                first = g and ids[i] not in seen
                if first:
                    seen.add(ids[i])
                sent.append(forms[i] if first else None)
            if len(seen) > REMEMBERED:
                seen.clear()
            at = pa.array(np.asarray(row)[some])
            own = [pa.array([ids[i] for i in some], type=pa.binary()), pa.array(short[some]), *(batch.column(c).take(at) for c in ("doc", "twin", "doc_id")), pa.array(np.asarray(nth)[some], type=pa.int32()), pa.array(sent, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(own, schema=_FOUND)

    return docs.mapInArrow(each, "line binary, short long, doc long, twin long, doc_id long, nth int, form binary")


def true_links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) between ``row`` of different lines of similarity 0.8 or more: a spanning forest of each group."""
    members = save(groups.join(texts.select("row", F.col("short").alias("line"), F.length("form").alias("bytes")), "line").select("cluster", "row", "bytes"), "members")
    full = to_blocks(members, block=LINES, most=BYTES).join(texts.select("row", "form"), "row")
    return exact_forest(full, "form", line_sets, NUM, DEN)


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, twin and ``gone``, the numbers of the lines that it loses, for each keyed document that loses any."""
    n = shuffle_partitions(docs.sparkSession)
    found = save(unpacked(packed_keys(docs, 4 * n, min_words), n), "line-groups")
    groups = save(found.where("cluster is not null").distinct(), "groups")
    occurs = save(occurrences(docs, BitFilter(found, "line", hashed=True), BitFilter(groups, "line", hashed=True), min_words), "lines")
    texts = occurs.where("form is not null").select("line", "short", "form").dropDuplicates(["line"])
    texts = save(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    joined = connected_components(true_links(groups, texts))
    of = joined.join(texts.select(F.col("row").alias("id"), "line"), "id").join(texts.select(F.col("row").alias("component"), F.col("line").alias("least")), "component")
    placed = occurs.drop("form", "short").join(of.select("line", "least"), "line", "left").withColumn("group", F.coalesce("least", "line")).drop("line", "least")
    placed = save(placed, "placed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "twin", "nth")
    first = placed.groupBy("group").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("group", F.col("kept.doc").alias("d"), F.col("kept.twin").alias("t"), F.col("kept.nth").alias("k"))
    # a stored side lets Spark split the other where a line is very frequent
    lost = placed.join(save(first, "firsts"), "group").where("not (doc = d and twin = t and nth = k)")
    return lost.groupBy("doc", "twin").agg(F.collect_set("nth").alias("gone"))  # no more than a document has lines


def _without(text: bytes, gone: set[int]) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return b"\n".join(kept), sum(bool(x) and not x.isspace() for x in lines), len(lines) - len(kept)


def line_counts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed and the text that is left, for every document."""
    rows = keyed(docs)
    lost = save(removals(rows, min_words), "lost-lines")
    touched, whole = _parted(rows, lost)
    both = touched.unionByName(whole)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            out = [_without(t, set(g or ())) for t, g in zip(raw_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True)]
            text, lines, removed = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())],
                names=["doc_id", "n_lines", "n_removed", "text"],
            )

    return both.select("doc_id", "text", "gone").mapInArrow(each, "doc_id long, n_lines long, n_removed long, text string")


def _parted(rows: DataFrame, lost: DataFrame, doc: str = "doc", twin: str = "twin", gone: str = "gone") -> tuple[DataFrame, DataFrame]:
    """Rows joined to what they lose, and the rows that lose nothing; only rows that may lose something are shuffled."""
    sure = BitFilter(lost, "doc", hashed=True)
    one, two = fresh(rows, "lost_doc_"), fresh(rows, "lost_twin_")
    lost = lost.select(F.col("doc").alias(one), F.col("twin").alias(two), F.col("gone").alias(gone))
    maybe = sure.keep(rows, doc)
    touched = maybe.join(lost, (F.col(doc) == F.col(one)) & (F.col(twin) == F.col(two)), "left").drop(one, two)
    return touched, sure.keep(rows, doc, invert=True).withColumn(gone, F.lit(None).cast(ArrayType(IntegerType())))


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines that repeat, with all their columns; those that lose all their words go.

    Documents that lose nothing stay as they are. A column of text lengths, if
    there is one, follows a new text.
    """
    doc, twin, gone = fresh(docs, "doc_"), fresh(docs, "twin_"), fresh(docs, "gone_")
    lost = save(removals(keyed(docs, doc_id, text), min_words), "lost-lines")
    rows = docs.select("*", *_known(doc_id, text, doc, twin))
    touched, whole = _parted(rows, lost, doc, twin, gone)
    names = docs.columns
    at = names.index(text)
    count = names.index(n_chars) if n_chars in names else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            columns = batch.columns[: len(names)]
            lost_lines = batch.column(len(names)).to_pylist()
            left = [None if g is None else _without(t, set(g))[0] for t, g in zip(raw_bytes(columns[at]), lost_lines, strict=True)]
            old = columns[at].to_pylist()
            new = [o if t is None else t.decode("utf-8", "replace") for o, t in zip(old, left, strict=True)]
            columns[at] = pa.array(new, type=pa.string())
            if count is not None:
                sizes = columns[count].to_pylist()
                columns[count] = pa.array([n if t is None else len(x) for n, t, x in zip(sizes, left, new, strict=True)], type=columns[count].type)
            some = pa.array([t is None or bool(t.split()) for t in left], type=pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(some)

    return touched.select(*names, gone).mapInArrow(each, docs.schema).unionByName(whole.select(*names))
