"""Benchmark decontamination by greedy string tiling (operator 5).

Words are compared in lower case without punctuation. A document and a test
item are tiled if windows of ``LEAST`` words that they share (seeds) cover
enough of the item: running Karp-Rabin marks the longest common runs of unmarked
words, and the search length falls until no run has ``LEAST`` words.
The tiles' order doesn't matter, so a passage whose sentences were moved is
still covered. A document with tiles over at least ``COVER`` of an item's words
holds that item.

The seeds of a benchmark of up to ``SEND_BYTES`` are sent to every task, and
each document is scanned where it is read. A larger benchmark is joined: seeds
of both sides meet by hash, and only pairs that share enough go on with texts.

Defined results: null and empty texts and items hold nothing; items of fewer
than ``LEAST`` words are never found; null and repeated ids each keep their
rows; empty tables give no rows; other columns stay (``drop_contaminated``) or
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, raw_bytes, save, slices, small_batches
from .wordhash import Words, chunks, distinct, powers

LEAST = 5
COVER = (60, 100)
SEND_BYTES = 32 << 20

_PLAIN = bytes.maketrans((ascii_uppercase + punctuation).encode(), ascii_lowercase.encode() + b" " * len(punctuation))


def plain(text: bytes) -> bytes:
    return text.translate(_PLAIN)


def word_hashes(text: bytes) -> np.ndarray:
    return Words([plain(text)]).hash


class _Side:
    """One of two word sequences: hashes of its windows of any length without marked words."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        ahead, self.back = powers(1 << max(12, len(words).bit_length()))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * ahead[: len(words)], out=self.sums[1:])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``n`` unmarked words begin, and their hashes."""
        if len(self.words) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def _hits(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in ``of``."""
    of = np.sort(of)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys if len(of) else np.zeros(len(keys), bool)


def _longest_run(at: np.ndarray) -> int:
    """The most consecutive numbers in an ascending array."""
    edges = np.flatnonzero(np.diff(at) > 1)
    return int(np.diff(np.concatenate([[-1], edges, [len(at) - 1]])).max()) if len(at) else 0


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, words) of the greedy tiling of two word sequences.

    Running Karp-Rabin: windows of the search length are hashed on both sides,
    matches are marked from the document's beginning, each with the item's first
    that is free, and the search length falls to the next longest match. Each
    round is linear in both lengths, however often words repeat, and the lengths
    of different tiles add up to the item's at most.
    """
    a, b, out = _Side(item), _Side(doc), []
    while True:
        i, keys_i = a.windows(least)
        j, keys_j = b.windows(least)
        seen = _hits(keys_j, keys_i)
        if not seen.any():
            return out
        low, high = least, least - 1 + min(_longest_run(j[seen]), _longest_run(i[_hits(keys_i, keys_j[seen])]))
        found, tried = None, high  # most often the longest run of seeds is one match
        while low <= high:
            i, keys_i = a.windows(tried)
            j, keys_j = b.windows(tried)
            seen = _hits(keys_j, keys_i)
            if seen.any():
                found, low = (tried, i, keys_i, j[seen], keys_j[seen]), tried + 1
            else:
                high = tried - 1
            tried = (low + high + 1) // 2
        n, i, keys_i, j, keys_j = found
        order = np.argsort(keys_i, kind="stable")
        i, keys_i = i[order], keys_i[order]
        first, last = np.searchsorted(keys_i, keys_j), np.searchsorted(keys_i, keys_j, side="right").tolist()
        free: dict[int, int] = {}
        end, before = -1, len(out)
        for x, lo, hi in zip(j.tolist(), first.tolist(), last, strict=True):
            if x < end:
                continue
            k = free.get(lo, lo)
            while k < hi and (a.marked[i[k]] or a.marked[i[k] + n - 1]):  # all tiles of this round are as long
                k += 1
            free[lo] = k
            if k < hi and np.array_equal(item[i[k] : i[k] + n], doc[x : x + n]):
                y = int(i[k])
                a.marked[y : y + n] = b.marked[x : x + n] = True
                out.append((y, x, n))
                end = x + n
        if len(out) == before:  # windows of one hash that aren't equal: as good as never
            b.marked[j] = True


class Benchmark:
    """Items by id: their words, and the items and places of each seed."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST):
        self.least = least
        self.ids = [i for i, _ in items]
        w = Words([plain(text) for _, text in items])
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        at, key = w.shingles(least)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.seeds, self.begin, self.count = key[begin], begin, np.diff(np.append(begin, len(key)))
        self.item = w.doc[at]
        self.place = at - w.first[self.item]

    def held(self, texts: list[bytes], cover: tuple[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, its words, covered, tiles) for every item that a text holds."""
        if not len(self.seeds):
            return
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        for lo, hi in chunks(texts):
            w = Words([plain(t) for t in texts[lo:hi]])
            at, key = w.shingles(self.least)
            seed = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            hit = np.flatnonzero(self.seeds[seed] == key)
            # each seed of a text once
            both = distinct(w.doc[at[hit]].astype(np.uint64) * np.uint64(len(self.seeds)) + seed[hit].astype(np.uint64)).astype(np.int64)
            doc, seed = both // len(self.seeds), both % len(self.seeds)
            n = self.count[seed]
            where = np.repeat(self.begin[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc, item, place = np.repeat(doc, n), self.item[where], self.place[where]
            order = np.lexsort((place, item, doc))
            doc, item, place = doc[order], item[order], place[order]
            # words of an item that shared windows cover together: tiles cover no more
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else np.empty(0, np.int64)
            step = np.minimum(np.diff(place, append=place[-1:] + self.least), self.least)
            step[np.append(new[1:], len(place))[: len(new)] - 1] = self.least
            reach = np.add.reduceat(step, new) if len(new) else new
            for k in np.flatnonzero(cover[1] * reach >= cover[0] * sizes[item[new]]).tolist():
                d, t = int(doc[new[k]]), int(item[new[k]])
                tiles = tile(self.words[t], w.hash[w.first[d] : w.first[d + 1]], self.least)
                covered = sum(x[2] for x in tiles)
                if cover[1] * covered >= cover[0] * len(self.words[t]):
                    yield lo + d, t, len(self.words[t]), covered, len(tiles)


HELD = "doc_id long, item_id long, item_words long, covered long, tiles long"
_NAMES = [c.split()[0] for c in HELD.split(", ")]


def _rows(ids: list, items: list, found) -> pa.RecordBatch:
    rows = [(ids[d], items[k], n, c, t) for d, k, n, c, t in found]
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=_NAMES)


def _sent(items: DataFrame, send_bytes: int):
    """The benchmark as a broadcast list, or None if it is larger than ``send_bytes``."""
    weight = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32).alias("n")).first().n or 0
    if weight > send_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast([(r.doc_id, (r.text or "").encode()) for r in items.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: tuple[int, int] = COVER, send_bytes: int = SEND_BYTES, item_id: str = "item_id") -> DataFrame:
    """A row for each document and item that it holds."""
    items = id_and_text(benchmark, item_id)
    sent = _sent(items, send_bytes)
    if sent is None:
        return _joined(docs, items, cover)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value)
        for batch in slices(batches, 1024):
            yield _rows(batch.column("doc_id").to_pylist(), bench.ids, bench.held(raw_bytes(batch.column("text")), cover))

    return id_and_text(docs).mapInArrow(each, HELD)


def _seeds(rows: DataFrame, name: str) -> DataFrame:
    """row and seed, each seed of a text once, with its number of places and words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            w = Words([plain(t) for t in raw_bytes(batch.column("text"))])
            at, key = w.shingles(LEAST)
            doc = w.doc[at]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            row, words = batch.column("row").to_numpy(), np.diff(w.first)
            arrays = [row[doc[new]], key[new].astype(np.int64), times, words[doc[new]]]
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()) for a in arrays], names=[name, "seed", "times", "words"])

    return rows.select("row", "text").mapInArrow(each, f"{name} long, seed long, times long, words long")


def _joined(docs: DataFrame, items: DataFrame, cover: tuple[int, int]) -> DataFrame:
    """The way for a benchmark too large to send."""
    texts = save(id_and_text(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    tests = save(items.withColumn("row", F.monotonically_increasing_id()), "tests")
    shared = _seeds(texts, "d").select("d", "seed").join(_seeds(tests, "t"), "seed")
    pairs = shared.groupBy("d", "t").agg(F.sum("times").alias("places"), F.first("words").alias("words"))
    pairs = save(pairs.where(F.col("places") * LEAST * cover[1] >= F.col("words") * cover[0]).select("d", "t"), "pairs")
    both = pairs.join(texts.select(F.col("row").alias("d"), "doc_id", "text"), "d").join(tests.select(F.col("row").alias("t"), F.col("doc_id").alias("item_id"), F.col("text").alias("item")), "t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            ids, tests_ = batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist()
            found = []
            for i, (text, item) in enumerate(zip(raw_bytes(batch.column("text")), raw_bytes(batch.column("item")), strict=True)):
                found += [(i, i, n, c, t) for _, _, n, c, t in Benchmark([(0, item)]).held([text], cover)]
            yield _rows(ids, tests_, found)

    return both.select("doc_id", "text", "item_id", "item").mapInArrow(each, HELD)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: tuple[int, int] = COVER, send_bytes: int = SEND_BYTES, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    items = id_and_text(benchmark, item_id)
    sent = _sent(items, send_bytes)
    if sent is None:
        # by 128 bits of the text: equal texts hold the same items
        one, two = F.xxhash64(F.col(text).cast("string")), F.xxhash64(F.lit(1), F.col(text).cast("string"))
        key, twin = fresh(docs, "held_one_"), fresh(docs, "held_two_")
        texts = save(docs.select(F.col(text).cast("string").alias("text")).distinct().withColumn("doc_id", F.monotonically_increasing_id()), "texts")
        held = _joined(texts, items, cover).select("doc_id").distinct()
        held = save(texts.join(held, "doc_id", "left_semi").select(F.xxhash64("text").alias(key), F.xxhash64(F.lit(1), "text").alias(twin)), "held")
        return docs.join(held, (one == F.col(key)) & (two == F.col(twin)), "left_anti")
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(sent.value)
        for batch in slices(batches, 1024):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in bench.held(raw_bytes(batch.column(at)), cover)]] = False
            yield batch.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(each, docs.schema)
