"""The order of sets by inclusion where it falls into independent lists.

If every set has exactly one feature of some group, a set and its supersets have
the same one: all inclusions lie within the list of sets that share it. Mentions
are then dealt once by that feature (or anything it determines), and whatever
follows from the order is made list by list, without tables of sets or pairs:
the one shuffle is all that is written. ``containment`` has the general way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from hashlib import sha1

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from twinfold.operators.represent import UNIT

#: Mentions of whole lists that are handled at once, and pairs of sets that are compared at once.
BLOCK, COMPARED = 1 << 16, 1 << 21


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists; equal keys, the first column, follow each other."""
    held, rows, least = [], 0, BLOCK
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).combine_chunks()
        cut = len(key) - _runs(key)[-1]
        if cut == len(key):  # all one list, which goes on
            least = 2 * rows
            continue
        yield table.slice(0, len(key) - cut)
        held, rows, least = table.slice(len(key) - cut).to_batches(), cut, BLOCK + cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(key: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin."""
    codes = key.dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 0, .., 1, 1, .. by count, and 0, 1, .. within each."""
    who = np.repeat(np.arange(len(count)), count)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Order:
    """The sets of some whole lists, numbered, and all proper inclusions between them."""

    rows: pa.Table

    def __post_init__(self) -> None:
        key, text = (self.rows.column(c).combine_chunks() for c in ("key", "text"))
        coded = text.dictionary_encode()
        self.rep, self.texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.size = len(self.texts)
        run = np.zeros(len(key), np.int64)
        run[_runs(key)[1:]] = 1
        of = np.empty(self.size, np.int64)
        of[self.rep] = np.cumsum(run)
        parts = pc.split_pattern(self.texts, UNIT)
        at, names = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        n = np.diff(at)
        # features numbered within their list; a set's bits say by which of them it can't be inside another
        known, number = np.unique(np.repeat(of, n) * len(names.dictionary) + names.indices.to_numpy(), return_inverse=True)
        heads = np.searchsorted(known, np.arange(of.max() + 2) * len(names.dictionary))
        bits = np.left_shift(np.uint64(1), ((number - np.repeat(heads[of], n)) & 63).astype(np.uint64))
        bits = np.bitwise_or.reduceat(bits, at[:-1])
        wide = np.diff(heads)[of] > 64
        have = np.sort(np.repeat(np.arange(self.size), n) * len(known) + number) if wide.any() else None

        order = np.lexsort((n, of))
        of, bits_, by = of[order], bits[order], (of * (n.max() + 1) + n)[order]
        first, end = np.searchsorted(by, by, "right"), np.searchsorted(of, of, "right")
        count, found = end - first, []
        steps = np.searchsorted(np.cumsum(count), np.arange(COMPARED, count.sum(), COMPARED))
        steps = np.unique(np.r_[0, steps, self.size])
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            who, nth = _spread(count[lo:hi])
            a, b = who + lo, nth + first[lo:hi][who]
            ok = (bits_[a] & ~bits_[b]) == 0
            a, b = order[a[ok]], order[b[ok]]
            if have is not None and len(a):
                check = np.flatnonzero(wide[a])
                who, nth = _spread(n[a[check]])
                wanted = b[check][who] * len(known) + number[at[a[check]][who] + nth]
                miss = have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] != wanted
                bad = np.bincount(who[miss], minlength=len(check)) > 0
                keep = np.ones(len(a), bool)
                keep[check[bad]] = False
                a, b = a[keep], b[keep]
            found.append((a, b))
        self.sub, self.sup = (np.concatenate(x) for x in zip(*found, strict=True))

    @cached_property
    def _digests(self) -> list:
        return [sha1(t.as_buffer()) for t in self.texts]

    @cached_property
    def ids(self) -> pa.Array:
        return pa.array([d.hexdigest() for d in self._digests], pa.string())

    @cached_property
    def binary(self) -> pa.Array:
        return pa.array([d.digest() for d in self._digests], pa.binary())

    @cached_property
    def rank(self) -> np.ndarray:
        """The place of each set's id among all."""
        words = np.frombuffer(b"".join(d.digest() for d in self._digests), ">u4").reshape(-1, 5)
        rank = np.empty(self.size, np.int64)
        rank[np.lexsort(words.T[::-1])] = np.arange(self.size)
        return rank

    def named(self, which: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(which))

    @cached_property
    def freq(self) -> np.ndarray:
        return np.bincount(self.rep, self.rows.column("freq").to_numpy(), self.size)

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimal elements with their supersets."""
        inner = np.zeros(self.size, bool)
        inner[self.sup] = True
        least = ~inner[self.sub]
        return self.sub[least], self.sup[least]

    @cached_property
    def label(self) -> np.ndarray:
        """For each set the one with the least id of its component."""
        to, (a, b) = np.arange(self.size), (self.rank[x] for x in self.edges)
        while True:
            near, new = np.minimum(to[a], to[b]), to.copy()
            np.minimum.at(new, to[a], near)
            np.minimum.at(new, to[b], near)
            while (new[new] != new).any():
                new = new[new]
            if (new == to).all():
                return np.argsort(self.rank)[to[self.rank]]
            to = new

    @cached_property
    def direct(self) -> tuple[np.ndarray, np.ndarray]:
        """Inclusions with no set in between."""
        far = self.steps(self.sub, self.sup, self.sub, self.sup)
        near = ~np.isin(self.sub * self.size + self.sup, far)
        return self.sub[near], self.sup[near]

    def steps(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """a * size + d, once each, where a to b goes on from c to d."""
        order = np.argsort(c, kind="stable")
        at = np.searchsorted(c[order], np.arange(self.size + 1))
        who, nth = _spread((at[1:] - at[:-1])[b])
        return np.unique(a[who] * self.size + d[order[at[b][who] + nth]])

    def minels_of(self) -> pa.ListArray:
        """The sorted ids of each set's minimal elements."""
        a, b = self.edges
        order = np.lexsort((self.rank[a], b))
        at = np.searchsorted(b[order], np.arange(self.size + 1))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), self.named(a[order]))

    @cached_property
    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        car = self.freq + np.bincount(self.sub, self.freq[self.sup], self.size)
        a, b = self.direct
        ratio = lambda x, y: np.where(y == 0, 0.0, x / np.where(y == 0, 1.0, y))
        own = np.arange(self.size)
        return np.r_[a, own], np.r_[b, own], np.r_[ratio(car[b], car[a]), ratio(self.freq, car)]

    def known(self) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The mentions that have a gold id: their sets and gold ids."""
        gold = self.rows.column("gold_id").combine_chunks()
        has = gold.is_valid()
        return self.rep[has.to_numpy(zero_copy_only=False)], gold.filter(has).dictionary_encode()


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows of small columns, and how often each occurs."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = code * (int(c.max()) + 1 if len(c) else 1) + c
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return *(c[first] for c in columns), count


def _minels(o: Order) -> list:
    return [o.named(np.unique(o.edges[0]))]


def _minel_edges(o: Order) -> list:
    return [o.named(x) for x in o.edges]


def _shares(o: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many minimal elements each set has, how many supersets each has, and how many of these are shared."""
    a, b = o.edges
    shared = np.bincount(b, minlength=o.size)
    return shared, np.bincount(a, minlength=o.size), np.bincount(a[shared[b] > 1], minlength=o.size)


def _minel_stats(o: Order) -> list:
    _, every, multi = _shares(o)
    who = np.flatnonzero(every)
    every, multi = every[who], multi[who]
    return [o.named(who), every, multi, every - multi, multi / every]


def _cut(o: Order, most: int) -> list:
    (a, b), (shared, _, multi) = o.edges, _shares(o)
    keep = ~((multi[a] > most) & (shared[b] > 1))
    return [o.named(a[keep]), o.named(b[keep])]


def _concat(o: Order) -> list:
    lists = o.minels_of()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    who = np.flatnonzero(n)
    return [o.named(who), pc.binary_join(lists.take(pa.array(who)), ","), n[who]]


def _combinations(o: Order) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, pa.DictionaryArray]:
    lists = o.minels_of()
    comb = pc.if_else(pc.equal(lists.value_lengths(), 0), o.ids, pc.binary_join(lists, ",")).dictionary_encode()
    rep, gold = o.known()
    return *_groups(comb.indices.to_numpy()[rep].astype(np.int64), gold.indices.to_numpy().astype(np.int64)), comb, gold


def _minel_combinations(o: Order) -> list:
    c, g, count, comb, gold = _combinations(o)
    return [gold.dictionary.take(pa.array(g)), comb.dictionary.take(pa.array(c)), count]


def _combination_totals(o: Order) -> list:
    c, _, count, comb, _ = _combinations(o)
    size, tp = (np.bincount(c, w, len(comb.dictionary)) for w in (count, count * count))
    size, tp = size[size > 0], tp[size > 0]
    return [[int(tp.sum())], [int((size * size).sum())], [float((tp / (size * size)).sum())], [len(size)]]


def _components(o: Order) -> list:
    return [o.ids, o.named(o.label)]


def _sizes(o: Order) -> list:
    who, size = np.unique(o.label, return_counts=True)
    return [o.named(who), size]


def _size_counts(o: Order) -> list:
    return [*np.unique(np.unique(o.label, return_counts=True)[1], return_counts=True)]


def _documents(o: Order) -> list:
    lists = o.minels_of()
    lists = pc.if_else(pc.equal(lists.value_lengths(), 0), pa.scalar(None, lists.type), lists)
    return [o.ids, o.named(o.label), np.bincount(o.label, minlength=o.size)[o.label], lists]


def _direct(o: Order) -> list:
    return [o.named(x) for x in o.direct]


def _weights(o: Order) -> list:
    a, b, w = o.weights
    return [o.named(a), o.named(b), w]


def _parents(o: Order) -> list:
    a, b, w = (x[: len(o.direct[0])] for x in o.weights)
    order = np.lexsort((o.rank[a], w, b))
    last = order[np.flatnonzero(np.r_[b[order][1:] != b[order][:-1], True][: len(order)])]
    return [o.named(b[last]), o.named(a[last])]


def _levels(o: Order) -> list:
    down, up = o.direct
    now = seen = np.unique(up * o.size + down)
    level = np.ones(len(seen), np.int32)
    while len(now):
        now = o.steps(now // o.size, now % o.size, up, down)
        now = now[~np.isin(now, seen)]
        seen, level = np.r_[seen, now], np.r_[level, np.full(len(now), level[-1] + 1, np.int32)]
    return [o.named(seen // o.size), o.named(seen % o.size), level]


def _node_levels(o: Order) -> list:
    a, b = o.direct
    level = np.zeros(o.size, np.int32)
    while True:
        new = level.copy()
        np.maximum.at(new, b, level[a] + 1)
        if (new == level).all():
            return [o.ids, level]
        level = new


def _labelled(o: Order) -> list:
    rows = o.rows.filter(pc.is_valid(o.rows.column("gold_id")))
    rep, _ = o.known()
    return [rows.column("mention_id"), rows.column("gold_id"), o.named(rep), o.named(o.label[rep])]


def _cells(o: Order) -> list:
    """Mentions by label, set and gold id, with those of the label and of the label and gold id; labels and sets numbered within the block."""
    rep, gold = o.known()
    rep, g, count = _groups(rep, gold.indices.to_numpy().astype(np.int64))
    label = o.label[rep]
    _, both = np.unique(label * (len(gold.dictionary) + 1) + g, return_inverse=True)
    nl, nc = (np.bincount(x, count)[x].astype(np.int64) if len(x) else count for x in (label, both))
    return [label, rep, gold.dictionary.take(pa.array(g)), count, nl, nc]


def _gold_labels(o: Order) -> list:
    rep, gold = o.known()
    label, g, _ = _groups(o.label[rep], gold.indices.to_numpy().astype(np.int64))
    return [gold.dictionary.take(pa.array(g)), o.binary.take(pa.array(label))]


def _totals(o: Order) -> list:
    """Of labels the pairs, those with the same gold id and the mentions; labels and sets of one mention."""
    rep, gold = o.known()
    label, _, count = _groups(o.label[rep], gold.indices.to_numpy().astype(np.int64))
    size = np.bincount(label, count, o.size).astype(np.int64)
    return [[int(x)] for x in ((size * size).sum(), (count * count).sum(), count.sum(), (size == 1).sum(), (np.bincount(rep, minlength=o.size) == 1).sum())]


_EDGES = "minel string, rep_id string"
#: What can be made, its columns, and what it needs of the mentions beside key and text.
KINDS: dict[str, tuple[Callable[..., list], str, str]] = {
    "minels": (_minels, "minel string", ""),
    "minel_edges": (_minel_edges, _EDGES, ""),
    "minel_stats": (_minel_stats, "minel string, any long, multi long, single long, prob double", ""),
    "cut_overconnected": (_cut, _EDGES, ""),
    "group_concat_minels": (_concat, "rep_id string, minels string, n long", ""),
    "minel_combinations": (_minel_combinations, "gold_id string, comb string, freq long", "gold_id"),
    "combination_totals": (_combination_totals, "tp long, p long, ratio double, blocks long", "gold_id"),
    "components": (_components, "rep_id string, label string", ""),
    "sizes": (_sizes, "label string, size long", ""),
    "size_counts": (_size_counts, "size long, components long", ""),
    "documents": (_documents, "rep_id string, label string, size long, min_els array<string>", ""),
    "direct_edges": (_direct, "sub string, sup string", ""),
    "weights": (_weights, "sub string, sup string, weight double", "freq"),
    "spanning_parents": (_parents, "sup string, parent string", "freq"),
    "levels": (_levels, "rep_id string, general string, level int", ""),
    "node_levels": (_node_levels, "rep_id string, level int", ""),
    "labelled": (_labelled, "mention_id string, gold_id string, rep_id string, label string", "mention_id gold_id"),
    "cells": (_cells, "label long, rep_id long, gold_id string, c long, nl long, nc long", "gold_id"),
    "gold_labels": (_gold_labels, "gold_id string, label binary", "gold_id"),
    "totals": (_totals, "p long, tp long, used long, labels long, reps long", "gold_id"),
}


def _made(kind: str, args: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make, schema, _ = KINDS[kind]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    base = TaskContext.get().partitionId() << 40
    for table in _tables(batches):
        order = Order(table)
        columns = make(order, *args)
        if kind == "cells":  # numbers that are different in all blocks
            columns[:2] = [x + base for x in columns[:2]]
            base += order.size
        out = pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)
        yield from out.combine_chunks().to_batches(max_chunksize=BLOCK)


def by_list(mentions: DataFrame, kind: str, *args) -> DataFrame:
    """``kind`` of KINDS for all lists of ``mentions``, which must be dealt by key already.

    ``mentions`` has key, the list; text, the set's sorted features joined by UNIT, which determines
    the key; and freq, gold_id or mention_id where the kind needs them. No key is null, no set empty.
    """
    dealt = mentions.select("key", "text", *KINDS[kind][2].split()).sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_made, kind, args), KINDS[kind][1])
