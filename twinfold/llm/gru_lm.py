"""LM scoring by a gated recurrent language model in numpy (operator 9).

Tokens are words in lower case and one end for each document. The counts of all
training tokens come first: they give the base score, the vocabulary and the
start of the model. The ``WORDS`` most frequent words are outputs of their own;
all others fall into ``BUCKETS`` by their ending and are scored within it by
their counts, so the model is a distribution over all texts: unseen words share
one place in each bucket.

The network is one GRU layer whose output softmax is factored into equal
classes of neighbouring frequency. It is trained by truncated backpropagation
over windows of ``STEPS`` tokens, state carried from window to window, on every
training document once: the documents are dealt to ``SHARES`` rounds; in each,
every task starts from the same weights and trains on its own part, and the
weights' mean, by tokens, starts the next. Scoring carries the state through
whole documents of any length.

Sizes that don't grow with the data: the weights, and the ``SEND_WORDS`` most
frequent words' counts, which are sent to every task; rarer words meet their
counts in a join.

Defined results: a null or empty text is an end alone; a null id counts as empty
text for the fold; null and repeated ids each keep their rows; an empty table
gives no rows; without training tokens all counts are 0; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, raw_bytes, save, slices
from .wordhash import Runs, chunks

END = b"\n"
WORDS, BUCKETS = 991, 32
CLASSES, IN_CLASS = 32, 32
HIDDEN = 16
STEPS = 20
LANES = 512
#: Documents and tokens that a task scores at a time.
TOGETHER = 16_384, 8_000_000
SHARES = (1, 3, 4)
SEND_WORDS = 100_000
RATE = 0.01
_CHUNKS = 64


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all training documents, the end among them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in slices(batches, 1024):
            ids = batch.column("doc_id").to_pylist()
            own = [text.lower() for doc, text in zip(ids, raw_bytes(batch.column("text")), strict=True) if not held_out(doc)]
            seen[END] += len(own)
            for lo, hi in chunks(own, 1 << 20):
                words, again = Runs(own[lo:hi], whole=True).different()
                for word, n in zip(words, np.bincount(again, minlength=len(words)).tolist(), strict=True):
                    seen[word] += n
            if len(seen) > 300_000:
                yield flush()
        if seen:
            yield flush()

    return id_and_text(docs).mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """What every task gets: the frequent words' counts, the totals, and the buckets' masses."""

    def __init__(self, common: list[tuple[bytes, int]], tokens: int, types: int, end: int, mass: list[float]):
        common = sorted((x for x in common if x[0] != END), key=lambda x: (-x[1], x[0]))
        self.words = [w for w, _ in common]
        self.index = {w: i for i, w in enumerate(self.words)}
        counts = np.asarray([n for _, n in common], float)
        self.log_count = np.log10(counts + 0.5)
        self.tokens, self.types, self.end = tokens, types, end
        self.log_end = math.log10(end + 0.5)
        self.log_all = math.log10(tokens + 0.5 * (types + 1))
        self.log_mass = np.log10(np.asarray(mass))
        first = counts[:WORDS]
        start = np.full(CLASSES * IN_CLASS, 0.5)
        start[0] += end
        start[1 : 1 + BUCKETS] = mass
        start[1 + BUCKETS : 1 + BUCKETS + len(first)] += first
        self.start = start
        # output of each frequent word: its own, or its bucket's
        self.output = np.asarray([1 + BUCKETS + i if i < WORDS else 1 + bucket(w) for i, w in enumerate(self.words)], np.uint16)


def lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("end")).first()
    level = F.floor(F.log2("n") * 64)
    by_level = {r.level: r.types for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("types")).collect()}  # at most 64 for each doubling
    room, least = SEND_WORDS, None
    for x in sorted(by_level, reverse=True):
        if by_level[x] > room:
            break
        room, least = room - by_level[x], x
    common = [] if least is None else [(bytes(r.word), r.n) for r in counts.where(level >= least).collect()]
    outputs = sorted((x for x in common if x[0] != END), key=lambda x: (-x[1], x[0]))[:WORDS]
    own = counts.sparkSession.createDataFrame([(w,) for w, _ in outputs] or [(END,)], "word binary")
    rest = counts.where(F.col("word") != F.lit(END)).join(F.broadcast(own), "word", "left_anti")  # WORDS rows are sent
    sums = {r.b: r.m for r in rest.groupBy(F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).alias("b")).agg(F.sum(F.col("n") + 0.5).alias("m")).collect()}
    return Lexicon(common, total.tokens or 0, total.types, total.end, [sums.get(b, 0.0) + 0.5 for b in range(BUCKETS)])


def _encoded(lex: Lexicon, docs: pa.Array, texts: list[bytes], row: int) -> pa.RecordBatch:
    """Rows of some lower-cased texts; each different word is looked up once."""
    runs = Runs(texts, whole=True)
    words, again = runs.different()
    find, n = lex.index.get, len(texts)
    at = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
    known = at >= 0
    output = np.fromiter((1 + bucket(w) if i < 0 else 0 for w, i in zip(words, at.tolist(), strict=True)), np.uint16, len(words))
    output[known] = lex.output[at[known]]
    inside = (output >= 1) & (output <= BUCKETS)
    count = np.zeros(len(words))
    count[known] = lex.log_count[at[known]]
    within = np.where(inside, count, 0)
    within[inside] -= lex.log_mass[output[inside] - 1]
    doc = np.repeat(np.arange(n), np.diff(runs.first))
    total = lambda values: np.bincount(doc, weights=values[again], minlength=n)
    size = np.diff(runs.first) + 1
    ids = output[again]
    streams = [ids[a:b].tobytes() + b"\0\0" for a, b in zip(runs.first[:-1].tolist(), runs.first[1:].tolist(), strict=True)]
    some = np.flatnonzero(~known[again])
    pair, times = np.unique(doc[some] * len(words) + again[some], return_counts=True)
    offsets = pa.array(np.searchsorted(pair, np.arange(n + 1) * max(1, len(words))), pa.int32())
    rare = pa.array([words[i] for i in (pair % max(1, len(words))).tolist()], pa.binary())
    columns = [
        pa.array(np.arange(row, row + n)), docs, pa.array([held_out(d) for d in docs.to_pylist()], pa.bool_()), pa.array(size), pa.array(total(known).astype(np.int64) + int(lex.end > 0)),
        pa.array(total(count) + lex.log_end - size * lex.log_all), pa.array(total(within)), pa.array(streams, pa.binary()),
        pa.ListArray.from_arrays(offsets, rare), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENCODED.split(", ")])


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_common long, base double, within double, ids binary, rare array<binary>, times array<int>"


def encode(docs: DataFrame, sent) -> DataFrame:
    """Each document's outputs, its sums over frequent words, and its rarer words with their counts in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1024):
            texts = [t.lower() for t in raw_bytes(batch.column("text"))]
            for lo, hi in chunks(texts, 1 << 20):
                yield _encoded(lex, batch.column("doc_id").slice(lo, hi - lo), texts[lo:hi], row)
                row += hi - lo

    return id_and_text(docs).mapInArrow(each, ENCODED)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """The network: ``E`` input projections by token, ``U`` recurrent weights, ``C`` and ``c`` the classes, ``O`` and ``o`` the outputs within each class."""

    SHAPES = {
        "E": (CLASSES * IN_CLASS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES), "c": (CLASSES,),
        "O": (CLASSES, HIDDEN, IN_CLASS), "o": (CLASSES, IN_CLASS),
    }

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def initial(cls, start: np.ndarray, seed: int = 1) -> Gru:
        """Before training it gives the tokens' shares, whatever came before."""
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in cls.SHAPES.items()}
        w["C"] *= 0.1
        w["O"] *= 0.1
        share = (start / start.sum()).reshape(CLASSES, IN_CLASS)
        w["c"] = np.log(share.sum(1)).astype(np.float32)
        w["o"] = np.log(share).astype(np.float32)
        w["E"][:, HIDDEN : 2 * HIDDEN] += 1  # a new state keeps much of the old one
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Gru:
        w, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = math.prod(s)
            w[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(w)

    def forward(self, x: np.ndarray, h: np.ndarray):
        """States after each of x's columns; a document's first input is an end, before which the state is cleared."""
        e, u, n = self.w["E"], self.w["U"], HIDDEN
        kept, states = [], np.empty((x.shape[1], len(x), n), np.float32)
        for t in range(x.shape[1]):
            live = (x[:, t] != 0)[:, None]
            before = h * live
            g, a = e[x[:, t]], before @ u
            gates = _sigmoid(g[:, : 2 * n] + a[:, : 2 * n])
            r, z, inner = gates[:, :n], gates[:, n:], a[:, 2 * n :]
            new = np.tanh(g[:, 2 * n :] + r * inner)
            h = new + z * (before - new)
            kept.append((live, before, r, z, inner, new))
            states[t] = h
        return states, kept

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """Natural log probabilities of y after states h; with ``grad`` also the loss's gradient at h.

        Classes and words stand in rows, tokens in columns: sums and maxima over rows run along memory.
        """
        c, o = self.w["C"], self.w["O"]
        k, within = y // IN_CLASS, y % IN_CLASS
        order = np.argsort(k, kind="stable")
        h, k, within = h[order], k[order], within[order]
        every = np.arange(len(y))
        logits = c.T @ h.T + self.w["c"][:, None]
        logits -= logits.max(axis=0)
        logp = logits[k, every]
        p = np.exp(logits, out=logits)
        total = p.sum(axis=0)
        logp -= np.log(total)
        if grad is not None:
            p /= total
            p[k, every] -= 1
            grad["C"], grad["c"] = (p @ h).T, p.sum(axis=1)
            dh = p.T @ c.T
            grad["O"], grad["o"] = np.zeros_like(o), np.zeros_like(self.w["o"])
        cut = np.searchsorted(k, np.arange(CLASSES + 1)).tolist()
        for i in range(CLASSES):
            lo, hi = cut[i], cut[i + 1]
            if lo == hi:
                continue
            q = o[i].T @ h[lo:hi].T + self.w["o"][i][:, None]
            q -= q.max(axis=0)
            own, at = within[lo:hi], every[: hi - lo]
            logp[lo:hi] += q[own, at]
            e = np.exp(q, out=q)
            s = e.sum(axis=0)
            logp[lo:hi] -= np.log(s)
            if grad is not None:
                e /= s
                e[own, at] -= 1
                grad["O"][i], grad["o"][i] = (e @ h[lo:hi]).T, e.sum(axis=1)
                dh[lo:hi] += (o[i] @ e).T
        back = np.empty_like(order)
        back[order] = every
        return (logp[back], dh[back]) if grad is not None else logp[back]

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Truncated backpropagation over one window: mean gradients, the last state, the summed log probability."""
        n, (lanes, steps) = HIDDEN, x.shape
        states, kept = self.forward(x, h)
        grad: dict[str, np.ndarray] = {}
        logp, dh = self.outputs(states.reshape(-1, n), y.T.ravel(), grad)
        dh = dh.reshape(steps, lanes, n)
        u, du = self.w["U"], np.zeros_like(self.w["U"])
        dg = np.empty((steps, lanes, 3 * n), np.float32)
        back = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            live, before, r, z, inner, new = kept[t]
            d = dh[t] + back
            dnew = d * (1 - z) * (1 - new * new)
            dg[t, :, 2 * n :] = dnew
            dg[t, :, :n] = dnew * inner * r * (1 - r)
            dg[t, :, n : 2 * n] = d * (before - new) * z * (1 - z)
            da = dg[t].copy()
            da[:, 2 * n :] *= r
            du += before.T @ da
            back = (d * z + da @ u.T) * live
        grad["U"] = du
        flat, token = dg.reshape(-1, 3 * n), x.T.ravel()
        order = np.argsort(token, kind="stable")
        some, cut = np.unique(token[order], return_index=True)
        grad["E"] = np.zeros_like(self.w["E"])
        grad["E"][some] = np.add.reduceat(flat[order], cut)
        scale = np.float32(1 / y.size)
        return {k: g * scale for k, g in grad.items()}, states[-1], float(logp.sum())

    def train(self, stream: np.ndarray, rate: float = RATE) -> float:
        """One pass over a stream of documents, each closed by its end, in lanes; returns the mean log probability (Adam's moments start anew)."""
        lanes = max(1, min(LANES, len(stream) // (STEPS * 40)))
        steps = -(-len(stream) // lanes)
        padded = np.zeros(lanes * steps, np.int64)  # a short last lane goes on with ends
        padded[: len(stream)] = stream
        y = padded.reshape(lanes, steps)
        x = np.concatenate([np.zeros((lanes, 1), np.int64), y[:, :-1]], axis=1)
        h = np.zeros((lanes, HIDDEN), np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        total, turn = 0.0, 0
        for a in range(0, steps, STEPS):
            grad, h, logp = self.gradients(x[:, a : a + STEPS], y[:, a : a + STEPS], h)
            total, turn = total + logp, turn + 1
            step = rate * math.sqrt(1 - 0.99**turn) / (1 - 0.9**turn) * min(1.0, turn / 10)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= np.float32(step) * m[k] / (np.sqrt(v[k]) + np.float32(1e-6))
        return total / max(1, len(stream))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each whole document. Documents are laid end to
        end in lanes of about equal length; the state goes on from window to
        window and is cleared where the next document begins."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        lanes: list[list[int]] = [[] for _ in range(min(LANES, len(docs)))]
        load = [(0, i) for i in range(len(lanes))]
        heapify(load)
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, i = load[0]
            lanes[i].append(d)
            heapreplace(load, (n + len(docs[d]), i))
        lanes.sort(key=lambda own: -sum(len(docs[d]) for d in own))
        length = np.asarray([sum(len(docs[d]) for d in own) for own in lanes])
        begin = np.cumsum(length) - length
        order = [d for own in lanes for d in own]
        flat = np.concatenate([docs[d] for d in order])
        owner = np.repeat(order, [len(docs[d]) for d in order])
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        before = np.zeros((len(lanes), 1), np.int64)
        for a in range(0, length[0], STEPS):
            active = int(np.searchsorted(-length, -a, side="left"))  # lanes with tokens from a on
            at = np.arange(a, min(a + STEPS, length[0]))
            real = at < length[:active, None]
            place = begin[:active, None] + np.minimum(at, length[:active, None] - 1)
            own = np.where(real, flat[place], 0).astype(np.int64)
            x = np.concatenate([before[:active], own[:, :-1]], axis=1)
            states, _ = self.forward(x, h[:active])
            h[:active], before[:active] = states[-1], own[:, -1:]
            logp = self.outputs(states.reshape(-1, HIDDEN), own.T.ravel())
            real = real.T.ravel()
            out += np.bincount(owner[place.T.ravel()[real]], weights=logp[real].astype(float), minlength=len(docs))
        return out / math.log(10)


def _round(encoded: DataFrame, sent, share: tuple[int, int]) -> np.ndarray | None:
    """Train every task's part of a round from the sent weights; the mean of the results by tokens."""
    part = F.pmod(F.xxhash64("row"), F.lit(sum(SHARES)))
    own = encoded.where(~F.col("held_out") & (part >= share[0]) & (part < share[1])).select("ids")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = [np.frombuffer(x, np.uint16) for batch in batches for x in batch.column(0).to_pylist()]
        if not streams:
            return
        stream = np.concatenate(streams)
        gru = Gru.from_flat(sent.value.copy())
        gru.train(stream)
        pieces = np.array_split(gru.flat() * np.float32(len(stream)), _CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([len(stream)] * _CHUNKS, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in pieces], pa.binary())], names=["chunk", "tokens", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tokens: Counter[int] = Counter()
        for batch in batches:
            for chunk, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, "<f4").astype(np.float64)
                tokens[chunk] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([(s / tokens[c]).tobytes() for c, s in sums.items()], pa.binary())], names=["chunk", "mean"])

    trained = own.mapInArrow(train, "chunk int, tokens long, sums binary")
    means = trained.repartition(_CHUNKS, "chunk").mapInArrow(add, "chunk int, mean binary").collect()  # the weights, once
    return np.concatenate([np.frombuffer(r.mean, np.float64) for r in sorted(means, key=lambda r: r.chunk)]).astype(np.float32) if means else None


def fit(encoded: DataFrame, start: np.ndarray) -> np.ndarray:
    context, flat, low = encoded.sparkSession.sparkContext, Gru.initial(start).flat(), 0
    for share in SHARES:
        better = _round(encoded, context.broadcast(flat), (low, low + share))
        flat, low = flat if better is None else better, low + share
    return flat


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, the base score and the model's log10 probability of the text."""
    context = docs.sparkSession.sparkContext
    counts = save(count_words(docs), "counts")
    lex = lexicon(counts)
    sent = context.broadcast(lex)
    encoded = save(encode(docs, sent), "encoded")
    weights = context.broadcast(fit(encoded, lex.start))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru = Gru.from_flat(weights.value)
        held: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            scores, at = gru.score(texts), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores[at : at + b.num_rows])], names=[*b.schema.names, "model"])
                at += b.num_rows
            held.clear()
            texts.clear()

        for batch in slices(batches, 1024):
            at = batch.schema.get_field_index("ids")
            held.append(batch.select(range(at)))
            texts += [np.frombuffer(x, np.uint16) for x in batch.column(at).to_pylist()]
            if len(texts) >= TOGETHER[0] or sum(map(len, texts)) >= TOGETHER[1]:
                yield from done()
        if held:
            yield from done()

    head = ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "within"]
    scored = encoded.select(*head, "ids").mapInArrow(score, ENCODED.split(", ids")[0] + ", model double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + F.col("within") + logs).alias("score"),
    )
