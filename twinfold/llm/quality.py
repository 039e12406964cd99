"""Quality rules (operator 3): a short-circuit cascade.

The base statistics decide first. The other rules are ordered by what they
reject for their cost: both are measured on a bounded sample, the rule with the
most rejections a second runs first and each later rule sees only texts that
are still kept. The order changes the time, never the verdict.

Defined results: a null or empty text has no words and fails the base; null and
repeated ids each keep their rows; an empty table gives no rows; other columns
stay (``filter_documents``) or are ignored (``judge``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, raw_bytes, slices, small_batches
from .wordhash import SPACE, Words, chunks, mix

WINDOW = 8
MIN_WORDS = 20
#: Texts on which costs and rejections are measured; a bound on what the driver reads.
SAMPLE, SAMPLE_BYTES = 256, 1 << 16

_SYMBOLS = b"#*$%&|<>"
_TAIL_BYTES = bytes(range(0x80, 0xC0))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_NOT_LETTERS = bytes(b for b in range(256) if b not in _LETTERS and b not in SPACE)


def n_words(t: bytes) -> int:
    return len(t.split())


def word_chars(t: bytes) -> int:
    return len(t.translate(None, SPACE + _TAIL_BYTES))


def n_symbols(t: bytes) -> int:
    return len(t) - len(t.translate(None, _SYMBOLS))


def lines(t: bytes) -> list[bytes]:
    """Lines that have a word."""
    return [x for x in t.split(b"\n") if x.strip(SPACE)]


def n_dup_lines(t: bytes) -> int:
    own = lines(t)
    return len(own) - len(set(own))


def n_repeat_words(texts: list[bytes]) -> np.ndarray:
    """For each text, the words in windows of eight words that it has twice or more."""
    out = np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        at, key = w.shingles(WINDOW)
        if not len(at):
            continue
        key = key ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        hit = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        depth = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + WINDOW, -1)
        covered = np.cumsum(depth[:-1]) > 0
        out[lo:hi] = np.bincount(w.doc[covered], minlength=hi - lo)
    return out


def base_failed(words: int, repeat_words: int) -> bool:
    return words < MIN_WORDS or 100 * repeat_words > 30 * words


def _symbols(t: bytes, words: int) -> bool:
    return 5 * n_symbols(t) > words


def _capitals(t: bytes, words: int) -> bool:
    upper = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(t) - len(t.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def _word_length(t: bytes, words: int) -> bool:
    chars = word_chars(t)
    return chars < 2 * words or chars > 14 * words


def _repeated_lines(t: bytes, words: int) -> bool:
    own = lines(t)
    return 2 * (len(own) - len(set(own))) > len(own)


def _few_letters(t: bytes, words: int) -> bool:
    return 10 * len(t.translate(None, _NOT_LETTERS).split()) < 6 * words


Rule = Callable[[bytes, int], bool]
#: name -> rejects(text, words). Whole numbers only, so that SQL gives the same verdicts.
RULES: dict[str, Rule] = {
    "symbols": _symbols,  # over one symbol to five words
    "capitals": _capitals,  # more capitals than small letters
    "word_length": _word_length,  # mean word shorter than 2 or longer than 14 characters
    "repeated_lines": _repeated_lines,  # over half of the lines repeat an earlier one
    "few_letters": _few_letters,  # under 6 in 10 words have a letter
}


def order_rules(texts: list[bytes], rules: dict[str, Rule] = RULES) -> list[str]:
    """Rules by rejections a second on a sample, the best first; ties by name."""
    counts = [n_words(t) for t in texts]
    rejected, cost = {}, {}
    for name, rejects in rules.items():
        began = time.perf_counter()
        rejected[name] = np.fromiter((rejects(t, n) for t, n in zip(texts, counts, strict=True)), bool, len(texts))
        cost[name] = max(time.perf_counter() - began, 1e-9)
    alive, order = np.ones(len(texts), bool), []
    while len(order) < len(rules):  # a rule counts by what the ones before it leave to it
        best = min((r for r in rules if r not in order), key=lambda r: (-((rejected[r] & alive).sum() + 0.5) / cost[r], r))
        order.append(best)
        alive &= ~rejected[best]
    return order


def _sampled_order(docs: DataFrame, rules: dict[str, Rule]) -> list[str]:
    """From a random sample of ``SAMPLE`` texts of at most ``SAMPLE_BYTES`` each; the order changes no verdict."""
    some = id_and_text(docs).select("text", F.xxhash64("text").alias("h")).where(F.octet_length("text") <= SAMPLE_BYTES)
    least = [r.h for r in some.select("h").orderBy("h").limit(SAMPLE).collect()]  # numbers only
    rows = some.where(F.col("h") <= max(least, default=0)).limit(SAMPLE).collect()
    return order_rules([r.text.encode() for r in rows], rules)


def cascade(texts: list[bytes], counts: np.ndarray, alive: np.ndarray, order: list[Rule]) -> np.ndarray:
    """Which texts are kept: each rule runs on those that all before it kept."""
    alive = alive.copy()
    for rejects in order:
        for i in np.flatnonzero(alive):
            if rejects(texts[i], int(counts[i])):
                alive[i] = False
    return alive


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """One row for each document with the base statistics and the verdict."""
    order = [rules[name] for name in _sampled_order(docs, rules)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            texts = raw_bytes(batch.column("text"))
            n = len(texts)
            stats = [np.fromiter(map(f, texts), np.int64, n) for f in (n_words, word_chars, n_symbols, n_dup_lines)]
            repeat = n_repeat_words(texts)
            failed = (stats[0] < MIN_WORDS) | (100 * repeat > 30 * stats[0])
            kept = cascade(texts, stats[0], ~failed, order)
            columns = [batch.column("doc_id"), *map(pa.array, (*stats, repeat, failed, kept))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in JUDGED.split(", ")])

    return id_and_text(docs).mapInArrow(each, JUDGED)


def filter_documents(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    order = [rules[name] for name in _sampled_order(docs, rules)]
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            texts = raw_bytes(batch.column(at))
            counts = np.fromiter(map(n_words, texts), np.int64, len(texts))
            alive = counts >= MIN_WORDS
            some = [texts[i] for i in np.flatnonzero(alive)]
            alive[alive] = 100 * n_repeat_words(some) <= 30 * counts[alive]
            yield batch.filter(pa.array(cascade(texts, counts, alive, order)))

    return small_batches(docs).mapInArrow(each, docs.schema)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
b AS (
  SELECT t.doc_id, t, w, l, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 5 * n_symbols > n_words
            OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * n_dup_lines > len(l)
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-@\[-`{-\x7F]'))) < 6 * n_words) AS kept
FROM f
"""
