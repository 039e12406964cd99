"""Arrow-batched functions for what built-in expressions can't say."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# Fixed values of the name grammar: particles, names of nobody, marks that mean nothing.
PARTICLES = ("de", "del", "di", "de la", "von", "van", "della")
NOBODY = re.compile(r".*anonym|.*unknown|\s*-")
_DROP = re.compile(r"[1-9!\"#$%&'()*+/:;<=>?@\[\]\\^_`{|}~]")
_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"})

# Types are objects: a worker that imports this has no session to parse strings with.
AUTHOR = StructType([StructField(c, StringType()) for c in ("surname", "init", "first")])


def folded(text: str) -> str:
    """Latin letters without their marks; what then isn't ASCII goes."""
    return unicodedata.normalize("NFKD", text.translate(_LETTERS)).encode("ascii", "ignore").decode()


def split_author(name: str | None, least_first: int = 3) -> tuple[str | None, str | None, str | None]:
    """(surname, initial, first name) as written: ``Surname, First`` or ``First Surname``.

    A first name needs ``least_first`` letters and no single letter before a
    hyphen. Where a particle leads the first names, all but the last of them are
    the surname (``Berg, van der Jan``). Of two parts the single letter is the first name.
    """
    text = _DROP.sub("", folded(name or "")).strip(" \t\r\n,")
    if "," in text:
        last, given = (x.strip() for x in text.split(",")[:2])
    else:
        given, _, last = text.rpartition(" ")
    last, tokens = last.lower(), given.lower().replace(".", " ").split()
    first, init = tokens[0] if tokens and len(tokens[0]) >= least_first else None, tokens[0][0] if tokens else None
    if first and "-" in first:
        parts = [x for x in first.split("-") if x]
        if not parts:
            first = None
        elif len(parts[0]) == 1:
            first, init = None, parts[0]
    if first in PARTICLES:
        n = 0
        while n < len(tokens) - 1 and len(tokens[n]) > 1:
            n += 1
        last, tokens = " ".join(tokens[:n]), tokens[n:]
        first = tokens[0] if len(tokens[0]) >= least_first else None
        init = first[0] if first else None
    if first and len(last) == 1:
        last, first, init = first, last, last
    return last or None, init, first


def finish_author(last: str | None, init: str | None, first: str | None) -> tuple[str | None, str | None, str | None]:
    """A surname with dots is the first name; of several words the last counts; names of nobody are none."""
    if last and "." in last:
        bare = last.replace(".", "")
        last, init, first = first, bare[:1] or None, bare if len(bare) > 2 else None
    if last and last.split():
        last = last.split()[-1]
    return tuple(None if not x or NOBODY.match(x) else x for x in (last, init, first))


def parse_author(name: str | None, least_first: int = 3) -> tuple[str | None, str | None, str | None]:
    """``split_author`` and ``finish_author``, without a look at how frequent names are."""
    return finish_author(*split_author(name, least_first))


def _authors(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["surname", "init", "first"], dtype=object)


@F.pandas_udf(AUTHOR)
def parse_authors(names: pd.Series) -> pd.DataFrame:
    return _authors([parse_author(n) for n in names])


@F.pandas_udf(AUTHOR)
def split_authors(names: pd.Series) -> pd.DataFrame:
    return _authors([split_author(n) for n in names])


@F.pandas_udf(AUTHOR)
def finish_authors(names: pd.DataFrame) -> pd.DataFrame:
    clean = names.astype(object).where(names.notna(), None)
    return _authors([finish_author(*row) for row in clean[["surname", "init", "first"]].itertuples(index=False)])


def fnv1a64(values: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a hashes, one array step for each byte position."""
    out = np.full(len(values), 14695981039346656037, np.uint64)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    if not len(values):
        return out
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    data = np.zeros((len(values), max(1, int(lengths.max()))), np.uint8)
    for row, i in enumerate(order):
        data[row, : lengths[i]] = np.frombuffer(values[i], np.uint8)
    state = out.copy()
    for j in range(int(lengths.max())):
        live = int(np.searchsorted(-sorted_lengths, -j, side="left"))
        state[:live] = (state[:live] ^ data[:live, j].astype(np.uint64)) * np.uint64(1099511628211)
    out[order] = state
    return out


@F.pandas_udf(LongType())
def fnv1a(values: pd.Series) -> pd.Series:
    """The hash's bits as a signed number; null stays null."""
    hashed = fnv1a64([v.encode() if isinstance(v, str) else b"" for v in values]).astype(np.int64)
    return pd.Series(hashed, index=values.index, dtype="Int64").mask(values.isna())


@F.pandas_udf(LongType())
def simhash(features: pd.Series) -> pd.Series:
    """Bitwise majority of a set's feature hashes; a tie is a one, the empty set has all ones."""
    sizes = [0 if f is None else len(f) for f in features]
    flat = fnv1a64([x.encode() for f in features if f is not None for x in f])
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits, axis=0)]) if len(flat) else np.zeros((1, 64), np.int64)
    ones = sums[ends] - sums[ends - sizes]
    majority = 2 * ones >= np.asarray(sizes)[:, None]
    packed = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0] if len(sizes) else np.empty(0, np.uint64)
    return pd.Series(packed.astype(np.int64), index=features.index)


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, none edited twice (optimal string alignment)."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], index=a.index, dtype="Int32")


def edits(word: str, known: set[str]) -> str:
    """The nearest known word within a fifth of the length, four at most; the word itself if none."""
    limit = min(4, len(word) // 5)
    if word in known or not limit:
        return word
    near = min(((osa(word, k), k) for k in known if abs(len(k) - len(word)) <= limit), default=(limit + 1, word))
    return near[1] if near[0] <= limit else word


def split_compound(word: str, known: set[str], link: str = "s", least: int = 3) -> list[str]:
    """Known words that make up a compound, a linking letter between them allowed; the word itself if there is no way."""
    if word in known:
        return [word]
    for i in range(len(word) - least, least - 1, -1):
        head = word[:i]
        base = head if head in known else head[: -len(link)] if head.endswith(link) and head[: -len(link)] in known else None
        if base:
            rest = split_compound(word[i:], known, link, least)
            if len(rest) > 1 or rest[0] in known:
                return [base, *rest]
    return [word]
