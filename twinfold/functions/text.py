"""Column expressions for mention building; all built-in, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def publication_year(date: Column) -> Column:
    """The part before the first hyphen, if it is four characters and a number."""
    first = F.split_part(date, F.lit("-"), F.lit(1))
    return F.when(F.length(first) == 4, first.try_cast("int"))


def year_windows(year: Column) -> tuple[Column, Column]:
    """Two overlapping windows: neighbouring years share one."""
    text = lambda y: y.cast("string")
    return F.concat(text(year - 1), text(year)).cast("int"), F.concat(text(year), text(year + 1)).cast("int")


def windows(items: Column, n: int) -> Column:
    """All runs of n neighbours of an array; none of a shorter one or of null."""
    starts = lambda a: F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
    # bound as an element first: a lambda evaluates what it closes over again for each window
    bound = F.transform(F.array(items), lambda a: F.transform(starts(a), lambda i: F.slice(a, i, n)))
    return F.element_at(bound, 1)


def sliding(text: Column, n: int) -> Column:
    """All substrings of n characters; none of a shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def char_ngrams(text: Column, n: int, by_word: bool = False) -> Column:
    """Lower-cased character n-grams, spaces as underscores; with ``by_word`` none crosses a space."""
    low = F.lower(text)
    if by_word:
        return F.flatten(F.transform(F.split(low, " "), lambda w: sliding(w, n)))
    return sliding(F.replace(low, F.lit(" "), F.lit("_")), n)


def words(text: Column, stopwords: Column | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return found if stopwords is None else F.filter(found, lambda w: ~F.array_contains(stopwords, w))


def word_bigrams(sections: Column) -> Column:
    """Of each section (an array of words) the adjacent pairs, or its only word; distinct, in order."""
    pairs = F.transform(sections, lambda s: F.when(F.size(s) == 1, s).otherwise(F.transform(windows(s, 2), lambda p: F.array_join(p, " "))))
    return F.array_distinct(F.flatten(pairs))


def sections(text: Column, divider: str = r"[.:;!?()|\n]") -> Column:
    """Words between dividers, without empty sections."""
    parts = F.transform(F.split(F.lower(text), divider), lambda p: F.regexp_extract_all(p, F.lit(r"([\p{L}\p{N}_]+)"), 1))
    return F.filter(parts, lambda p: F.size(p) > 0)


def budget(authors: Column, terms: Column, cells: int = 24, least: int = 9, shared: int = 18) -> Column:
    """Author features up to what terms leave, terms likewise, overflow terms in the rest."""
    a = F.slice(authors, 1, F.greatest(F.lit(least), shared - F.size(terms)))
    t = F.slice(terms, 1, F.greatest(F.lit(least), shared - F.size(authors)))
    rest = F.slice(terms, F.size(t) + 1, F.greatest(F.lit(0), cells - F.size(a) - F.size(t)))
    return F.slice(F.concat(a, t, rest), 1, cells)


def prefix_similarity(a: Column, b: Column) -> Column:
    """Length of the shorter over the longer if one begins with the other, else 0."""
    return F.when(F.startswith(a, b) | F.startswith(b, a), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def ascii_fold(text: Column) -> Column:
    """Latin letters with marks to plain letters; everything else that isn't ASCII goes."""
    # Pairs of letters, in the order of their code points.
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
    folded = F.translate(F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("Æ"), F.lit("AE")), marked, plain)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def serialise(features: Column) -> Column:
    """``group: {a,b}`` lines of a feature array, by group."""
    groups = F.array_distinct(F.transform(features, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
    line = lambda g: F.concat(g, F.lit(": {"), F.array_join(F.transform(F.filter(features, lambda x: F.startswith(x, F.concat(g, F.lit(":")))), lambda x: F.substring_index(x, ":", -1)), ","), F.lit("}"))
    return F.array_join(F.transform(groups, line), "\n")
