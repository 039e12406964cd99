"""Exact, fast whole-text encoding with public tokenizer files.

The library encodes about 1 MB of text a second. Natural text repeats its
words, so both encoders cut texts where the tokenizer itself always cuts, look
each different run up in a bounded table, and let the library's BPE model
encode only runs that are new. A word with characters outside a plain set, or a
text whose white space is unusual, goes to the library as it is, so the ids
are those of ``Tokenizer.encode(text, add_special_tokens=False)`` in every case.
That holds for the strings of added tokens too: in a text they give the added
token's id, as the library does unless told otherwise.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

from .wordhash import Runs, chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Printable ASCII and precomposed Latin letters: stable under NFC, one to one under lower-casing, and letters in every Unicode version.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]*")

#: The split patterns stated in the two tokenizer files.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that are encoded at once.
CHUNK = 1 << 20

#: White space that the byte-level pattern knows beside space and line feed.
ODD_ASCII = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_UTF8 = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class _Table:
    """run -> ids in flat arrays, found by 128 bits of hash. New runs go to a young
    table that is merged into the old one as it grows; the old one is dropped
    when it is full, so memory is bounded (about 30 bytes a run)."""

    def __init__(self, limit: int, dtype: str):
        self.limit, self.dtype = limit, dtype
        self.old, self.young = self._none(), self._none()

    def _none(self):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.empty(0, self.dtype)

    @staticmethod
    def _merged(a, b):
        place = np.searchsorted(a[0], b[0])
        columns = [np.insert(x, place, y) for x, y in zip(a[:4], (*b[:2], b[2] + np.int32(len(a[4])), b[3]), strict=True)]
        return (*columns, np.concatenate([a[4], b[4]]))

    def look_up(self, key: np.ndarray, check: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, size and the flat ids for ascending different keys; ``make(i)`` gives the ids of the i-th as bytes."""
        begin, size = np.zeros(len(key), np.int64), np.full(len(key), -1)
        base = 0
        for keys, checks, begins, sizes, flat in (self.old, self.young):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == key) & (checks[at] == check))
                begin[hit], size[hit] = begins[at[hit]] + base, sizes[at[hit]]
            base += len(flat)
        new = np.flatnonzero(size < 0)
        made = [make(i) for i in new.tolist()]
        ids = np.frombuffer(b"".join(made), self.dtype)
        size[new] = np.fromiter(map(len, made), np.int64, len(made)) // ids.itemsize
        own = np.cumsum(size[new]) - size[new]
        begin[new] = own + base
        flat = np.concatenate([self.old[4], self.young[4], ids])
        self.young = self._merged(self.young, (key[new], check[new], own.astype(np.int32), size[new].astype(np.int32), ids))
        if 8 * len(self.young[0]) > max(len(self.old[0]), self.limit // 4):
            if len(self.old[0]) + len(self.young[0]) > self.limit:
                self.old = self._none()
            self.old, self.young = self._merged(self.old, self.young), self._none()
        return begin, size, flat


class Encoder:
    """Encodes many texts at once: ``encode_all(texts) -> [ids of each]``, arrays of
    the narrowest little-endian dtype that holds the vocabulary.

    A chunk's runs are hashed together, each different run is looked up once, and
    the ids are gathered.
    """

    def __init__(self, path: str, cache: int = 1 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.tokenize = self.library.model.tokenize
        self.table = byte_chars()
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known = _Table(cache, self.dtype)

    def _by_library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def _run(self, run: bytes, lead: bool) -> bytes:
        """ids of a run and of the space before it, if it has one."""
        text = run.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text):
            return self._by_library(" " + text if lead else text)
        if self.lower:
            text = text.lower()
        return b"".join(map(self._piece, self.split.findall(" " + text if lead else text)))

    def holds_added(self, utf8: bytes) -> bool:
        """Whether the text has the string of an added token, which the library cuts out before all else."""
        return any(t in utf8 for t in self.added)

    def encode(self, utf8: bytes) -> np.ndarray:
        return self.encode_all([utf8])[0]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in chunks(texts, CHUNK):
            made = self._encode([t if self.regular(t) else None for t in texts[lo:hi]])
            out += [np.frombuffer(self._by_library(t.decode("utf-8", "replace")), self.dtype) if m is None else m for t, m in zip(texts[lo:hi], made, strict=True)]
        return out

    def _encode(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        """ids of each text but the missing ones."""
        runs = Runs([t or b"" for t in texts])
        lead, feeds, after = self.gaps(runs)
        key, check = runs.keys(lead)
        key, one, again = np.unique(key, return_index=True, return_inverse=True)
        if (check[one][again] != check).any():  # two runs of one hash: left to the library
            return [None] * len(texts)
        a, b, s = runs.start[one].tolist(), runs.end[one].tolist(), lead[one].tolist()
        begin, size, ids = self.known.look_up(key, check[one], lambda i: self._run(runs.data[a[i] : b[i]], s[i]))
        size = size[again]
        place = np.concatenate([[0], np.cumsum(feeds + size + after)])
        before = np.cumsum(size) - size
        flat = np.full(place[-1], self.feed_id, self.dtype)
        each = np.arange(size.sum())
        flat[each + np.repeat(place[:-1] + feeds - before, size)] = ids[each + np.repeat(begin[again] - before, size)]
        cut = place[runs.first].tolist()
        return [None if t is None else flat[x:y] for t, x, y in zip(texts, cut[:-1], cut[1:], strict=True)]


class WordEncoder(Encoder):
    """For the file whose tokenizer drops white space and lower-cases: any ASCII white space is a cut."""

    split = regex.compile(WORD_SPLIT)
    lower, feed_id = True, 0

    def regular(self, utf8: bytes) -> bool:
        return not self.holds_added(utf8)

    def gaps(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(len(runs.start), np.int64)
        return none.astype(bool), none, none


class ByteEncoder(Encoder):
    """For the byte-level file: a lone space or line feed between other
    characters is a cut. A run after a space carries the space; a line feed is
    a part of its own."""

    split = regex.compile(BYTE_SPLIT)
    lower = False

    def __init__(self, path: str, cache: int = 1 << 20):
        super().__init__(path, cache)
        self.feed_id = int(np.frombuffer(self._piece("\n"), self.dtype)[0])

    def regular(self, utf8: bytes) -> bool:
        """Whether every white space of the text is a lone space, or one or two line feeds, between other characters, and no added token is in it."""
        if b"  " in utf8 or b"\n " in utf8 or b" \n" in utf8 or b"\n\n\n" in utf8 or self.holds_added(utf8):
            return False
        if utf8[:1] in (b" ", b"\n") or utf8[-1:] == b" " or utf8[-2:] == b"\n\n":
            return False
        if len(utf8.translate(None, ODD_ASCII)) != len(utf8):
            return False
        return not ((b"\xe2" in utf8 or b"\xc2" in utf8 or b"\xe1" in utf8 or b"\xe3" in utf8) and ODD_UTF8.search(utf8))

    def gaps(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a space leads each run, the line feeds before it, and those after the last of a text."""
        n = len(runs.start)
        lead, feeds, after = runs.lone_space(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(runs.first) > 0)
        begins, lasts = runs.first[some], runs.first[some + 1] - 1
        lead[begins] = False
        if n:
            feeds[1:] = runs.start[1:] - runs.end[:-1]
            feeds[lead] = feeds[begins] = 0
            after[lasts] = runs.at[some + 1] - 1 - runs.end[lasts]
        return lead, feeds, after


_MADE: dict[tuple[type, str], Encoder] = {}


def encoder(kind: type, path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]
