"""Token-ID / binary output (operator 1).

A data set is a folder with, for each part, a flat file of unsigned integer ids
(``part-k.bin``, the narrowest of 16 and 32 bits that holds the vocabulary), a
file of 64-bit offsets (``part-k.idx``, one more than it has documents, within
the part) and a file of 64-bit document ids (``part-k.doc``), and a
``manifest.json`` with each part's bases. Parts are runs of ascending document
id; the bases are prefix sums over the parts' counts, so no task waits for
another and the driver sees a few numbers for each part.

Defined results: a null text is an empty document and still gets the end id;
null document ids come first, in the order of their texts; rows with equal ids
keep one place each, ordered by a hash of their text; an empty table gives a
manifest without parts; other columns are ignored. A task that runs again
writes the same files and renames them into place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordEncoder, encoder
from .common import Store, id_and_text, raw_bytes, shuffle_partitions, slices

STATS = "part string, first_id long, first_tie long, n_null long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, kind: type = WordEncoder, parts: int | None = None) -> None:
    """Encode whole texts in ascending document id and write the data set to ``out``.

    ``out`` must be a folder that all executors and the driver share. The texts
    are dealt once, by range of (id, hash of the text); the hash keeps a
    repeated id from forming a range that can't be cut.
    """
    spark = docs.sparkSession
    Store(out).mkdir()
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    n = parts or shuffle_partitions(spark)
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        enc = encoder(kind, tokenizer)
        end = np.asarray([end_id], dtype=enc.dtype).tobytes()
        store, lengths, ids, nulls, first = Store(out), [], [], 0, None
        with store.create(f"{name}.bin") as f:
            for batch in slices(batches, 512):
                keys = batch.column("doc_id")
                nulls += keys.null_count
                if first is None and batch.num_rows:
                    first = (keys[0].as_py(), batch.column("tie")[0].as_py())
                ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for own in enc.encode_all(raw_bytes(batch.column("text"))):
                    lengths.append(len(own) + 1)
                    f.write(own.tobytes() + end)
        if first is None:
            return
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        store.write(f"{name}.idx", offsets.tobytes())
        store.write(f"{name}.doc", np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": name, "first_id": first[0], "first_tie": first[1], "n_null": nulls, "n_docs": len(lengths), "n_tokens": int(offsets[-1])}],
            schema=pa.schema([("part", pa.string()), *[(c, pa.int64()) for c in ("first_id", "first_tie", "n_null", "n_docs", "n_tokens")]]),
        )

    stats = dealt.mapInArrow(write, STATS).collect()  # one row for each part
    stats.sort(key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_tie))
    manifest, base_doc, base_token = [], 0, 0
    for r in stats:
        manifest.append({"part": r.part, "n_docs": r.n_docs, "n_null": r.n_null, "n_tokens": r.n_tokens, "base_doc": base_doc, "base_token": base_token})
        base_doc, base_token = base_doc + r.n_docs, base_token + r.n_tokens
    head = {"dtype": encoder(kind, tokenizer).dtype, "end_id": end_id, "n_docs": base_doc, "n_tokens": base_token, "parts": manifest}
    Store(out).write("manifest.json", json.dumps(head).encode())


class TokenFiles:
    """Random access to a data set by the documents' place in ascending id order."""

    def __init__(self, out: str):
        self.store = Store(out)
        self.head = self.store.read_json("manifest.json")
        self.bases = [p["base_doc"] for p in self.head["parts"]]

    def __len__(self) -> int:
        return self.head["n_docs"]

    def part(self, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, offsets and document ids of a part, memory-mapped."""
        return tuple(self.store.mapped(f"{p['part']}.{end}", kind) for end, kind in (("bin", self.head["dtype"]), ("idx", "<i8"), ("doc", "<i8")))

    def __getitem__(self, i: int) -> np.ndarray:
        p = self.head["parts"][bisect_right(self.bases, i) - 1]
        ids, offsets, _ = self.part(p)
        j = i - p["base_doc"]
        return ids[offsets[j] : offsets[j + 1]]


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digest(spark, out: str) -> DataFrame:
    """One row for each document, all from the files: place, length and crc32 of its ids as little-endian 32-bit integers."""
    head = Store(out).read_json("manifest.json")
    rows = [(p["part"], p["n_docs"], p["n_null"], p["base_token"]) for p in head["parts"]]
    parts = spark.createDataFrame(rows, "part string, n_docs long, n_null long, base_token long").repartition(max(1, len(rows)))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles(out)
        for batch in batches:
            for p in batch.to_pylist():
                ids, offsets, keys = files.part(p)
                for lo in range(0, p["n_docs"], 4096):
                    hi = min(lo + 4096, p["n_docs"])
                    at = np.asarray(offsets[lo : hi + 1])
                    crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, hi - lo)
                    doc = pa.array(np.asarray(keys[lo:hi]), mask=np.arange(lo, hi) < p["n_null"])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + p["base_token"]), pa.array(np.diff(at)), pa.array(crc)], schema=schema)

    return parts.mapInArrow(read, DIGEST)
