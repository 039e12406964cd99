"""Shared plumbing of the training-data operators.

Tables that cut lineage and files that several executors need are put in the
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.plans.storage import save, scratch, shared_dir  # noqa: F401


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, after bounding the session's Arrow batches by bytes: rows here are
    whole texts, and 10,000 of them are too many to hold. A lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).rstrip("bB")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
        df.sparkSession.conf.set(name, str(most))
    return df


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns every text operator needs, whatever else the table has."""
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow string column without decoding; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task otherwise keeps what its last one used at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``most`` bytes
    (one longer row is a batch), so that Python objects of few texts live at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.num_rows <= rows and batch.nbytes <= most:
            yield batch
            continue
        step = max(1, min(rows, batch.num_rows))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if part.nbytes <= most:
                yield part
                continue
            lo = total = 0
            for i, n in enumerate(_row_bytes(part)):
                if total and total + n > most:
                    yield part.slice(lo, i - lo)
                    lo, total = i, 0
                total += n
            yield part.slice(lo)
    release()


def _row_bytes(batch: pa.RecordBatch) -> list[int]:
    """Bytes of text of each row."""
    total = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            total = [a + (b or 0) for a, b in zip(total, pc.binary_length(column).to_pylist(), strict=True)]
    return total


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


class Store:
    """Whole-file reads and atomic writes under a URI; local paths can also be memory-mapped."""

    def __init__(self, uri: str):
        self.root = _local(uri)
        self.fs = None
        if self.root is None:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def mkdir(self) -> None:
        os.makedirs(self.root, exist_ok=True) if self.fs is None else self.fs.create_dir(self.root)

    def create(self, name: str):
        """A writable file that appears under ``name`` only when committed."""
        return _Pending(self, name)

    def write(self, name: str, data: bytes) -> None:
        with self.create(name) as f:
            f.write(data)

    def read(self, name: str) -> bytes:
        if self.fs is None:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read()

    def mapped(self, name: str, dtype: str):
        """The file as an array, memory-mapped where the file system allows it."""
        import numpy as np

        if self.fs is None:
            path = f"{self.root}/{name}"
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
        return np.frombuffer(self.read(name), dtype=dtype)

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))


class _Pending:
    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.tmp = f"{store.root}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.f = open(self.tmp, "wb") if self.store.fs is None else self.store.fs.open_output_stream(self.tmp)
        return self.f

    def __exit__(self, kind, *_):
        self.f.close()
        to = f"{self.store.root}/{self.name}"
        if kind is None:
            os.replace(self.tmp, to) if self.store.fs is None else self.store.fs.move(self.tmp, to)


class BitFilter:
    """A filter of fixed size for 64-bit keys: never says no to one that was
    put in. It spares a shuffle of rows that the exact join behind it would
    drop; when there are too many keys for it, it lets more rows through."""

    BITS = 24

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False):
        """2 MB at most reach the driver, 32768 bits to a row. ``hashed`` keys are uniform by themselves."""
        self.hashed = hashed
        rows = keys.select(self._spread(column).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
        # Bit x of the table is Spark's bit ``bitmap_bit_position(x)`` of its bucket; buckets begin at 1 for x = 1.
        size = 4096
        data = bytearray(((1 << self.BITS) // 32768 + 2) * size)
        for r in rows:
            data[r.bucket * size : r.bucket * size + size] = r.bits
        self.sent = keys.sparkSession.sparkContext.broadcast(bytes(data))

    def _spread(self, column: str):
        return (F.col(column) if self.hashed else F.xxhash64(column)).bitwiseAND(F.lit((1 << self.BITS) - 1))

    def __getstate__(self):
        return {"sent": self.sent, "hashed": self.hashed}

    def bits(self):
        import numpy as np

        if "_bits" not in self.__dict__:
            self._bits = np.unpackbits(np.frombuffer(self.sent.value, np.uint8), bitorder="little").astype(bool)
        return self._bits

    def hit(self, keys):
        """Which of an array of keys that are hashes may be in."""
        import numpy as np

        x = keys & np.int64((1 << self.BITS) - 1)
        # as Spark has it: positive numbers count from 1, and 0 is alone in bucket 0
        place = np.where(x > 0, 32768 + x - 1, 0)
        return self.bits()[place]

    def keep(self, df: DataFrame, column: str, invert: bool = False) -> DataFrame:
        """The rows of ``df`` whose key may be in, or with ``invert`` the others; all columns."""
        mark = fresh(df, "spread_")
        at = len(df.columns)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = self.bits()
            for batch in batches:
                yield batch.select(range(at)).filter(pa.array(bits[batch.column(at).to_numpy(zero_copy_only=False)] != invert))

        spread = self._spread(column)
        place = F.bitmap_bucket_number(spread) * 32768 + F.bitmap_bit_position(spread)
        return df.withColumn(mark, place).mapInArrow(each, df.schema)
