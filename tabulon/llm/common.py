"""Shared helpers: scratch tables, size-checked joins, and vectorised word splitting for Arrow tasks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import ensure_checkpoint_dir

# Rows up to which a side is broadcast; beyond it joins shuffle (hot keys are handled apart).
BROADCAST_ROWS = 10_000
# Text bytes handled at once inside a task (a single longer text is handled alone).
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the folder of ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_aware_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, spread: list[str]) -> DataFrame:
    """Left join to ``small`` (one row a key) where the keys in ``hot`` hold many rows of ``big``.

    ``hot`` must be bounded by construction (keys with at least a fixed share of
    all rows).  Rows of hot keys get their match by a broadcast of the hot part
    of ``small`` and are then dealt by ``spread`` columns, not by their key; the
    others meet ``small`` in an ordinary join.
    """
    values = [c for c in small.columns if c not in on]
    few = small.join(F.broadcast(hot.select(*on)), on, "left_semi")
    few = few.select(*on, F.struct(*values).alias("__warm"))
    tagged = big.join(F.broadcast(few), on, "left")
    tagged = tagged.withColumn("__deal", F.when(F.col("__warm").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(4096)) + 1))
    rest = small.select(*on, F.lit(0).cast("long").alias("__deal"), F.struct(*values).alias("__cold"))
    joined = tagged.join(rest, [*on, "__deal"], "left")
    both = [F.coalesce(F.col(f"__warm.{v}"), F.col(f"__cold.{v}")).alias(v) for v in values]
    return joined.select(*big.columns, *both)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES,
                max_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            to = min(to, at + max_rows)
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def utf8_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: ``codes`` into ``vocabulary``, ``counts`` per text.

    ``data``/``offsets`` are the UTF-8 bytes; ``starts``/``ends`` give each word's bytes.
    """

    def __init__(self, col: pa.Array, lower: bool = False, code: bool = True):
        self.data, self.offsets = utf8_bytes(col)
        data, off = self.data, self.offsets
        if lower:
            up = (data >= 65) & (data <= 90)
            self.data = data = np.where(up, data + 32, data).astype(np.uint8)
        word = ~SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = off[:-1][off[:-1] < len(data)]
        first[heads] |= word[heads]
        last = word.copy()
        last[:-1] &= ~word[1:]
        tails = off[1:][off[1:] > 0] - 1
        last[tails] |= word[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        edges = np.searchsorted(self.starts, off)
        self.counts = np.diff(edges)
        self.edges = edges
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)
        self.letters = data[word]  # the words' bytes without the space between
        self.word_offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        if code:
            words = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(self.starts),
                [None, pa.py_buffer(self.word_offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.letters))])
            coded = words.dictionary_encode()
            self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.vocabulary = coded.dictionary


def remainder(id_col: str, of: int):
    """crc32 of an id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
