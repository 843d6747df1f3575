"""Helpers shared by the corpus operators: shared-folder storage and byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Cuts the lineage of a table that is used several times; the table goes with the session's shared folder.
checkpointed = stored


#: Bytes of texts that a task works on at once; a longer text is a part of its own.
PART_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about ``PART_BYTES`` in ``column`` (string or binary), for work that holds a text several times."""
    for batch in batches:
        _, offsets = string_buffers(batch.column(column))
        for a, z in row_blocks(offsets, PART_BYTES):
            yield batch.slice(a, z - a)


def kept_and_text(docs: DataFrame, keep: tuple, text: str) -> tuple[DataFrame, list[str], str]:
    """``keep`` and the text (once, if it is among them) of ``docs``, the names kept, and their schema."""
    rows = docs.select(*keep, *(() if text in keep else (F.col(text).cast("string").alias(text),)))
    kept = [f for f in rows.schema if f.name != text or text in keep]
    return rows, [f.name for f in kept], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column (null: empty)."""
    return [t or "" for t in column.to_pylist()]


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and its n + 1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffer = wide.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``target`` bytes; a longer row is a block of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the high-entropy bits of a uint64 over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any substring of a block, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            powers = np.full(n, self.base, np.uint64)
            powers[0] = 1
            back = np.full(n, self.inverse, np.uint64)
            back[0] = 1
            self.power, self.back = np.multiply.accumulate(powers), np.multiply.accumulate(back)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.back[start])
