"""Packing of tokenized documents into fixed-length sequences by bounded-space best fit.

Documents are tokenized once, where they are read; only small rows about pieces move on.
Pieces are dealt by hash over as many tasks as their number asks for, and each task
packs its stream online with a fixed number of open sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_and_text, sliced, stored, texts_of

#: Pieces that one packing task takes; a task holds no more than its open bins of them at once.
PIECES_PER_TASK = 500_000
END_OF_TEXT = "<|endoftext|>"


def public_vocabulary() -> str:
    """Rank file of the 50k byte-level vocabulary; its ids are those of the JSON form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def token_ids(encoding, text: str) -> np.ndarray:
    """uint32 ids of a text; the end-of-text string counts as its special token, as the JSON form has it."""
    if END_OF_TEXT in text:
        return np.array(encoding.encode(text, allowed_special="all"), np.uint32)
    return encoding.encode_to_numpy(text, disallowed_special=())


def tokenized_pieces(docs: DataFrame, text: str, keep: tuple[str, ...], size: int, vocabulary: str) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32: documents of over ``size`` ids in pieces of ``size``.

    The first piece of a long document takes what is left over.
    """
    rows, names, schema = kept_and_text(docs, keep, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary)
        for batch in sliced(batches, text):
            index, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(texts_of(batch.column(text))):
                ids = np.append(token_ids(encoding, value), np.uint32(0)).astype("<u4")
                first = len(ids) % size or min(len(ids), size)
                bounds = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    index.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            columns = [batch.column(n).take(pa.array(index, pa.int64())) for n in names]
            new = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*names, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(task, f"{schema}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open bins, found by a bitset over their free space.

    Bit f is set if some open bin has f free.  The best fit for a piece is the lowest
    set bit at or above its length.  When all bins are open and none fits, the fullest,
    which is the lowest set bit of all, is closed to make room for a new one.
    """

    def __init__(self, size: int, count: int, first_number: int):
        self.size, self.count, self.next = size, count, first_number
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence number, offset) for a piece of ``length``."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.count:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free


def pack(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 2048, open_bins: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Packs all documents, each followed by id 0, into sequences of at most ``size`` ids.

    Returns one row per piece: ``keep``, piece, start, length, ids_crc32, sequence_id and
    offset.  A null text is empty, and an empty one is the single id 0.  Repeated rows are
    packed each for itself.  ``keep`` columns must not bear the names of the new columns.
    """
    pieces = stored(tokenized_pieces(docs, text, keep, size, vocabulary or public_vocabulary()))
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    kept = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(size, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            numbers = pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *numbers], names=[*kept, "sequence_id", "offset"])

    # The same pieces meet in the same order in a repeated task, so that it packs them as before.
    dealt = F.xxhash64(F.struct(*kept))
    order = pieces.repartition(tasks, dealt).sortWithinPartitions(dealt, *kept)
    return order.mapInArrow(task, schema)
