"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding merges neighbouring symbols, best score first (ties: leftmost), from an agenda of
candidate merges.  With dropout a candidate is skipped if a keyed hash of the document, the
seed and the candidate's place says so; the result depends on nothing else, so it is the
same in every run and on every partitioning, and another seed gives another segmentation.
Every segmentation decodes to the text it came from.

Pieces hold a word-start mark only at their start, so words are independent.  The agendas
of many short words are processed at once, one merge of each word in a round; words of
over ``LONG_WORD`` symbols have a heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, row_blocks, sliced, string_buffers

BLOCK_CHARS = 1 << 17
LONG_WORD = 96
LONG_TEXT = 1 << 18
MARK = "▁"
NONE = np.int64(1) << np.int64(62)
GONE = -2
SLOTS = 1 << 21


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables of a BPE model: symbols of characters, merges of piece pairs, and bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(count)]
        is_byte = [model.is_byte(i) for i in range(count)]
        normal = {name: i for i, name in enumerate(names) if not special[i] and not is_byte[i]}
        scores = np.array([model.get_score(i) for i in range(count)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [b""] * count
        for i, name in enumerate(names):
            if is_byte[i]:
                self.byte_ids[int(name[3:-1], 16)] = i
                self.bytes[i] = bytes([int(name[3:-1], 16)])
            elif not special[i]:
                self.bytes[i] = name.replace(MARK, " ").encode()
        self.symbol = np.full(0x110000, -1, np.int32)
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        self.mark = int(self.symbol[ord(MARK)])
        self.symbol[ord(" ")] = self.mark
        self.symbol[ord(MARK)] = -1  # in a text the mark itself is spelled by its bytes
        self.merges = {}
        for name, i in normal.items():
            for cut in range(1, len(name)):
                a, b = normal.get(name[:cut]), normal.get(name[cut:])
                if a is not None and b is not None:
                    self.merges[a << 15 | b] = i
        self.keys, self.values = np.full(SLOTS, -1, np.int64), np.full(SLOTS, -1, np.int32)
        left = np.array(list(self.merges), np.int64)
        merged = np.array(list(self.merges.values()), np.int32)
        slot = self._slot(left)
        while len(left):  # open addressing: each round places one key in every free slot that is asked for
            free = self.keys[slot] < 0
            chosen = np.zeros(len(left), bool)
            places, first = np.unique(slot[free], return_index=True)
            where = np.flatnonzero(free)[first]
            self.keys[places], self.values[places] = left[where], merged[where]
            chosen[where] = True
            left, merged, slot = left[~chosen], merged[~chosen], (slot[~chosen] + 1) & (SLOTS - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7C1) >> 20) & (SLOTS - 1)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each two pieces make, or -1."""
        key = a.astype(np.int64) << 15 | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & (SLOTS - 1)
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            go_on = ~hit & (found >= 0)
            open_, at = open_[go_on], at[go_on]
        return out


def skipped(word_seed: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether the candidate merge of two neighbouring spans is skipped, by a keyed hash."""
    h = word_seed + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h += (middle - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (end - middle).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return mixed(h) < limit


def merge_words(pieces: Pieces, symbols: np.ndarray, place: np.ndarray, starts: np.ndarray, seeds: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of many words and the word of each one; ``starts`` bounds the words (n + 1).

    Symbols stay in their slots and are linked to their neighbours; a merge leaves the
    right slot ``GONE``.  A slot's agenda key is the rank of its merge, then the slot.
    """
    sizes = np.diff(starts)
    total, word = len(symbols), np.repeat(np.arange(len(sizes)), sizes)
    word_end = place[starts[1:] - 1] + 1
    out = np.full(total, GONE, np.int32)
    origin, owner, starts = np.arange(total), word, starts[:-1]
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    after[np.append(starts[1:], total) - 1] = -1
    before[starts] = -1
    key, made = np.full(total, NONE), np.zeros(total, np.int32)

    def offer(at: np.ndarray) -> None:
        right = after[at]
        new = pieces.merged(symbols[at], symbols[right])
        some = np.flatnonzero(new >= 0)
        at, right, new = at[some], right[some], new[some]
        if limit and len(at):
            third, w = after[right], word[at]
            end = np.where(third >= 0, place[third], word_end[w])
            keep = np.flatnonzero(~skipped(seeds[w], place[at], place[right], end, limit))
            at, new = at[keep], new[keep]
        key[at] = pieces.rank[new] << 32 | at
        made[at] = new

    offer(np.flatnonzero(after >= 0))
    while len(starts):
        best = np.minimum.reduceat(key, starts)
        active = best < NONE
        if 2 * np.count_nonzero(active) < len(active):  # finished words leave
            lengths = np.diff(np.append(starts, len(key)))
            rest = np.repeat(active, lengths)
            out[origin[~rest]] = symbols[~rest]
            moved = np.cumsum(rest) - 1
            after, before = (np.where(x >= 0, moved[x], -1)[rest] for x in (after, before))
            key = key[rest]
            key = np.where(key < NONE, key >> 32 << 32 | np.arange(len(key)), NONE)
            symbols, place, word, origin, made = (x[rest] for x in (symbols, place, word, origin, made))
            starts = np.cumsum(lengths[active]) - lengths[active]
            if not len(starts):
                break
            best, active = np.minimum.reduceat(key, starts), np.ones(len(starts), bool)
        left = best[active] & 0xFFFFFFFF
        right = after[left]
        third = after[right]
        symbols[left], symbols[right] = made[left], GONE
        key[left] = key[right] = NONE
        after[left] = third
        more = third >= 0
        before[third[more]] = left[more]
        prior = before[left]
        prior = prior[prior >= 0]
        key[prior] = NONE
        offer(np.concatenate([left[more], prior]))
    kept = out != GONE
    return out[kept], owner[kept]


def merge_long_word(pieces: Pieces, symbols: list[int], place: list[int], end: int, seed: np.ndarray, limit: np.uint64) -> list[int]:
    """The same for one word of any length, with a heap as the agenda."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive, agenda = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        new = pieces.merges.get(symbols[i] << 15 | symbols[j]) if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 else None
        if new is None:
            return
        k = after[j]
        if limit and skipped(seed, np.array([place[i]]), np.array([place[j]]), np.array([place[k] if k >= 0 else end]), limit)[0]:
            return
        heapq.heappush(agenda, (int(pieces.rank[new]), i, symbols[i], symbols[j], new))

    for i in range(n):
        offer(i)
    while agenda:
        _, i, a, b, new = heapq.heappop(agenda)
        j = after[i]
        if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], after[i] = new, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def encode_texts(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int, dropout: float) -> list[np.ndarray]:
    """Piece ids (int32) of each text; ``keys`` (int64) tell documents apart.

    A very long text is encoded in parts that begin where words do.
    """
    if len(texts) != 1 or len(texts[0]) < LONG_TEXT:
        return encode_marked(pieces, [" " + t if t else "" for t in texts], np.zeros(len(texts), np.int64), keys, seed, dropout)
    marked, at, out = " " + texts[0], 0, []
    while at < len(marked):
        end = marked.find(" ", at + LONG_TEXT)
        while 0 < end and marked[end - 1] == " ":  # a word starts with the first of several spaces
            end -= 1
        end = end if end > at else len(marked)
        out += encode_marked(pieces, [marked[at:end]], np.array([at]), keys, seed, dropout)
        at = end
    return [np.concatenate(out)]


def encode_marked(pieces: Pieces, texts: list[str], base: np.ndarray, keys: np.ndarray, seed: int, dropout: float) -> list[np.ndarray]:
    """The same for texts with the space before their first word; ``base`` is their place in the whole."""
    limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = pieces.symbol[codes]
    doc_start = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - (doc_start[:-1] - base)[doc]
    unknown, mark = symbols < 0, symbols == pieces.mark
    opens = np.zeros(len(codes) + 1, bool)
    opens[doc_start] = True
    opens[1:-1] |= (mark[1:] & ~mark[:-1]) | unknown[1:] | unknown[:-1]
    starts = np.flatnonzero(opens[:-1])
    if not len(starts):
        return [np.zeros(0, np.int32) for _ in texts]
    lengths = np.diff(np.append(starts, len(codes)))
    seeds = mixed(keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))[doc[starts]]
    short = lengths <= LONG_WORD
    in_short = np.repeat(short, lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths[short])])
    found, where = merge_words(pieces, symbols[in_short].copy(), place[in_short], bounds, seeds[short], limit) if short.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    owner = np.flatnonzero(short)[where]
    for w in np.flatnonzero(~short):
        a, b = starts[w], starts[w] + lengths[w]
        more = merge_long_word(pieces, symbols[a:b].tolist(), place[a:b].tolist(), int(place[b - 1]) + 1, seeds[w : w + 1], limit)
        found, owner = np.append(found, np.array(more, np.int32)), np.append(owner, np.full(len(more), w))
    order = np.argsort(owner, kind="stable")
    found, owner = found[order], owner[order]
    # Characters that the model lacks are spelled by their bytes.
    lacking = np.flatnonzero(found < 0)
    if len(lacking):
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[starts[owner[lacking]]].tolist()]
        repeat = np.ones(len(found), np.int64)
        repeat[lacking] = [len(s) for s in spelled]
        at = np.repeat(found < 0, repeat)
        found, owner = np.repeat(found, repeat), np.repeat(owner, repeat)
        found[at] = pieces.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    cuts = np.searchsorted(doc[starts[owner]], np.arange(1, len(texts)))
    return np.split(found, cuts)


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of piece ids; control pieces stand for nothing."""
    raw = b"".join(map(pieces.bytes.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def blocks_of(batch: pa.RecordBatch, pieces: Pieces, seed: int, dropout: float) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Parts of a batch (whose last columns are text and key) of about ``BLOCK_CHARS``, with their texts and ids."""
    text, key = batch.schema.names[-2:]
    _, offsets = string_buffers(batch.column(text))
    for a, z in row_blocks(offsets, BLOCK_CHARS):
        part = batch.slice(a, z - a)
        texts = part.column(text).to_pylist()
        yield part, texts, encode_texts(pieces, texts, part.column(key).to_numpy().copy(), seed, dropout)


def keyed(docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> tuple[DataFrame, list, str, str]:
    own, number = ("_" * (1 + max([0, *map(len, keep)])) + name for name in ("text", "key"))  # longer than any name kept
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own), F.xxhash64(key).alias(number))
    kept = rows.schema[: len(rows.columns) - 2]
    return rows, [f.name for f in kept], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), rows.columns[-2]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id", "text"), seed: int = 1, dropout: float = 0.1, model: str | None = None) -> DataFrame:
    """``keep`` and ids (array of int): each text's pieces, with merges skipped at rate ``dropout``.

    ``key`` tells documents apart (null is a key like others); equal rows get equal ids.
    A null or empty text has no ids.  With ``dropout`` 0 the segmentation is the model's own.
    ``keep`` must not hold a column named ids; other columns of ``docs`` may have any name.
    """
    path = model or public_model()
    rows, names, schema, own = keyed(docs, text, key, keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in sliced(batches, own):
            for part, _, ids in blocks_of(batch, pieces, seed, dropout):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], names=[*names, "ids"])

    return rows.mapInArrow(task, f"{schema}, ids array<int>")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = 1, dropout: float = 0.1, model: str | None = None) -> DataFrame:
    """``keep``, n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids) and lossless: ``encode`` and ``decode`` in one pass.

    Ids stay in the task that made them, so that neither they nor the texts come back.
    ``keep`` must not hold the names of the three new columns.
    """
    path = model or public_model()
    rows, names, schema, own = keyed(docs, text, key, keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in sliced(batches, own):
            for part, texts, ids in blocks_of(batch, pieces, seed, dropout):
                new = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                    pa.array([decode_ids(pieces, x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, "n_pieces", "ids_crc32", "lossless"])

    return rows.mapInArrow(task, f"{schema}, n_pieces long, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """``keep`` (without a column of that name) and decoded: the text of each list of piece ids (null: null)."""
    path = model or public_model()
    own = "_" * (1 + max([0, *map(len, keep)])) + "ids"  # longer than any name kept
    rows = encoded.select(*keep, F.col(ids).alias(own))
    kept = rows.schema[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            texts = [decode_ids(pieces, x.values.to_numpy()) if x.is_valid else None for x in batch.column(own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])

    return rows.mapInArrow(task, schema)
