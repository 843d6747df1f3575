"""Toxicity scores from a small convolutional network over hashed words.

A word's vector is the sum of the embeddings of its hash and of the hashes of its beginnings
(stems), so that inflected forms share what is known.  Filters of several widths slide over
the words of the whole text, each keeps its maximum, and a logistic unit weighs the maxima.
The network is trained in numpy on a bounded sample of labelled rows.  Part of the sample
sets a threshold for each language (as predicted from the text), which is the score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id
from .common import PrefixHash, kept_and_text, mixed, row_blocks, sliced, string_buffers, texts_of

BUCKETS = 1 << 16
EMBEDDING = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of the beginnings of a word that count besides the word, where it is longer.
STEMS = (4, 5, 6, 7, 8)
PADS = max(WIDTHS)
BLOCK = 1 << 18
HASHER = PrefixHash(19)

# Bytes of words: ASCII letters (as lower case) and digits, and all bytes of other letters.
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_word = np.zeros(256, bool)
_word[48:58] = _word[97:123] = _word[128:] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids (1 and up; 0: none) of each word and its stems, for rows of UTF-8 bytes, and row offsets.

    ``PADS`` rows of zeros follow each text.
    """
    data = _fold[data]
    is_word = _word[data]
    edge = np.zeros(len(data) + 1, bool)  # a word never goes on over the start of a row
    edge[offsets] = True
    begins = np.flatnonzero(is_word & (edge[:-1] | ~np.concatenate([[False], is_word[:-1]])))
    ends = np.flatnonzero(is_word & (edge[1:] | ~np.concatenate([is_word[1:], [False]]))) + 1
    row = np.searchsorted(offsets, begins, "right") - 1
    prefix = HASHER.prefix(data)
    ids = np.zeros((len(begins), 1 + len(STEMS)), np.int32)
    ids[:, 0] = HASHER.ranges(prefix, begins, ends) % np.uint64(BUCKETS - 1) + np.uint64(1)
    for k, stem in enumerate(STEMS, 1):
        longer = ends - begins > stem
        ids[longer, k] = mixed(HASHER.ranges(prefix, begins[longer], begins[longer] + stem) + np.uint64(stem)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    starts = np.concatenate([[0], np.cumsum(counts + PADS)])
    out = np.zeros((starts[-1], ids.shape[1]), np.int32)
    out[np.arange(len(ids)) + row * PADS] = ids
    return out, starts


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: float = 1.0
    thresholds: dict[str | None, float] = field(default_factory=dict)  # None: of all languages together
    language: language_id.LanguageModel | None = None

    def table(self) -> np.ndarray:
        """What each id adds to each filter at each place of it: (BUCKETS, places * FILTERS)."""
        return np.concatenate([self.embedding @ part for f in self.filters for part in f], axis=1)

    def pooled(self, ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        out, place = [], 0
        adds = table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            adds += table[ids[:, k]]
        last = np.concatenate([starts[1:] - k for k in range(1, PADS)]) if PADS > 1 else np.zeros(0, np.int64)
        for width in WIDTHS:
            n = len(ids) - PADS + 1
            total = sum(adds[k : n + k, (place + k) * FILTERS : (place + k + 1) * FILTERS] for k in range(width))
            place += width
            total[last[last < n]] = -1e9  # windows that would reach into the next row
            out.append(np.maximum.reduceat(total, starts[:-1], axis=0))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def pooled_in_parts(self, data: np.ndarray, table: np.ndarray, size: int = BLOCK) -> np.ndarray:
        """The same for one very long text, in parts that end between words and share the words at their borders."""
        best, before, at = None, np.zeros((0, 1 + len(STEMS)), np.int32), 0
        while at < len(data):
            end = min(len(data), at + size)
            if end < len(data):
                gaps = np.flatnonzero(~_word[_fold[data[at:end]]])
                while not len(gaps) and end < len(data):  # a word that is longer than a part
                    end = min(len(data), end + size)
                    gaps = np.flatnonzero(~_word[_fold[data[at:end]]])
                end = at + int(gaps[-1]) + 1 if len(gaps) and end < len(data) else end
            ids, starts = word_ids(data[at:end], np.array([0, end - at]))
            ids = np.concatenate([before, ids if end == len(data) else ids[: len(ids) - PADS]])
            at = end
            if len(ids) >= PADS:
                one = self.pooled(ids, np.array([0, len(ids)]), table)
                best = one if best is None else np.maximum(best, one)
            before = ids[max(len(ids) - PADS + 1, 0) :]
        return best

    def logits(self, ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        return self.pooled(ids, starts, table) @ self.weights + self.offset

    def scores(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        common = self.thresholds.get(None, 0.0)
        threshold = np.array([self.thresholds.get(x, common) for x in languages])
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits - threshold), -50, 50)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 2e-3, seed: int = 5) -> ToxicityModel:
    """Trains on rows of word ids; both classes weigh the same.

    One embedding dimension starts as the smoothed log-odds of a word's rows, the rest at random.
    """
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, y, strict=True):
        seen[label, np.unique(ids)] += 1  # rows that have a word or stem
    rows = np.maximum(np.bincount(y, minlength=2), 1)
    odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
    evidence = (seen.sum(axis=0) / (seen.sum(axis=0) + 10))
    e = rng.normal(0, 0.05, (BUCKETS, EMBEDDING)).astype(np.float32)
    e[:, 0] = np.clip(odds * evidence, -3, 3) / 3
    e[0] = 0
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    model = ToxicityModel(e, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0)
    params = [e, *filters, model.bias, model.weights, np.array([model.offset], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(y == 1, 0.5 / rows[1], 0.5 / rows[0]) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            ids = np.concatenate([texts[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
            vectors = e[ids].sum(axis=1)
            grads = [np.zeros_like(p) for p in params]
            pooled, where = [], []
            last = np.concatenate([starts[1:] - k for k in range(1, PADS)])
            n = len(ids) - PADS + 1
            for f in filters:
                total = sum(vectors[k : n + k] @ part for k, part in enumerate(f))
                total[last[last < n]] = -1e9
                best = np.maximum.reduceat(total, starts[:-1], axis=0)
                row = np.repeat(np.arange(len(chosen)), np.diff(starts))[:n]
                hit = np.where(total == best[row], np.arange(n)[:, None], n)
                pooled.append(best)
                where.append(np.minimum.reduceat(hit, starts[:-1], axis=0))
            raw = np.concatenate(pooled, axis=1) + model.bias
            h = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(h @ model.weights + params[-1][0])))
            gap = ((p - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads[-1][0] = gap.sum()
            grads[-2] += h.T @ gap
            back = gap[:, None] * model.weights * (raw > 0)
            grads[-3] += back.sum(axis=0)
            for i, (f, spot) in enumerate(zip(filters, where, strict=True)):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(f)):
                    grads[1 + i][k] += np.einsum("rfe,rf->ef", vectors[spot + k], b)
                    pull = (b[:, :, None] * f[k].T[None]).reshape(-1, 1, EMBEDDING)
                    np.add.at(grads[0], ids[spot + k].reshape(-1, ids.shape[1]), pull)
            grads[0][0] = 0
            step += 1
            for p_, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.offset = float(params[-1][0])
    return model


def best_threshold(logits: np.ndarray, y: np.ndarray, clean_weight: float = 3.0) -> float:
    """The middle of the widest gap between logits that serves both classes best.

    The clean class's accuracy counts ``clean_weight`` times that of the toxic one.
    """
    order = np.argsort(logits, kind="stable")
    z, toxic = logits[order], y[order] == 1
    below = np.cumsum(~toxic)[:-1] / max((~toxic).sum(), 1) * clean_weight
    above = (toxic.sum() - np.cumsum(toxic)[:-1]) / max(toxic.sum(), 1)
    right = np.where(z[1:] == z[:-1], -1.0, below + above)
    top = np.flatnonzero(right >= right.max() - 1e-12)
    at = top[np.argmax(z[top + 1] - z[top])]
    return float((z[at] + z[at + 1]) / 2)


def calibrate(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, languages: list[str], least: int = 15) -> None:
    """Sets the thresholds: a language with fewer than ``least`` rows of a class takes the common one."""
    if len(set(y.tolist())) < 2:
        return
    filters, z = model.table(), np.empty(len(texts))
    for at in range(0, len(texts), 32):
        part = texts[at : at + 32]
        z[at : at + 32] = model.logits(np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])]), filters)
    model.thresholds[None] = best_threshold(z, y)
    for code in set(languages):
        own = np.array([x == code for x in languages])
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            model.thresholds[code] = best_threshold(z[own], y[own])
    gap = abs(z[y == 1].mean() - z[y == 0].mean())
    model.scale = float(6 / max(gap, 1e-3))


def fit(docs: DataFrame, labels: DataFrame, language: language_id.LanguageModel | None, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 1000, longest: int = 1 << 16) -> ToxicityModel | None:
    """Fits on about ``per_class`` toxic rows and twice as many clean ones, chosen by hash; never over four times that in all.

    ``labels`` has (``key``, ``label``).  The sample is drawn from it first, so that texts are
    picked out where they are read.  Three quarters of the sample train the network, the
    rest sets the thresholds.  Rows with a null label, key or text, or a text of over
    ``longest`` bytes, teach nothing; without rows of both classes there is no model.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, 2 * per_class / sizes[0]))
    drawn = F.pmod(F.xxhash64("key", F.lit(12)), F.lit(1 << 30)) < share * (1 << 30)
    chosen = known.where(drawn).limit(4 * per_class)  # the bound that allows the broadcast
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= longest)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, starts = word_ids(*string_buffers(batch.column("text")))
            x, _ = language_id.ngram_features(batch.column("text").to_pylist())
            codes = language.predict(x)[0] if language and len(x) else [language_id.UNKNOWN] * len(x)
            words = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(codes, pa.string()), pa.array(words, pa.binary())], names=["label", "lang", "ids"])

    sample = texts.join(F.broadcast(chosen), "key").limit(4 * per_class).mapInArrow(task, "label int, lang string, ids binary")
    rows = sorted(sample.collect(), key=lambda r: (r["ids"], r["label"]))
    texts = [np.frombuffer(r["ids"], np.int32).reshape(-1, 1 + len(STEMS)) for r in rows]
    y = np.array([r["label"] for r in rows])
    codes = [r["lang"] for r in rows]
    if len(set(y.tolist())) < 2:
        return None
    place = np.empty(len(y), np.int64)
    for c in (0, 1):
        place[y == c] = np.arange((y == c).sum())
    held = place % 4 == 3 if min(np.bincount(y, minlength=2)) >= 8 else np.zeros(len(y), bool)
    model = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    use = held if held.any() else ~held
    calibrate(model, [t for t, u in zip(texts, use, strict=True) if u], y[use], [c for c, u in zip(codes, use, strict=True) if u])
    model.language = language
    return model


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 if score >= 0.5) for every row.

    A null text is scored as an empty one.  Without a model every score is 0.  ``keep``
    must not hold the names of the two new columns; other columns of ``docs`` may have any name.
    """
    rows, names, schema = kept_and_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the parameters above

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        filters = model.table() if model else None
        for batch in sliced(batches, text):
            data, offsets = string_buffers(batch.column(text))
            scores = np.zeros(batch.num_rows)
            for a, z in row_blocks(offsets, BLOCK) if model else ():
                part = data[offsets[a] : offsets[z]]
                if len(part) > BLOCK and z == a + 1:
                    pooled = model.pooled_in_parts(part, filters)
                else:
                    pooled = model.pooled(*word_ids(part, offsets[a : z + 1] - offsets[a]), filters)
                languages = [language_id.UNKNOWN] * (z - a)
                if model.language:
                    x, _ = language_id.ngram_features(texts_of(batch.column(text).slice(a, z - a)))
                    languages = model.language.predict(x)[0]
                scores[a:z] = model.scores(pooled @ model.weights + model.offset, languages)
            columns = [*(batch.column(n) for n in names), pa.array(scores.astype(np.float64)), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    return rows.mapInArrow(task, f"{schema}, score double, predicted int")
