"""Language identification in two steps: the family first, then the language within it.

Features are hashed letter n-grams of the whole text.  A softmax over families comes
first; within a family, one-versus-one linear support vector machines vote.  The model is
fitted on a bounded sample of labelled rows and is a few hundred kB, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_and_text, sliced, texts_of

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"

#: Families of ISO 639-1 codes.  A code that is not listed is a family by itself.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro", "rm"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu", "se"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngram_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length feature rows (float32), and which texts have a letter.

    The counts of a very long text are those of its parts of ``BLOCK_CHARS``; n-grams over
    their few borders do not count.
    """
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    letters = np.zeros(len(texts), bool)
    table, first = letter_table(), 0
    while first < len(texts):
        last, size = first, 0
        if len(texts[first]) > BLOCK_CHARS:
            counts = np.zeros(DIMENSIONS)
            for at in range(0, len(texts[first]), BLOCK_CHARS):
                part, some = ngram_counts([texts[first][at : at + BLOCK_CHARS]], table)
                counts += part[0]
                letters[first] |= some[0]
            out[first] = np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-12)
            first += 1
            continue
        while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK_CHARS):
            size += len(texts[last])
            last += 1
        counts, letters[first:last] = ngram_counts(texts[first:last], table)
        rows = np.sqrt(counts)
        norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
        out[first:last] = rows / np.maximum(norm, 1e-12)
        first = last
    return out, letters


def ngram_counts(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each hashed n-gram occurs in each text, and which texts have a letter."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    is_letter = table[codes]
    letters = np.bincount(owner, is_letter, minlength=len(texts)) > 0
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    counts = np.zeros(len(texts) * DIMENSIONS)
    for n in ORDERS:
        if len(codes) < n:
            continue
        gram = np.full(len(codes) - n + 1, n, np.uint32)
        for i in range(n):
            gram = (gram ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
            gram ^= gram >> np.uint32(15)
        at = owner[: len(gram)]
        inside = at == owner[n - 1 :]
        index = at[inside] * DIMENSIONS + (gram[inside] % DIMENSIONS)
        counts += np.bincount(index, minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS), letters


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    balance = (len(y) / classes / np.maximum(np.bincount(y, minlength=classes), 1))[y][:, None]
    target, balance = np.eye(classes, dtype=np.float32)[y], balance.astype(np.float32)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (p - target) * balance / len(y)
        w -= rate * (x.T @ gap + decay * w)
        b -= rate * gap.sum(axis=0)
    return w, b


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 5.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss) for y in -1, 1, classes weighted alike."""
    w, b, y = np.zeros(x.shape[1], np.float32), 0.0, y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        pull = weight * y * slack
        step = rate / (1 + 0.01 * k)
        w += step * (x.T @ pull - decay * w)
        b += step * pull.sum()
    return w, b


@dataclass
class LanguageModel:
    families: list[list[str]]  # languages of each family
    family_weights: np.ndarray
    family_bias: np.ndarray
    machines: list[list[tuple[int, int, np.ndarray, float]]]  # of each family: language a, language b, weights, bias

    @staticmethod
    def fit(features: np.ndarray, languages: list[str]) -> LanguageModel | None:
        if not len(languages):
            return None
        family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
        grouped: dict[str, list[str]] = {}
        for code in sorted(set(languages)):
            grouped.setdefault(family_of.get(code, code), []).append(code)
        families = list(grouped.values())
        x = features
        family = np.array([next(i for i, f in enumerate(families) if code in f) for code in languages])
        weights, bias = fit_softmax(x, family, len(families))
        machines = []
        for codes in families:
            own = np.array([codes.index(c) if c in codes else -1 for c in languages])
            pairs = []
            for a, b in combinations(range(len(codes)), 2):
                rows = (own == a) | (own == b)
                pairs.append((a, b, *fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0))))
            machines.append(pairs)
        return LanguageModel(families, weights, bias, machines)

    def predict(self, features: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's probability times the mean certainty of its machines."""
        z = features @ self.family_weights + self.family_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        family = p.argmax(axis=1)
        languages = np.empty(len(features), object)
        scores = p.max(axis=1)
        for f, codes in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes, certain = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for a, b, w, bias in self.machines[f]:
                margin = features[rows] @ w + bias
                sure = 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50)))
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                certain[:, a] += sure
                certain[:, b] += 1 - sure
            best = (votes + certain / len(codes) / 2).argmax(axis=1)
            languages[rows] = np.array(codes, object)[best]
            if len(codes) > 1:
                scores[rows] *= certain[np.arange(len(rows)), best] / (len(codes) - 1)
        return languages.tolist(), scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 200, excerpts: int = 2, longest: int = 1 << 20) -> LanguageModel | None:
    """Fits on about ``per_language`` different texts of each language, chosen by hash; never over twice that in all.

    A text counts once, however many copies it has.  A text of over ``longest`` characters teaches nothing.  Each row teaches with its whole text and with ``excerpts`` passages of five words, so that
    the model also knows what short texts look like.
    Rows with a null text or language teach nothing.  Without labelled rows there is no model.
    """
    known = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    known = known.where(F.length("text") <= longest).withColumn("h", F.xxhash64("text", F.lit(11)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row for each language
    if not sizes:
        return None
    share = F.create_map(*(x for code, n in sizes.items() for x in (F.lit(code), F.lit(min(1.0, 1.1 * per_language / max(n, 1))))))
    drawn = F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts, codes = [], []
            for whole, code in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = whole.split()
                spots = [zlib.crc32(whole.encode("utf-8", "surrogatepass")) // (k + 1) % max(len(words), 1) for k in range(excerpts)]
                texts += [whole, *(" ".join(words[at : at + 5]) for at in spots)]
                codes += [code] * (1 + excerpts)
            x, _ = ngram_features(texts)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "features"])

    once = known.where(drawn).groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")
    sample = once.limit(2 * per_language * len(sizes)).mapInArrow(task, "lang string, features binary")
    rows = sorted(sample.collect())
    languages, features = [r["lang"] for r in rows], np.empty((len(rows), DIMENSIONS), np.float32)
    for k in range(len(rows)):
        features[k] = np.frombuffer(rows[k]["features"], np.float16)
        rows[k] = None
    return LanguageModel.fit(features, languages)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (0 to 1) for every row.

    A null text or one without a letter is ``und`` with score 0, and so is every text if
    there is no model.  ``keep`` must not hold the names of the two new columns; other
    columns of ``docs`` may have any name.
    """
    rows, names, schema = kept_and_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches, text):
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                x, letters = ngram_features(texts_of(part.column(text)))
                languages, scores = model.predict(x) if model and len(x) else ([UNKNOWN] * len(x), np.zeros(len(x)))
                languages = [code if ok else UNKNOWN for code, ok in zip(languages, letters, strict=True)]
                columns = [*(part.column(n) for n in names), pa.array(languages, pa.string()), pa.array(np.where(letters, scores, 0.0).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(task, f"{schema}, lang_pred string, score double")
