"""Plain single-machine versions of the corpus operators, to compare with."""

from __future__ import annotations

import hashlib


def remove_repeats(texts: list[str | None], length: int = 400) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256 of the kept bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            key = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text: str | None, words: int = 4) -> int:
    import re

    import xxhash

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_classes(ids: list, prints: list[int], distance: int = 4) -> list:
    """Smallest id reachable from each row."""
    least: dict[int, object] = {}
    for i, p in zip(ids, prints, strict=True):
        known = [x for x in (least.get(p), i) if x is not None]
        least[p] = min(known) if known else None
    nodes, seen, out = list(least), set(), {}
    for n in nodes:
        if n in seen:
            continue
        stack, group = [n], []
        seen.add(n)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in nodes:
                if y not in seen and (x ^ y).bit_count() <= distance:
                    seen.add(y)
                    stack.append(y)
        known = [least[x] for x in group if least[x] is not None]
        for x in group:
            out[x] = min(known) if known else None
    return [out[p] for p in prints]


def check_packing(rows, ids_of: dict, size: int = 2048) -> int:
    """Asserts that packed pieces are whole, right and gapless; returns the number of sequences."""
    import zlib

    import numpy as np

    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, pieces in by_doc.items():
        ids, at = np.array([*ids_of[doc], 0], "<u4"), 0
        pieces.sort(key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert len(pieces) == 1 or k == 0 or r.length == size
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence)


def mixed(h: int) -> int:
    h ^= h >> 32
    for _ in range(2):
        h = h * 0xD6E8FEB86659FD93 % 2**64
        h ^= h >> 32
    return h


def language(text: str | None, model) -> tuple[str, float]:
    """The language of a text and its score: hashed n-grams, the likeliest family, then votes of pairs."""
    import math

    text = (text or "").lower()
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    letters = [c.isalpha() for c in text]
    codes = [ord(c) if letters[i] else 32 for i, c in enumerate(text) if i == 0 or letters[i] or letters[i - 1]]
    counts: dict[int, int] = {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            gram = n
            for c in codes[i : i + n]:
                gram = (gram ^ c) * 0x9E3779B1 % 2**32
                gram ^= gram >> 15
            counts[gram % 4096] = counts.get(gram % 4096, 0) + 1
    size = math.sqrt(sum(counts.values()))
    x = {k: math.sqrt(v) / size for k, v in counts.items()}

    def product(weights):
        return sum(v * float(weights[k]) for k, v in x.items())

    z = [product(model.family_weights[:, f]) + float(model.family_bias[f]) for f in range(len(model.families))]
    p = [math.exp(v - max(z)) for v in z]
    family = z.index(max(z))
    codes_, score = model.families[family], p[family] / sum(p)
    votes, certain = [0] * len(codes_), [0.0] * len(codes_)
    for a, b, w, bias in model.machines[family]:
        margin = product(w) + float(bias)
        sure = 1 / (1 + math.exp(-max(-50.0, min(50.0, 4 * margin))))
        votes[a if margin >= 0 else b] += 1
        certain[a] += sure
        certain[b] += 1 - sure
    best = max(range(len(codes_)), key=lambda k: votes[k] + certain[k] / len(codes_) / 2)
    return codes_[best], score * certain[best] / (len(codes_) - 1) if len(codes_) > 1 else score


def toxicity(text: str | None, model, hasher, code: str) -> float:
    """The score of a text: words and stems, each filter at each place, the largest values, a logistic unit."""
    import re

    import numpy as np

    def number(raw: bytes) -> int:
        total, power = 0, 1
        for b in raw:
            total += int(hasher.table[b]) * power
            power = power * int(hasher.base) % 2**64
        return mixed(total % 2**64)

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    vectors = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", raw):
        v = model.embedding[number(word) % 65535 + 1].astype(float)
        for stem in (4, 5, 6, 7, 8):
            if len(word) > stem:
                v = v + model.embedding[mixed((number(word[:stem]) + stem) % 2**64) % 65535 + 1]
        vectors.append(v)
    vectors += [np.zeros(model.embedding.shape[1])] * 3
    pooled = []
    for f in model.filters:
        starts = range(max(len(vectors) - 2, 1))
        pooled.append(np.max([sum(vectors[s + k] @ f[k] for k in range(len(f))) for s in starts], axis=0))
    h = np.maximum(np.concatenate(pooled) + model.bias, 0)
    z = float(h @ model.weights) + model.offset
    return 1 / (1 + np.exp(-np.clip(model.scale * (z - model.thresholds.get(code, model.thresholds.get(None, 0.0))), -50, 50)))


def merge_dropout(text: str, key: int, seed: int, dropout: float, pieces) -> list[int]:
    """Piece ids of a text of known characters: the best merge that is not skipped, one at a time."""
    marked = " " + text if text else ""
    limit = int(dropout * 2**64)
    own = mixed((key + seed * 0x9E3779B97F4A7C15) % 2**64)
    spans = [(i, i + 1, int(pieces.symbol[ord(c)])) for i, c in enumerate(marked)]
    starts = {0} | {i for i in range(1, len(marked)) if marked[i] == " " and marked[i - 1] != " "}

    def skipped(a: int, b: int, c: int) -> bool:
        return mixed((own + a * 0x9E3779B97F4A7C15 + (b - a) * 0xC2B2AE3D27D4EB4F + (c - b) * 0x165667B19E3779F9) % 2**64) < limit

    while True:
        found = []
        for i, ((a, b, x), (_, c, y)) in enumerate(zip(spans, spans[1:], strict=False)):
            new = pieces.merges.get(x << 15 | y)
            if b not in starts and new is not None and not skipped(a, b, c):
                found.append((int(pieces.rank[new]), i, new))
        if not found:
            return [x for _, _, x in spans]
        _, i, new = min(found)
        spans[i : i + 2] = [(spans[i][0], spans[i + 1][1], new)]
