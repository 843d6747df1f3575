"""The prefix trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from locusflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows):
    logs: dict[int, list] = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            raw = f"{len(role.encode())}:{role}{text}".encode()
            logs.setdefault(conv_id, []).append((turn is not None, turn or 0, hashlib.sha256(raw).digest(), (role, text)))
    logs = {c: [x[-1] for x in sorted(log)] for c, log in logs.items()}
    whole = {}
    for c, log in logs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(logs.get(c - c % 20, [])[:h] + log[h:])
    members: dict[tuple, list] = {}
    for c, log in whole.items():
        for d in range(len(log) + 1):
            members.setdefault(log[:d], []).append(c)
    out = []
    for key, convs in members.items():
        under = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in under if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members)]
        saved = sum((len(members[k]) - 1) * len((k[-1][1] if k else "").encode().split()) for k in under)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(key))))
        children = sum(len(k) == len(key) + 1 for k in under)
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), 110):
        turns = rng.randrange(0, 9)
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t > 1 else "user", rng.choice(["a b", "c", "", None, "é ü x"])) for t in range(turns)]
    return rows


def result(frame, block=prefix_trie.BLOCK):
    out = prefix_trie.prefix_trie(frame, block)
    assert out.columns == COLUMNS
    assert all(t == "bigint" for c, t in out.dtypes if c != "ends_sha256")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, prefix_trie.BLOCK), (2, 2), (3, 1)])
def test_against_plain_loops(spark, seed, block):
    """Blocks of one and two turns cross the borders that long conversations cross."""
    rows = some_conversations(seed)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS node", "2 AS n", "true AS leaf", "'y' AS digest").repartition(3)
    assert result(frame, block) == trie(rows)


def test_null_turns_ties_and_repeated_rows(spark):
    rows = [(20, None, "user", "z"), (20, None, "user", "b"), (20, 5, None, "b"), (20, 5, "user", None), (20, 5, "user", None), (21, 0, "user", "b"), (21, -70, "user", "first"), (None, 0, "user", "left out"), (41, 3, None, None)]
    rows += [(c, 0, "user", "the same") for c in range(100, 140)] + [(c, 1, "assistant", "too") for c in range(100, 140, 3)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == trie(rows)


def test_a_long_conversation_and_its_prefixes(spark):
    """Turns over many blocks and slices; subtree sums need no pair of nodes."""
    long = [(c, t, "user", f"t {t}") for c, n in ((60, 700), (80, 699), (100, 64), (120, 65), (140, 700)) for t in range(n)]
    rows = long + [(160, 0, "user", "x" * 200_000 + " y")]
    out = result(spark.createDataFrame(rows, SCHEMA), 50)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (60, 80, 100, 120, 140)}
    assert h  # openers are rebuilt from themselves
    root = next(r for r in out if r[1] == 0)
    assert root[3:6] == (6, 2, 2)
    shared = [5, 5, *[5] * 62, *[4], *[3] * 634, 2]
    assert root[6] == sum(2 * (n - 1) for n in shared)
    assert [r[0] for r in out if r[1] == 700] == [60] and next(r for r in out if r[1] == 700)[-1] == hashlib.sha256(b"60,140").hexdigest()


def test_end_lists_over_ranges_of_ids(spark):
    """A frequent conversation whose ids lie in several ranges, among negative ones too."""
    ids = [-5, -70_000, 0, 3, 65_535, 65_536, 65_540, 10**12, 200_000, 200_003]
    ends = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 7)], "node binary, conv_id long").repartition(4)
    found = {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.end_lists(ends).collect()}
    assert found == {b"a": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


def test_turnless_conversations_and_empty_tables(spark):
    """A conversation whose own turns are all replaced, by none."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "gone")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert result(spark.createDataFrame([], SCHEMA)) == [] and result(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
