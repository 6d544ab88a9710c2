"""Tries against every beginning counted in plain Python, with subtries small enough to be taken apart often."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from resonarium.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, key string, home long, turns string"


def plain(rows, graft):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), code, len(text.encode())))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    if graft:
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - int(c - 5 * int(c / 5)), [])[:h] + v[h:]
        own = built
    nodes = defaultdict(list)
    for c, v in own.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            below[p[:-1]] += 1
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(nodes[p]) - 1) * (p[-1][1] if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(own[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), below[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()))


def found(spark, rows, graft, **bounds):
    frame = spark.createDataFrame([(*r, "k", 5, "t") for r in rows], SCHEMA)
    turns = tries.grafted(frame) if graft else tries.plain(frame)
    return sorted(tuple(-1 if x is None else x for x in r) for r in tries.trie(turns, **bounds).collect())


def sample():
    rng = random.Random(2)
    says = [("user", "hi"), ("assistant", "é" * 9), ("user", None), (None, "hi"), ("user", ""), ("us", "erhi"), ("system", "x" * 4000)]
    rows = []
    for c in [*range(-7, 60), *range(100, 400, 3), 10**15]:
        turns = [rng.choice(says[: rng.choice([1, 2, 7])]) for _ in range(rng.choice([1, 2, 3, 8, 20]))]
        if 100 < c < 250:  # copies, and near ones
            turns = [says[k % 7] for k in range(12)] + ([says[c % 4]] if c % 2 else [])
        rows += [(c, k if k != 3 else None, *t) for k, t in enumerate(turns)]
    rows += [rows[0], (5, 0, "user", "same turn"), (None, 1, "user", "nobody's"), (77, 2, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("graft", [True, False])
def test_like_every_beginning(spark, graft):
    rows = sample()
    assert found(spark, rows, graft) == plain(rows, graft)


def test_subtries_taken_apart(spark, monkeypatch):
    rows, want = sample(), plain(sample(), True)
    assert found(spark, rows, True, fewest=15, most=15) == want
    monkeypatch.setattr(tries, "BROADCAST_STEMS", -1)
    assert found(spark, rows, True, fewest=40, most=40) == want


def test_long_and_shared_conversations(spark):
    long = [(1, k, "user", f"turn {k}") for k in range(3000)] + [(2, k, "user", f"turn {k}") for k in range(2999)]
    rows = long + [(c, k, "user", f"same {k}") for c in range(10, 5000) for k in range(2)] + [(c, 2, "user", f"own {c % 50}") for c in range(10, 300)]
    got = found(spark, rows, False, fewest=100, most=100)
    assert got == plain(rows, False)
    assert max(r[1] for r in got) == 3000


def test_nothing(spark):
    assert found(spark, [], True) == [] and found(spark, [(None, 1, "a", "b")], True) == []
    lone = [(3, 0, "user", "only turn")]  # its first turns are given away, and there is no one to take them from
    assert found(spark, lone, True) == plain(lone, True)
    assert any(len(plain([(c, 0, "user", "x")], True)) == 1 for c in (1, 2, 3, 4))
    several = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]
    assert found(spark, several, True) == plain(several, True)


def test_ids_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(tries, "SPAN", 10)
    rows = [(c, 0, "user", "hello") for c in range(-50, 500)]
    got = found(spark, rows, False)
    assert got == plain(rows, False) and got[1][7] == hashlib.sha256(",".join(map(str, range(-50, 500))).encode()).hexdigest()
