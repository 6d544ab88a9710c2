"""Secrets against plain Python: base spans by re, the models by counting, and held-out strings of both kinds."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string as chars
from collections import Counter

import pytest

from resonarium.llm import leaks

SCHEMA = "doc_id long, text string, id long, spans string, m string, step int"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]


def ratio(s, model):
    codes = [ord(c) - leaks.LOW for c in s]
    return sum(model[a * leaks.SYMBOLS + b] for a, b in zip(codes, codes[1:]) if 0 <= a < leaks.SYMBOLS and 0 <= b < leaks.SYMBOLS)


def all_spans(t, model):
    out = base_spans(t)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        s = m.group()
        if len(s) >= leaks.LEAST_LENGTH and re.search("[A-Za-z]", s) and ratio(s, model) >= max(leaks.LEAST_RATIO, leaks.LEAST_MEAN * (len(s) - 1)):
            out.append((m.start(), 3, m.end(), "random"))
    return sorted(out)


def words(rng, n):
    parts = ["tion", "er", "the", "an", "ou", "get", "Value", "_", "in", "st", "re", "user", "Name", "list"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def key(rng, n, letters=chars.ascii_letters + chars.digits + "+/"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    hexes = "0123456789abcdef"
    pieces = [
        lambda: f'token = "{key(rng, 40, hexes)}"',
        lambda: "AKIA" + key(rng, rng.choice([15, 16, 30]), chars.ascii_uppercase + chars.digits),
        lambda: key(rng, rng.choice([23, 24, 64]), hexes),
        lambda: f"API_KEY:{key(rng, rng.choice([5, 6, 20]))}",
        lambda: f"passwd='{rng.choice(['short', 'longer', 'ä'])}'",
        lambda: "token: token: abcdefgh",
        lambda: "ſecret=abcdefgh Token  =  == x",
        lambda: key(rng, 32),
        lambda: "=" * 40 + "0" * 30,
        lambda: "théàΔ\U0001f600",
    ]
    texts = [" ".join(w if rng.random() < 0.9 else rng.choice(pieces)() for w in words(rng, rng.choice([0, 3, 60, 200]))) for _ in range(80)]
    texts += ["", None, " ", "token" * 3000 + " " * 3000 + "=x", "a" * 200_000, "f0" * 100_000, "AKIA" * 5000, "\n".join(key(rng, 44) for _ in range(700))]
    return [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None)]


def found(spark, rows, model):
    frame = spark.createDataFrame([(*r, 5, "x", "y", 9) for r in rows], SCHEMA)
    return [(r.id, [(s.start, s.rank, s.end, s.kind) for s in r.spans], [s.text for s in r.spans]) for r in leaks.find(frame, model).collect()]


def test_labelled_and_trained(spark, docs):
    frame = spark.createDataFrame([(*r, 5, "x", "y", 9) for r in docs], SCHEMA)
    ids = sorted({i for i, _ in docs if i is not None}, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:20]
    want = set()
    for i, t in docs:
        if i in ids and t:
            rest = t
            for p in (ASSIGN, re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")):
                rest = p.sub(" ", rest)
            for w in re.findall("[A-Za-z0-9+/_=-]+", rest):
                if 3 <= len(w) <= 15:
                    want |= {(w, False), (base64.b64encode(hashlib.sha256(w.encode()).digest()).decode(), True), (hashlib.md5(w.encode()).hexdigest(), True)}
            want |= {(ASSIGN.match(t, a).group(2) if k == "assign" else t[a:b], True) for a, _, b, k in base_spans(t)}
    samples = leaks.labelled(frame, sample=20)
    assert sorted(tuple(r) for r in samples.collect()) == sorted(want)
    counts = {r: Counter((a, b) for s, x in want if x == r for a, b in zip(s, s[1:]) if all(0 <= ord(c) - leaks.LOW < leaks.SYMBOLS for c in a + b)) for r in (True, False)}
    model = leaks.train(samples)
    for a, b in [("t", "h"), ("a", "7"), ("Q", "z"), ("+", "+"), ("e", "r")]:
        alone = [(sum(n for (_, y), n in counts[r].items() if y == b) + 0.5) / (sum(counts[r].values()) + 40) for r in (True, False)]
        p = [(counts[r][a, b] + 20 * u) / (sum(n for (x, _), n in counts[r].items() if x == a) + 20) for r, u in zip((True, False), alone)]
        assert model[(ord(a) - 43) * 80 + ord(b) - 43] == max(-3000, min(3000, round(1000 * math.log(p[0] / p[1]))))


def test_spans_like_plain_python(spark, docs):
    frame = spark.createDataFrame([(*r, 5, "x", "y", 9) for r in docs], SCHEMA)
    model = leaks.train(leaks.labelled(frame))
    got, by_rank = found(spark, docs, model), lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    want = [(i, all_spans(t or "", model)) for i, t in docs]
    assert sorted([(i, s) for i, s, _ in got], key=by_rank) == sorted(want, key=by_rank)
    texts = {(i, t or "") for i, t in docs}
    assert all(any(x == [t[a:b] for a, _, b, _ in s] for j, t in texts if j == i) for i, s, x in got)
    assert sum(any(k == "random" for *_, k in s) for _, s, _ in got) > 5


def test_held_out_strings(spark):
    rng = random.Random(11)
    frame = spark.createDataFrame([(i, " ".join(words(rng, 300))) for i in range(40)], "doc_id long, text string")
    model = leaks.train(leaks.labelled(frame))
    keys = [key(rng, rng.randint(20, 60)) for _ in range(400)] + [key(rng, 40, "0123456789abcdef") for _ in range(200)]
    plain = ["_".join(words(rng, 3))[:60] for _ in range(600)]
    got = {i: s for i, s, _ in found(spark, list(enumerate(keys + plain)), model)}
    caught = sum(any(x[3] == "random" for x in got[i]) for i in range(len(keys)))
    wrong = sum(bool(got[i]) for i in range(len(keys), len(keys) + len(plain)))
    assert caught >= 0.98 * len(keys) and wrong == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = leaks.train(leaks.labelled(empty))
    assert not any(model) and leaks.find(empty, model).count() == 0
    assert found(spark, [(1, "x9Kq2LmZ7vB4nT8sWq1R password=abc123")], model) == [(1, [(21, 0, 36, "assign")], ["password=abc123"])]


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "a token=" + "0f" * 20 + " é b"), (2, None), (3, "none")], "doc_id long, text string")
    assert {r.id: r.text for r in leaks.redact(frame, [0] * leaks.SYMBOLS**2).collect()} == {1: "a <secret> é b", 2: "", 3: "none"}


def test_native(spark, docs):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = leaks.find(frame, [0] * leaks.SYMBOLS**2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
