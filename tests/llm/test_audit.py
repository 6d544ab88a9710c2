"""The audit of filters against filters applied one after the other in plain Python."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from resonarium.llm import audit

DOCS = "doc_id long, text string, lang string, part string, n long, mask int, good int, place int, text_key string"
LABELS = "doc_id long, quality int, toxic int, n string"


def plain(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for ident, text, lang in docs:
        t, fails = text or "", set()
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if ident is not None and any(i is not None and i < ident and (x or "") == t for i, x, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, ident))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone_before = mine, []
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(kept),
                    len(gone),
                    sum(f in r[1] for r in gone_before),
                    sum(r[1] == {f} for r in mine),
                    sum(r[2] in good for r in gone),
                    sum(r[2] in toxic for r in gone),
                ]
                left, gone_before = kept, gone_before + gone
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shares[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = [(*d, "x", 7, 99, 5, 3, "k") for d in docs]
    found = audit.report(*audit.mask_counts(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(*x, "y") for x in labels], LABELS)))
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in found.collect()}


def sample():
    rng = random.Random(5)
    bag = [f"w{i}" for i in range(400)] + ["ÀÉ", "ABC", "Δδ", "a|b", "é"]
    texts = [" ".join(rng.choice(bag[: rng.choice([20, 405])]) for _ in range(rng.choice([0, 1, 99, 100, 101, 300]))) for _ in range(60)]
    texts += ["", None, "X" * 50_000, "  one two\x0bthree", "CAPS " * 150]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(150)]
    docs += [(7, docs[7][1], "en"), docs[8], docs[8], (None, docs[3][1], "en"), (None, "own text", None), (-4, docs[9][1], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)]
    return docs, [*labels, (4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]


def test_like_one_after_the_other(spark):
    docs, labels = sample()
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, None)], []) == plain([(1, None, None)], [])


def test_a_text_that_most_documents_hold(spark):
    docs = [(i, "the same text", "en") for i in range(3000, 0, -1)]
    got = audited(spark, docs, [(1, 1, 0), (2, 1, 1)])
    assert got["en", "EABCD", 1] == (1, 2999, 0, 0, 1, 1, 2999 * 60)  # every one fails A as well, all but the first fail both
    assert got["en", "AEBCD", 2] == (0, 0, 2999, 0, 0, 0, 2999 * 60)


def test_polynomial_and_shares(spark):
    counts = [("p", 0, 5, 0, 0), ("p", 5, 7, 2, 1), ("p", 3, 11, 1, 0), ("p", 4, 2, 0, 2)]
    frame = spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")
    poly = audit.polynomials(frame, 3)
    c = poly.first()["n"]
    for corner in range(8):  # each corner by the definition
        assert sum(c[t - 1] for t in range(1, 8) if t & corner == t) == sum(n for _, m, n, _, _ in counts if m & corner)
    got = poly.select(audit.shapley(F.col("n"), 3).alias("s")).first()["s"]
    assert got == [6 * sum(Fraction(n, bin(m).count("1")) for _, m, n, _, _ in counts if m >> i & 1) for i in range(3)]


def test_other_filters_and_limits(spark):
    docs = spark.createDataFrame([(1, "a b", "p"), (2, "a", "p"), (3, None, "p")], "k long, body string, src string")
    short = lambda m: {"S": m("words") < 2}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.report(*audit.mask_counts(docs, labels, short, None, "k", "body", "src")).collect()
    assert [tuple(r) for r in got] == [("p", "S", 1, 1, 2, 0, 2, 0, 0, 2)]
    with pytest.raises(ValueError):
        audit.report(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "AA")
