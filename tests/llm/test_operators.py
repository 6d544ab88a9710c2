"""Each operator against plain Python on small tables with nulls, ties, repeats, long and empty texts, and clashing columns."""

from __future__ import annotations

import hashlib
import math
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from resonarium.llm import blocks, decontaminate, embeddings, langid, lines, mixing, pii, sharding, simhash, substring, warc
from resonarium.llm.graph import components
from resonarium.session import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, fp string, spans int"


def docs_of(spark, texts, ids=None, lang="en", source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source if not callable(source) else source(k), len(t or ""), "clash", 1, "x", 2) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def some_texts(seed=0, n=40):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = base + [base[0], base[1] + " x", passage, "a " + passage + " b", base[2][:40] + " " + passage, None, "", "  \t\n", "One", "one  TWO"]
    out.append(" ".join(words * 400))
    return out


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def plain_print(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark):
    texts = some_texts() + ["Alpha beta gamma", "alpha BETA gamma"]
    got = {r["id"]: r for r in simhash.classes(docs_of(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    u = Union()
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                u.join(i, j)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i]["fp"] & (2**64 - 1) == prints[i]
        assert got[i]["component_id"] == u.find(i)


def test_simhash_tiles_keep_every_link(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = a[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([a, near]))
    from resonarium.session import Scratch

    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(df, Scratch(spark, "t"), 3, tile=16).collect()
    u, v = Union(), Union()
    for r in found:
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3
        u.join(r["a"], r["b"])
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if int(x ^ y).bit_count() <= 3:
                v.join(int(np.int64(x.view(np.int64))), int(np.int64(y.view(np.int64))))
    for x in fps.view(np.int64).tolist():
        assert u.find(x) == v.find(x)


def test_simhash_nulls_repeats_and_empty_table(spark):
    rows = simhash.classes(docs_of(spark, ["a b c", "a b c", "a b c", None], [None, 5, 5, None])).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["component_id"] or -1) for r in rows) == [(False, 5, 5), (False, 5, 5), (True, 0, -1), (True, 0, 5)]
    assert simhash.classes(docs_of(spark, [])).count() == 0


def plain_substring(rows, window=20):
    first, out = {}, {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k]
        w = (t or "").encode().split()
        gone, mine = [False] * len(w), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in mine or (key in first and first[key] != (i is None, i or 0)):
                gone[s : s + window] = [True] * window
            first.setdefault(key, (i is None, i or 0))
            mine.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_substring_matches_brute_force(spark, block):
    texts = some_texts(3)
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    ids[4], ids[7] = None, ids[8]
    got = substring.dedup(docs_of(spark, texts, ids), block_bytes=block)
    want = plain_substring(list(zip(ids, texts)))
    rows = got.collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str) == want
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def test_substring_edges(spark):
    assert substring.dedup(docs_of(spark, [])).count() == 0
    same = "q " * 30
    rows = substring.dedup(docs_of(spark, [same, same], [1, 1])).collect()
    assert [r["n_removed"] for r in rows] == [29, 29]  # each keeps its first occurrence, which overlaps its repeats
    with pytest.raises(ValueError):
        substring.dedup(docs_of(spark, ["a"]), window=10)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["v%d" % k for k in range(30)] + ["été", "x1", "The"]
    bench = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 20, 13, 5, 1)] + [None, "", "...", "v1"]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    texts += [bench[0].upper(), "zz " + bench[1] + " yy", "q. " + bench[2].replace(" ", ", ") + "!", bench[3], None, "", "--", " ".join(bench[0].split()[:13]) + " k" * 300]
    bdf = spark.createDataFrame([(k, t, 1) for k, t in enumerate(bench)], "item_id long, text string, n_hit int")
    got = {r["id"]: r for r in decontaminate.contamination(docs_of(spark, texts), bdf).collect()}
    sliced = {r["id"]: r for r in decontaminate.contamination(docs_of(spark, texts), bdf, slice_bytes=40).collect()}
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: split.findall((t or "").encode().lower())
    windows = {}
    for k, t in enumerate(bench):
        w = cut(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(k))
    for i, t in enumerate(texts):
        w, items = cut(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if ks := windows.get(tuple(w[s : s + n])):
                    items |= ks
                    hit[s : s + n] = [True] * n
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want = (len(w), sum(hit), len(items), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w))
        for found in (got, sliced):
            r = found[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(docs_of(spark, texts), empty).collect()} == {0}
    assert decontaminate.contamination(docs_of(spark, []), bdf).count() == 0


def test_index_phrases_and_proximity(spark):
    index = decontaminate.build_index(docs_of(spark, ["the cat sat on the mat", "a mat for the cat", "cat", "sat sat sat cat"])).cache()
    assert sorted((r["id"], r["position"]) for r in decontaminate.phrases(index, ["The CAT"]).collect()) == [(0, 0), (1, 3)]
    near = {r["id"] for r in decontaminate.proximity(index, ["cat mat"], 4).collect()}
    assert near == {0, 1} if 5 - 1 <= 4 else {1}
    assert decontaminate.proximity(index, ["cat dog"], 4).count() == 0


def plain_grams(t):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t or "")
    words, c = low.split(), Counter()
    for w in words:
        c.update((0, ord(x)) for x in w)
    s = " " + " ".join(words) + " " if words else ""
    z = lambda x: 0 if x == " " else ord(x)
    c.update((1, z(a), z(b)) for a, b in zip(s, s[1:]))
    c.update((2, z(a), z(b), z(d)) for a, b, d in zip(s, s[1:], s[2:]) if b != " ")
    return c


def code(k):
    return (k[1] << 42) + 0x1FFFFE + (k[2] << 21) if k[0] == 1 else (k[1] << 42) + 0x1FFFFF if k[0] == 0 else (k[1] << 42) + (k[2] << 21) + k[3]


def test_language_id_matches_brute_force(spark):
    rng = random.Random(4)
    pools = {"aa": ["la", "lalo", "ola", "lo"], "bb": ["kri", "krak", "íkr", "kra"]}
    rows = [(i, " ".join(rng.choice(pools[g]) for _ in range(40)), g) for i in range(40) for g in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa"), (101, "12 34 --", "bb"), (102, "", None), (None, "la lo", "aa"), (103, "kri krak", None), (104, "漢字 ǅ ß", None)]
    df = spark.createDataFrame([(i, t, g, "aa") for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {(r["doc_id"], r["held_out"]): r for r in langid.identify(df, profile=15).collect()}
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    total = {}
    for i, t, g in rows:
        if i is not None and not held(i) and g is not None and t is not None:
            total.setdefault(g, Counter()).update(plain_grams(t))
    prof = {g: [code(k) for k, _ in sorted(c.items(), key=lambda kv: (-kv[1], code(kv[0])))[:15]] for g, c in total.items()}
    for i, t, _ in rows:
        top = [code(k) for k, _ in sorted(plain_grams(t).items(), key=lambda kv: (-kv[1], kv[0]))[:15]]
        far = {g: sum(abs(p.index(x) - n) if x in p else 15 for n, x in enumerate(top)) for g, p in sorted(prof.items())}
        best = min(far, key=far.get) if top else "und"
        r = got[(i, held(i))]
        assert r["lang_pred"] == best
        assert math.isclose(r["score"], max(0, 1 - far[best] / (15 * len(top))) if top else 0, abs_tol=1e-12)
    assert {r["lang_pred"] for r in langid.identify(df.where("false").unionByName(df.where("lang is null"))).collect()} == {"und"}


def test_mixing_budgets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", [None, "a", "b", "c", "b"][i % 5]) for i in range(300)]
    rows += [(5, None, "en", "a"), (None, "x y", "en", "zz"), (None, "x y", "en", "zz"), (7, "dup dup", "en", "b"), (7, "dup dup", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit(1)).withColumn("cut", F.lit(2))
    out = mixing.assign(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    free, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in out:
        assert r["mix_source_size"] == sizes[r["source"]] and math.isclose(r["mix_target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    for s in names:
        assert abs(taken[s] - target[s]) < 3
    mixed = mixing.emit(df, mixing.assign(df))
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == +taken
    assert mixing.assign(df.where("false")).count() == 0
    again = mixing.assign(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["mix_size"], r["mix_taken"])
    assert sorted(map(key, again)) == sorted(map(key, out))


def plain_lines(rows):
    seen, docs = {}, {}
    for i, t in rows:
        docs.setdefault((i, t or ""), None)
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            x = line.strip(" ").lower()
            if x:
                seen.setdefault(x, []).append(((i is None, i or 0), k, (i, t)))
    names = list(seen)
    runs = [{x} if len(x) <= 5 else {x[k : k + 5] for k in range(len(x) - 4)} for x in names]
    u = Union()
    for a in range(len(names)):
        u.find(a)
        for b in range(a):
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
                u.join(a, b)
    groups, gone = {}, Counter()
    for a, x in enumerate(names):
        groups.setdefault(u.find(a), []).extend(seen[x])
    for places in groups.values():
        for p in sorted(places, key=lambda p: (p[0], p[1]))[1:]:
            gone[p[2]] += 1
    return {d: (len(d[1].split("\n")), gone[d]) for d in docs}


def test_lines_match_brute_force(spark):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consetetur", "sadip", "elitr", "sed", "diam"]
    base = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(30)]
    texts = ["\n".join(rng.sample(base, 4)) for _ in range(20)]
    texts += [base[0] + " more\n" + base[1].upper() + "\n\n" + "tiny", "tiny\nabc\n  tiny  \n\n", None, "", "漢字" * 40 + "\n" + "漢字" * 40 + "の", "z" * 5000, "z" * 5001]
    for k in range(60):  # a large family of near copies
        w = base[2].split()
        w[k % 25] = "edit%d" % k
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    ids[3] = None
    df = docs_of(spark, texts + [texts[0]], ids + [0])
    got = {r["doc"]: (r["n_lines"], len(r["gone"])) for r in lines.removed(df).collect()}
    want = plain_lines(list(zip(ids, texts)))
    hashes = spark.createDataFrame([(i, t) for i, t in want], "i long, t string").select("i", "t", F.xxhash64("i", "t").alias("doc")).collect()
    assert {r["doc"]: want[(r["i"], r["t"])] for r in hashes} == got
    cleaned = lines.dedup(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(texts) + 1
    assert lines.removed(docs_of(spark, [])).count() == 0


def test_lines_of_a_family_without_a_centre(spark):
    rng = random.Random(4)
    texts = ["posted by admin on march %04d" % k for k in rng.sample(range(1000, 10000), 300)]
    for k in range(0, 240, 3):  # chains of lines of which only neighbours are near
        texts.append("copyright " + "".join("%x" % (k // 3 + j) for j in range(30)) + " all rights reserved")
    df = docs_of(spark, texts)
    want = plain_lines(list(enumerate(texts)))
    for how in ({}, {"cell": 50}, {"few": 10**6}, {"few": 2, "cell": 50}):  # pairs as rows, in cells, and in many cells
        assert sum(len(r["gone"]) for r in lines.removed(df, **how).collect()) == sum(g for _, g in want.values())


def test_cells_say_what_pairs_say(monkeypatch):
    rng = random.Random(5)
    line = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 5, 30, 60])))
    many = [chr(c) for c in range(0x4E00, 0x9000)]  # more letters than five of fit into a word
    for letters in ("ab", "abcdefgh", many):
        left, right = [line(letters) for _ in range(70)], [line(letters) for _ in range(50)]
        right[:20] = [x + "q" for x in left[:20]]
        sets = [[{x[k : k + 5].ljust(5, "\0") for k in range(max(1, len(x) - 4))} for x in side] for side in (left, right)]
        want = np.array([[len(x & y) >= 0.8 * len(x | y) for y in sets[1]] for x in sets[0]])
        for listed in (0, 10, 10**6):
            monkeypatch.setattr(lines, "LISTED", listed)
            monkeypatch.setattr(lines, "COLUMNS", 7)
            monkeypatch.setattr(lines, "LISTED_AT_ONCE", 50)
            monkeypatch.setattr(lines, "ROWS", 16)
            assert (np.concatenate(list(lines.close_sides(left, right, 0.8))) == want).all()
        x, y = np.nonzero(np.ones_like(want))
        assert (lines.close([left[k] for k in x], [right[k] for k in y], 0.8) == want.ravel()).all()
    a, b = lines.forest(np.array([5, 7, 9, 5, 1]), np.array([7, 9, 5, 9, 2]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (7, 5), (9, 5)]
    assert [len(x) for x in lines.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_short_lines_with_edits_are_found(spark):
    rng = random.Random(6)
    letters, texts, sets = "abcdefghijklmnopqrstuvwxyz ", [], lambda x: {x[k : k + 5] for k in range(len(x) - 4)}
    while len(texts) < 1200:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(25, 60))).strip()
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            b[rng.choice([0, 1, -1, -2, rng.randrange(len(a))])] = rng.choice(letters[:-1])
        x, y = sets(a), sets("".join(b))
        if a != "".join(b) and len(x & y) >= 0.8 * len(x | y):
            texts += [a, "".join(b)]
    assert sum(len(r["gone"]) for r in lines.removed(docs_of(spark, texts)).collect()) == len(texts) // 2


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in s) % 10 == 0
        return 10 <= len(d) <= 15 if kind == "phone" else True

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "", re.A) if fine(kind, m.group()))


def test_pii_matches_brute_force(spark):
    rng = random.Random(11)
    alphabet = "a1.@-+ ()é😀5_%"
    texts = ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(150)]
    texts += ["a@b.c_d@e.f g@h..i j@k.l.m", "1.2.3.4.5 256.1.1.1 001.02.3.0255 " + "9" * 30 + ".1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 " + "7" * 30, "+1 (555) 010-9999. +49.30.1234567890123 +1((((", None, "", "x@y.z " * 700, "5 " * 20000, "1" * 30000]
    for r in pii.find(docs_of(spark, texts)).collect():
        assert [(s["start"], s["rank"], s["end"]) for s in r["spans"] if s["rank"] < 4] == plain_pii(texts[r["id"]])
        for s in r["spans"]:
            assert (texts[r["id"]] or "")[s["start"] : s["end"]] == s["text"]
    found = pii.find(docs_of(spark, ["IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 not GB82WEST12345698765433"])).first()["spans"]
    assert [(s["kind"], s["text"]) for s in found] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert found[0]["score"] > found[1]["score"] - 1e-9
    clean = pii.redact(docs_of(spark, ["mail é@x a@b.cc, 4111111111111111!", None])).orderBy("id").collect()
    assert [r["text"] for r in clean] == ["mail é@x <email>, <card>!", ""]
    assert pii.find(docs_of(spark, [])).count() == 0


def test_pii_is_native(spark):
    plan = pii.find(docs_of(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for k in range(60, 160):
        b = k % 20
        rows.append((k, (base[b] + rng.standard_normal(16) * 0.05).tolist(), int(b % 3)))
    rows += [(200 + k, base[5].tolist(), 2) for k in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, base[0].tolist(), None), (305, [], 1), (306, base[0][:8].tolist(), 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("vec", F.lit("z"))
    got = {r["id"]: r for r in embeddings.near_duplicates(df, cell=16).collect()}
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    u, n = Union(), Counter()
    for a in range(len(good)):
        for b in range(a):
            (i, x, g), (j, y, h) = good[a], good[b]
            if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                u.join(i, j)
                n[i] += 1
                n[j] += 1
    assert len(got) == len({r[0] for r in rows})
    for i, *_ in rows:
        if i is None:
            assert got[i]["n_links"] == 0 and got[i]["component_id"] is None
        else:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], u.find(i), u.find(i) == i)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_sql_says_the_same(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 16))
    rows = [(k, (base[k % 20] + rng.standard_normal(16) * 0.06).tolist(), int(k % 20 % 3)) for k in range(120)] + [(200 + k, base[5].tolist(), 2) for k in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, base[0].tolist(), None), (305, [], 1), (306, base[0][:8].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op1_embeddings(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(embeddings.OP1_SQL).fetchall())
    assert any(n for _, n, *_ in got) and any(not kept for *_, kept in got)


RECORDS = "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, body string, status string, slice int"


def test_revisits(spark):
    full = {"etag": '"a"', "content-type": "text/html", "date": "1"}
    rows = [
        (1, "response", "http://www.X.org:80/p/?b=2&a=1&utm_source=z#f", 10, full, "d1", "one"),
        (2, "response", "https://x.org/p?a=1&b=2", 20, full | {"etag": '"b"'}, "d2", "two"),
        (3, "revisit", "http://x.org/p?a=1&b=2", 15, {"etag": 'W/"a"', "date": "5", "content-length": "0"}, None, None),
        (4, "revisit", "http://x.org/p?a=1&b=2", 25, {"etag": '"a"'}, "d2", None),
        (5, "revisit", "http://x.org/p?a=1&b=2", 25, None, "d2", None),
        (6, "revisit", "http://x.org/p?a=1&b=2", 25, {}, None, None),
        (7, "revisit", "http://x.org/p?a=1&b=2", 5, {"etag": '"a"'}, None, None),
        (8, "revisit", None, 50, {"etag": '"a"'}, None, None),
        (9, "revisit", "http://x.org/q", None, {"etag": '"a"'}, None, None),
        (10, "revisit", "//x.org/p?a=1&b=2", 20, {}, "d2", None),
        (0, "revisit", "//x.org/p?a=1&b=2", 20, {}, "d1", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], RECORDS)
    for slices in (1, 3, 1024):
        got = {r["record_id"]: r for r in warc.resolve(df, slices).collect()}
        assert {k: (v["target_id"], v["status"], v["body"]) for k, v in got.items()} == {
            3: (1, "resolved", "one"), 4: (2, "mismatch", None), 5: (2, "resolved", "two"), 6: (2, "unverified", "two"), 7: (None, "unresolved", None),
            8: (None, "unresolved", None), 9: (None, "unresolved", None), 10: (2, "resolved", "two"), 0: (1, "resolved", "one"),
        }
        assert got[3]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "date": "5"}
    assert warc.resolve(df.where("false")).count() == 0


def test_shards_round_trip(spark, tmp_path):
    df = docs_of(spark, some_texts(n=400))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(5):
        store.append(df.where(F.pmod("doc_id", F.lit(5)) == k).repartition(3), rows_each=20)
    before = store.manifest()
    version = store.compact(target=200_000)
    after = store.manifest()
    assert version == 6 and len(after) < len(before) and sum(s.rows for s in after) == df.count()
    back = store.read().select(*df.columns)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
    assert store.read(5).count() == df.count()  # the version before is still whole
    with pytest.raises(sharding.Conflict):
        store.commit(after, base=version - 1)
    store.expire()
    assert store.versions() == [version] and store.read().count() == df.count()
    again = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert again.read().count() == df.count()
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    empty.append(df.where("false"))
    assert empty.compact() == 1 and empty.read().count() == 0


def test_lines_of_long_words_and_shared_heads(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for n, size, edits in ((6, 10, 1), (5, 15, 1), (8, 9, 1), (12, 8, 2)):
        for _ in range(60):
            a = [word(size) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), edits):
                b[k] = rng.choice("0123456789") + b[k][1:]
            texts += [" ".join(a), " ".join(b)]
    heads = [word(8) for _ in range(6)]
    for _ in range(200):  # a family that shares the heads of its words
        a = [h + word(7) for h in heads]
        texts += [" ".join(a), " ".join([*a[:-1], a[-1][:-1] + "9"])]
    want = sum(g for _, g in plain_lines(list(enumerate(texts))).values())
    got = sum(len(r["gone"]) for r in lines.removed(docs_of(spark, texts)).collect())
    assert want > 300 and 0.99 * want <= got <= want


def test_clashing_columns_of_a_shard_store(spark, tmp_path):
    df = spark.createDataFrame([(k, "t", 7, "p", "r") for k in range(10)], "doc_id long, text string, shard int, _path string, shard_rows string")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(df)
    got = store.read()
    assert got.columns == [*df.columns, "shard_", "shard_rows_", "shard_bytes"]
    assert got.select(*df.columns).exceptAll(df).count() == 0 and got.count() == 10


def test_compaction_of_several_tiers(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    noise = F.sha2(F.col("doc_id").cast("string"), 512)
    for k in range(4):
        store.append(spark.range(6000).select(F.col("id").alias("doc_id"), noise.alias("text")).repartition(1), rows_each=6000)
    for k in range(8):
        store.append(spark.range(40).select(F.col("id").alias("doc_id"), noise.alias("text")).repartition(1))
    tiers = {store.tier(s.bytes, 1_000_000, 4) for s in store.manifest()}
    assert len(tiers) == 2
    files = lambda: [p for p in (tmp_path / "s" / "data").rglob("*.parquet")]
    store.compact(target=1_000_000)
    assert not store.plan(1_000_000) and store.read().count() == 24320
    store.expire()
    assert len(files()) == len(store.manifest())


def test_revisits_of_repeated_record_ids(spark):
    rows = [
        (1, "response", "http://x.org/", 10, {"etag": '"a"'}, "d1", "one"),
        (1, "response", "http://x.org/", 10, {"etag": '"b"'}, "d2", "two"),
        (1, "response", "http://x.org/", 10, {"etag": '"b"'}, "d2", "more"),
        (2, "revisit", "http://x.org/", 11, {}, "d2", None),
        (2, "revisit", "http://x.org/", 11, {}, "d2", None),
        (3, "revisit", "http://x.org/", 11, {}, "d1", None),
    ]
    rows += [(k, "response", "http://y.org/", 10**12, {}, None, "far") for k in range(4, 6)]  # an outlier in time
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], RECORDS)
    for table in (df, df.repartition(5)):
        got = sorted((r["record_id"], r["status"], r["body"]) for r in warc.resolve(table).select("record_id", "status", F.coalesce("body", F.lit("")).alias("body")).collect())
        assert got == [(2, "resolved", "more"), (2, "resolved", "more"), (3, "mismatch", "")]


def test_embeddings_of_extreme_size(spark):
    rows = [(0, [2e-170, 1e-175], 0), (1, [1e-170, 0.0], 0), (2, [1e200, 1e200], 0), (3, [3e200, 3e200], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1.7e308], 0)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (1, 2), 3: (1, 2), 4: (2, 0), 5: (0, 5)}


def test_account_numbers_beside_other_words(spark):
    texts = ["BE68539007547034 PAID", "pay BE68 5390 0754 7034 OK", "BE68539007547034.", "XX68539007547034", "BE685390075470341", "NO9386011117947"]
    found = {r["id"]: [(s["text"], round(s["score"], 2)) for s in r["spans"] if s["kind"] == "iban"] for r in pii.find(docs_of(spark, texts)).collect()}
    assert found == {0: [("BE68539007547034", 0.9)], 1: [("BE68 5390 0754 7034", 0.9)], 2: [("BE68539007547034", 0.9)], 3: [], 4: [], 5: [("NO9386011117947", 0.9)]}


def test_proximity_does_not_depend_on_shards(spark):
    docs = docs_of(spark, ["cat dog", "dog x x cat dog", "cat y y y y y y dog", "dog dog dog", "x cat"])
    found = [sorted((r["id"], r["position"]) for r in decontaminate.proximity(decontaminate.build_index(d, size=size), ["cat dog"], 2).collect()) for d in (docs.coalesce(1), docs.repartition(5)) for size in (1, 10**6)]
    assert found[0] == [(0, 0), (1, 3)] and all(f == found[0] for f in found)


def test_long_words_of_like_bytes_stay_apart():
    word = "ab"
    for _ in range(11):
        word = word + word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    from resonarium.llm import kernels

    text = f"{word} {other}".encode()
    starts, ends, _ = kernels.word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    codes = kernels.word_codes(np.frombuffer(text, np.uint8), starts, ends)
    assert codes[0] != codes[1]


def test_components_of_more_edges_than_a_sum_of_hashes_holds(spark):
    n = 1_100_000  # a sum of 44-bit hashes overflows at about 1,048,576 edges
    edges = spark.range(n).selectExpr("2 * id as a", "2 * id + 1 as b").union(spark.range(9).selectExpr("2 * id as a", "2 * id + 2 as b"))
    found = components(edges, Scratch(spark, "many"))
    assert found.count() == 2 * n
    assert found.agg(F.count_distinct("root")).first()[0] == n - 9 and found.where("node <= 19").agg(F.max("root")).first()[0] == 0


def test_few_outer_lines_do_not_copy_a_family(spark):
    n, outer = 400, 3  # one bucket: a component of 397 lines and three lines outside
    mixed = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("h"), F.when(F.col("id") < outer, F.col("id")).otherwise(10**6).alias("root"), F.lit(10**6).alias("main"))
    texts = spark.range(n).select(F.col("id").alias("h"), F.format_string("line %d", "id").alias("norm"))
    rows = lines.cells(mixed, texts, 50).collect()
    assert len(rows) <= n + 8 * outer  # eight copies of each line before
    met = Counter()
    for far in (r for r in rows if r["far"]):
        met.update({(r["h"], far["h"]) for r in rows if not r["far"] and (r["l"], r["r"]) == (far["l"], far["r"])})
    assert all(met[(h, o)] or met[(o, h)] for h in range(n) for o in range(outer) if h != o)


def test_small_values_come_back():
    for values in ([], [0], [255, 3], [1 << 40, 5], [-1, 7]):
        x = np.array(values, np.int64)
        assert (blocks.widest(blocks.narrowed(x), len(x)) == x).all()


def test_near_lines_alike_in_hash_bits_of_two_blocks(spark):
    tops, pair = {}, None  # lines of one family, two of which agree in the 15 highest bits of their hashes
    for k in itertools.count(10**6):
        x = "a notice of some length that all of its copies share but for a number %d at their ends" % k
        h = xxhash.xxh3_64_intdigest(x.encode()) >> 49
        if h in tops:
            pair = (tops[h], x)
            break
        tops[h] = x
    docs = docs_of(spark, [pair[0]], [1]).union(docs_of(spark, [pair[1]], [2]))  # a block each
    assert {r["id"]: list(r["gone"]) for r in lines.removed(docs).collect()} == {1: [], 2: [0]}


def test_empty_bins_borrow_turn_by_turn():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 44, (40, lines.BINS))
    for row, n in zip(own, [1, 2, 3, 30, 63, 64, 65, 66, 100, 190, 191, 192] * 4):
        row[rng.permutation(lines.BINS)[n:]] = lines.NONE
    want = own.copy()
    for row, col in zip(*np.nonzero(own == lines.NONE)):
        turn = 1
        while want[row, col] == lines.NONE:
            want[row, col] = own[row, int(lines.K.mixed(lines.BORROW[col : col + 1] * np.uint64(turn))[0] % np.uint64(lines.BINS))]
            turn += 1
    assert (lines.filled(own) == want).all()
