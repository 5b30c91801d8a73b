"""Centroid clustering, sanitisation and spelling variants against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefgrid.llm import centroids, sanitise, spelling


def _clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))
    centres = [r[1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    done = [(i, *nearest(v)[::-1]) for i, v, _ in kept]
    own = Counter()
    for _, c, d in done:
        own[c] += d
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, fits(d), fits(own[c]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in done]


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("dims, n, k", [(4, 200, 5), (3, 7, 16), (2, 120, 6)])
@pytest.mark.parametrize("wide", [False, True])
def test_clusters(spark, dims, n, k, wide):
    make = np.random.default_rng(dims)
    vectors = make.normal(0, 0.1, (n, dims)) + make.integers(-3, 4, (n, 1)) * (dims != 3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (5, [3.0] * dims), (None, None), (900, [None] * dims), (901, [math.nan] + [0.0] * (dims - 1)), (902, [1.0] * (dims + 1))]
    if wide:
        rows += [(7777, [1e30] + [0.0] * (dims - 1)), (7778, [-2e9] * dims), (7779, [3e38] * dims)]
    table = spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, lower double").repartition(3)
    plain = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in table.collect()]
    found = centroids.cluster(table, k=k, dims=dims).collect()
    assert sorted((tuple(r)[:6] for r in found), key=_key) == sorted(_clusters(plain, k, 3, dims), key=_key)
    assert all(1 <= r.scans <= 4 for r in found)


def test_drift_bounds_spare_scans_and_hold(spark):
    """In groups that stand apart most vectors are scanned once; the bound is never below what is true."""
    make = np.random.default_rng(3)
    rows = [(i, [float(x) for x in make.normal(0, 0.3, 4) + (i % 3) * 40]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = centroids.cluster(table, k=3, dims=4, rounds=5).collect()
    assert sum(r.scans for r in found) < 600 * 6
    for _ in range(300):
        centre, before, after = make.normal(0, 5, 3), make.normal(0, 5, 3), make.normal(0, 5, 3)
        radius = float(abs(make.normal(0, 2)))
        bound = centroids.drift_bound(centre, radius, before, after)
        points = make.normal(0, 1, (200, 3))
        points = centre + radius * points / np.sqrt((points**2).sum(axis=1, keepdims=True)) * make.random((200, 1)) ** 0.2
        gain = np.sqrt(((points - before) ** 2).sum(axis=1)) - np.sqrt(((points - after) ** 2).sum(axis=1))
        assert gain.max() <= bound + 1e-9
    # Seen from afar and sideways, the bound is far below the drift.
    assert centroids.drift_bound(np.array([0.0, 100.0]), 1.0, np.array([-1.0, 0.0]), np.array([1.0, 0.0])) < 0.1


def test_clusters_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


_PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
          ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base(text):
    out = []
    for number, (kind, pattern) in enumerate(_PLAIN):
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (
                    kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((number, kind, m.start(), m.end()))
    return out


def test_personal_data_against_plain_patterns(spark):
    make = random.Random(5)
    parts = ["a.b@c-d.org", "@", ".", "é", " ", "x_y@z@q.co.uk", "1.2.3.4", "256.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (323) 555-9830", "+12",
             "00.01.002.0255", "-", "9", "12 34", "_", "%", "+", "(", "\n", "中", "http://a.b/c@d.e"]
    texts = ["".join(make.choice(parts) for _ in range(make.randint(0, 25))) for _ in range(400)] + [None, "", "1" * 30_000, "x" * 30_000 + "@", "1." * 3000, "+1" + "." * 20_000]
    rows = [(make.choice([i, i, 7, None]), t, "k", b"b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, blob binary").repartition(4)
    found = sanitise.find(docs).collect()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), str([(s.number, s.kind, s.begin, s.end) for s in r.spans if s.kind != "term"])) for r in found)
    assert got == sorted((-1 if i is None else i, str(_base(t))) for i, t, _, _ in rows)
    assert sanitise.find(docs.limit(0)).collect() == []


def test_terms_that_reveal(spark):
    """A term that stands next to one entity only discloses it; common words and clean texts stay."""
    rows = [(i, f"report {i} on ordinary things and the weather") for i in range(60)]
    rows += [(100, "the Sinclairson estate wrote from j.s@estate.example.org on things"), (101, "again Sinclairson of j.s@estate.example.org and the weather"),
             (102, "the Sinclairsen house wrote"), (103, "Sinclair and others"), (104, None), (105, "at 10.0.0.1 the Sinclairson")]
    rows += [(200 + i, f"Sinc{x} seen") for i, x in enumerate("abcdefghijklmnop" * 2)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, label string, marks int")
    found = {r.doc_id: r.spans for r in sanitise.find(docs).collect()}
    text = dict(rows)
    terms = {i: [(text[i][s.begin:s.end], s.label) for s in spans if s.kind == "term"] for i, spans in found.items()}
    assert ("Sinclairson", "sinc*") in terms[100] and ("Sinclairson", "sinc*") in terms[101]
    assert all(w not in ("the", "and", "things") for own in terms.values() for w, _ in own)
    # Without the entity in the text there is nothing to protect in it.
    assert all(not terms[i] for i in [*range(60), 102, 103, 104])
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert clean[100].startswith("the sinc* ") and "<email>" in clean[100] and "Sinclairson" not in clean[101]
    assert clean[104] is None and clean[3] == text[3]
    assert sanitise.sanitise(docs).columns == docs.columns


def test_sanitise_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y 1.2.3.4@a.b"), (1, "x +4111 1111 1111 1111 y 1.2.3.4@a.b")], "doc_id long, text string")
    assert {r.text for r in sanitise.sanitise(docs).collect()} == {"x +<card> y <email>"}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(docs, factor=5, least=6, count=5):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = spelling.worn(doc, "".join(x.lower() if "A" <= x <= "Z" else x for x in run))
            if len(word) >= least:
                seen[word] += 1
    words = {w: n for w, n in seen.items() if n >= count}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("shard", [1 << 19, 150])
def test_spelling_variants(spark, shard):
    make = random.Random(shard)
    base = ["".join(make.choice("abcé") for _ in range(make.randint(5, 8))) for _ in range(25)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(make.randint(0, 30)):
            w = base[int(make.random() ** 3 * 25)]
            for _ in range(make.choice([0, 0, 0, 0, 1, 2])):
                p = make.randrange(len(w))
                w = make.choice([w[:p] + w[p + 1:], w[:p] + make.choice("abcÉ") + w[p:], w[:p].upper() + make.choice("abc") + w[p + 1:]])
            words.append(w)
        docs.append((make.choice([i, i, 5]), make.choice([" ", ", ", "1"]).join(words)))
    docs += [(None, None), (None, "abcabc " * 9), (3, ""), (4, "a" * 5000 + " " + "b" * 7000 + " " + "a" * 5001)] * 6
    # A chain of forms: each five times as frequent as the one before.
    docs += [(9, "zzzzzz " * 5), (10, "zzzzzy " * 25), (11, "zzzzxy " * 125), (12, "zzzwxy " * 625)]
    table = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, word string, n int").repartition(3)
    found = {tuple(r) for r in spelling.group_variants(table, shard_chars=shard).collect()}
    assert found == _variants(docs)
    assert any(w == "zzzzzz" and root == "zzzwxy" for w, _, root, *_ in found)
    assert spelling.group_variants(table.limit(0)).collect() == []


def test_search_scheme_finds_each_pair_once():
    make = random.Random(2)
    words = sorted({"".join(make.choice("abé") for _ in range(make.randint(6, 9))) for _ in range(400)})
    index = spelling.Index(words)
    asked = words + ["bbbbbb", "xyzxyz"]
    own, near = spelling.search(index, asked, np.array([len(w) // 2 for w in asked]))
    pairs = [(asked[i], words[j]) for i, j in zip(own.tolist(), near.tolist())]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in asked for b in words if _near(a, b) and b.startswith(a[:len(a) // 2])}


def test_words_of_long_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, ("Wörter×÷ " * 6) + "ÀÉÎ" * 3 + " IJK_lmnopq"), (2, "x" * 200_000)] + [(3, None)], "doc_id long, text string")
    found = {r.word: r.n for r in spelling.vocabulary(docs, least_count=1).collect()}
    expected = Counter(spelling.worn(1, w) for w in ["wörter×÷"] * 6 + ["ÀÉÎ" * 3, "lmnopq"]) + Counter([spelling.worn(2, "x" * 200_000)])
    assert found == {w: n for w, n in expected.items() if len(w) >= 6}
    assert docs.where(F.col("doc_id") == 3).count() == 1
