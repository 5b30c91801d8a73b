"""Models against plain loops, and the pipeline's stages against plain Python."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reliefgrid.llm import htmltext, langid, packing, quality, toxicity
from reliefgrid.llm.textbytes import LOWER


def _small_toxicity():
    make = np.random.default_rng(1)
    model = toxicity.Model(np.sort(make.choice(2**32, 40, replace=False)).astype(np.uint32))
    model.bias = make.normal(0, 0.3, len(model.bias)).astype(np.float32)
    model.embed = make.normal(0, 0.5, model.embed.shape).astype(np.float32)
    model.embed[-1] = 0
    keys = [make.choice(np.append(model.known, [1, 2, 3]), (n, 1 + len(toxicity.PREFIXES))).astype(np.uint32) for n in (1, 2, 7, 30)]
    return model, keys


def _plain_logit(model, keys):
    """Every filter at every word, by loops; places behind the end count as zeros."""
    known = {int(k): i for i, k in enumerate(model.known)}
    vectors = [sum((model.embed[known[int(k)]].astype(np.float64) for k in row if int(k) in known), np.zeros(toxicity.DIM)) for row in keys]
    pooled, column = [], 0
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for place in range(len(vectors)):
                total = float(model.bias[w * toxicity.FILTERS + f])
                for k in range(width):
                    if place + k < len(vectors):
                        total += float(vectors[place + k] @ model.filters[:, column + k * toxicity.FILTERS + f])
                best = max(best, total)
            pooled.append(max(best, 0.0))
        column += width * toxicity.FILTERS
    return float(np.array(pooled) @ model.out + model.base[0])


def test_toxicity_convolution_against_loops():
    model, keys = _small_toxicity()
    # Prefixes and words alike: a score takes all hashes of a word that are known.
    flat = np.concatenate(keys)
    flat[:, 0] = np.random.default_rng(2).permutation(np.arange(10, 10 + len(flat))).astype(np.uint32)
    parts = np.split(flat, np.cumsum([len(k) for k in keys])[:-1])
    first = np.concatenate([[0], np.cumsum([len(k) for k in parts])])
    logits, _ = model.logits(flat, first)
    assert np.allclose(logits, [_plain_logit(model, k) for k in parts], atol=1e-4)


@pytest.mark.parametrize("name", ["embed", "filters", "bias", "out", "base"])
def test_toxicity_gradients_against_differences(name):
    model, keys = _small_toxicity()
    for k in ("embed", "filters", "bias", "out", "base"):
        setattr(model, k, getattr(model, k).astype(np.float64))
    rows = np.concatenate([model.rows(k) for k in keys])
    first = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    labels, weights = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    grads = toxicity._pass(model, rows, first, labels, weights)

    def loss():
        vectors = model.embed[rows].sum(axis=1)
        projected = np.concatenate([vectors @ model.filters, np.zeros((1, model.filters.shape[1]))])
        out = np.zeros((len(rows), len(model.bias)))
        column = 0
        end = np.repeat(first[1:], np.diff(first))
        for w, width in enumerate(toxicity.WIDTHS):
            part = slice(w * toxicity.FILTERS, (w + 1) * toxicity.FILTERS)
            out[:, part] = model.bias[part]
            for k in range(width):
                at = np.arange(len(rows)) + k
                at = np.where(at < end, at, len(rows))
                out[:, part] += projected[:, column:column + toxicity.FILTERS][at]
                column += toxicity.FILTERS
        z = np.maximum(np.maximum.reduceat(out, first[:-1]), 0) @ model.out + model.base[0]
        p = 1 / (1 + np.exp(-z))
        base = -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean()
        return base + 0.5e-4 * (model.out**2).sum() + 0.5e-5 * (model.embed**2).sum()

    value, make = getattr(model, name), np.random.default_rng(5)
    for _ in range(12):
        at = tuple(make.integers(0, n) for n in value.shape)
        if name == "embed" and at[0] == len(model.embed) - 1:
            continue
        kept, step = value[at], 1e-4
        value[at] = kept + step
        high = loss()
        value[at] = kept - step
        low = loss()
        value[at] = kept
        assert abs((high - low) / (2 * step) - grads[name][at]) < 2e-3


def test_language_convolution_against_loops():
    make = np.random.default_rng(3)
    model = langid.Model(["aa", "bb", "cc"])
    model.bias = make.normal(0, 0.3, len(model.bias)).astype(np.float32)
    windows = np.zeros((3, 20), np.uint8)
    for row, text in zip(windows, (b"a", b"some words in here", b"12345678901234567890")):
        row[:len(text)] = LOWER[np.frombuffer(text, np.uint8)]
    found = model.log_probabilities(windows)
    for row, got in zip(windows, found):
        pooled = []
        for i, width in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                column = i * langid.FILTERS + f
                best = -np.inf
                for place in range(len(row)):
                    total = 0.0
                    for k in range(width):
                        if place + k < len(row):
                            weights = model.filters[k * langid.DIM:(k + 1) * langid.DIM, column].astype(np.float64)
                            total += float(model.embed[row[place + k]].astype(np.float64) @ weights)
                    best = max(best, total)
                pooled.append(max(best + float(model.bias[column]), 0.0))
        z = np.array(pooled) @ model.out.astype(np.float64) + model.base
        assert np.allclose(got, z - np.log(np.exp(z).sum()), atol=1e-4)


def test_marginals_against_enumeration():
    make = np.random.default_rng(4)
    model = htmltext.Model()
    model.unary = make.normal(0, 1, htmltext.BUCKETS)
    model.step = make.normal(0, 1, (2, 2, 2))
    sources = ["<div><p>One, two.</p><ul><li>a</ul>tail</div>", "x", "<p>a<p>b", ""]
    pages = [htmltext.parse(s) for s in sources]
    trees = htmltext.Trees(pages, [htmltext.signs(p) for p in pages])
    marginal, joint = htmltext.beliefs(model, trees)
    for page, low in zip(pages, trees.first.tolist()):
        n = len(page.parent)
        own = [sum(model.unary[s] for s in signs) for signs in htmltext.signs(page)]
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            score = sum(own[i] for i in range(n) if states[i])
            score += sum(model.step[int(page.tag[i] == "#text"), states[page.parent[i]], states[i]] for i in range(1, n))
            weight = np.exp(score)
            total += weight
            ones += weight * np.array(states)
            for i in range(1, n):
                pairs[i, states[page.parent[i]], states[i]] += weight
        assert np.allclose(marginal[low:low + n, 1], ones / total)
        assert np.allclose(joint[low + 1:low + n], pairs[1:] / total)


def test_views_are_fitted_to_their_optimum():
    """Newton's steps end where the slope of the penalised likelihood is zero; calibration keeps the order."""
    make = np.random.default_rng(6)
    x = make.normal(0, 1, (80, 3))
    y = (x[:, 0] + make.normal(0, 0.5, 80) > 0).astype(float)
    weight = make.random(80) + 0.5
    view = quality.View(3)
    view.fit(x, y, weight)
    design = view._design(x)
    p = 1 / (1 + np.exp(-design @ view.weights))
    ridge = np.ones(design.shape[1])
    ridge[-1] = 1e-3
    assert np.abs(design.T @ (weight * (p - y)) + ridge * view.weights).max() < 1e-4
    view.calibrate(x, y)
    assert (np.diff(view.calibrated(x)[np.argsort(view.logit(x))]) >= -1e-9).all()


def test_views_teach_each_other():
    """Unlabelled rows that one view is sure of reach the other one's fit: labels of a few rows carry over."""
    make = np.random.default_rng(7)
    truth = make.integers(0, 2, 400)
    content, meta = (truth[:, None] * 3 + make.normal(0, 0.6, (400, 2)) for _ in range(2))
    labels = np.where(np.arange(400) < 40, truth, -1)
    model = quality.co_train((content, meta), labels)
    p = model.scores(content, meta)
    assert ((p[:, 2] >= 0.5) == truth).mean() > 0.97
    assert np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()


def test_bins_against_a_quadratic_best_fit():
    make = random.Random(9)
    for _ in range(30):
        sizes = sorted((make.choice([1, 7, 100, 511, 512, 513, 900, 2048, 5000, 8192, make.randint(1, 8192)]) for _ in range(60)), reverse=True)
        room, used, opened, bins = [], [], [], []
        for i, size in enumerate(sizes):
            fits = [b for b in range(len(room)) if room[b] >= size]
            if fits:
                chosen = min(fits, key=lambda b: (room[b], b))
            else:
                left = sum(sizes[i:])
                capacity = min((c for c in packing.CAPACITIES if c >= size), key=lambda c: (packing.bin_cost(c) / min(c, left), -c))
                chosen = len(room)
                room.append(capacity)
                used.append(0)
                opened.append(capacity)
            bins.append(chosen)
            room[chosen] -= size
            used[chosen] += size
        found, places, final, contents = packing.pack_sizes(sizes)
        assert found == bins and contents == used
        assert final == [min(c for c in packing.CAPACITIES if c >= n) for n in used]
        for b in range(len(used)):
            own = [(p, s) for p, s, x in zip(places, sizes, bins) if x == b]
            assert [p for p, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]


CLEAN = ["river", "stone", "lamp", "window", "garden", "table", "paper", "cloud", "metal", "forest", "silver", "candle", "harbour", "meadow", "copper", "valley"]
TOXIC = ["grubble", "snarkon", "vexmire", "blightle"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, copies, benchmark passages and secrets; odd rows and clashing columns."""
    make = random.Random(12)
    root = tmp_path_factory.mktemp("corpus")
    plain = lambda n: [make.choice(CLEAN) + str(make.randint(0, 60)) for _ in range(n)]
    texts, labels = {}, {}
    for i in range(400):
        words = plain(make.randint(20, 60))
        if i % 4 == 0:
            for _ in range(4):
                words[make.randrange(len(words))] = make.choice(TOXIC) + make.choice(["", "s", "ed"])
        texts[i] = " ".join(words)
        if i % 3:
            labels[i] = int(i % 4 == 0)
    passage = plain(14)
    for i in range(400, 410):
        texts[i] = " ".join(plain(10) + passage[2:13] + plain(10))
    for i in range(410, 420):
        texts[i] = texts[i - 409] if i % 2 else texts[i - 409].upper()
    for i in range(420, 430):
        texts[i] = " ".join(plain(12)) + ' password = "hunter22x" ' + " ".join(plain(12))
    rows = [(i, t, "en", "s", len(t), 0.5, "spans", "items", "x", "y", 1) for i, t in texts.items()]
    rows += [(None, "river stone lamp", "en", "s", 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (900, None, "en", "s", 0, 0.1, "", "", "", "", 0), (901, "", "en", "s", 0, 0.1, "", "", "", "", 0)]
    # One id with two texts, and a repeated row.
    rows += [(902, "meadow lamp one two three", "en", "s", 1, 0.1, "a", "a", "a", "a", 0), (902, "copper valley four five six", "en", "s", 1, 0.1, "a", "a", "a", "a", 0), rows[1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, items string, _spans string, _blob string, n_words int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, None), (None, "river stone")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, passage


def _rows(df):
    return sorted(map(str, df.collect()))


def _set(text):
    words = (text or "").lower().split()
    return frozenset([tuple(words)]) if 0 < len(words) < 5 else frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def test_toxic_documents_go_and_clean_ones_stay(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, root)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    toxic = {i for i, t, *_ in rows if t and any(w in t.lower() for w in TOXIC)}
    assert not left & toxic
    assert left == {r[0] for r in rows} - toxic
    model = toxicity.train(docs, spark.read.parquet(f"{root}/labels.parquet"))
    again = toxicity.train(docs.repartition(7), spark.read.parquet(f"{root}/labels.parquet").repartition(5))
    keys, first = toxicity.word_keys(pa.array([r[1] for r in rows[:50]]))
    assert (model.score(keys, first) == again.score(keys, first)).all()


def test_one_of_each_group_of_copies_stays(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, root)
    got = kept.collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, set()).add(_set(t))
    gone = {i for i in sets if any(j < i and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]) for j in sets)}
    assert len(ids) == len(set(ids)) and set(ids) == set(sets) - gone
    assert sum(r.doc_id is None for r in got) == 2
    assert _rows(kept) == _rows(corpus_pipeline.drop_near_copies(spark, docs.repartition(5), root))


def test_documents_with_benchmark_passages_go(spark, corpus):
    root, rows, passage = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.drop_benchmark(spark, docs, root)
    item = " ".join(passage)
    windows = [" ".join(item.split()[i:i + 10]) for i in range(len(item.split()) - 9)]
    hit = lambda t: any(f" {w} " in f" {(t or '').lower()} " for w in windows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if not hit(r[1]))
    assert any(hit(r[1]) for r in rows)


def test_secrets_are_redacted_in_place(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = corpus_pipeline.redact_secrets(spark, docs, root)
    clean = lambda t: t if t is None else re.sub(r'password = "hunter22x', "<assign>", t)
    assert sorted(str((r.doc_id, r.text, r.n_chars, r._blob)) for r in kept.collect()) == sorted(
        str((r[0], clean(r[1]), len(clean(r[1]) or ""), r[9])) for r in rows)


def test_the_whole_pipeline(spark, corpus):
    root, rows, passage = corpus
    found = corpus_pipeline.run(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, root)
        assert docs.columns == spark.read.parquet(f"{root}/documents.parquet").columns and docs.count() <= before
    assert sorted(str(r[0]) for r in found.select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    lengths = {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id is not null").collect()}
    words = {r.doc_id: len((r.text or "").split()) + 1 for r in docs.where("doc_id is not null").collect()}
    assert lengths == words
    ids = set(words)
    assert 1 in ids and 5 in ids and not ids & set(range(0, 400, 4)) and not ids & set(range(400, 410))


def test_stages_of_empty_tables(spark, corpus, tmp_path):
    root, _, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, root).collect() == [], name
