"""Quality by co-training: two classifiers over different views teach each other.

One view is the content of a text (shares of kinds of characters, repetition, word lengths), the
other its page metadata (source, language, length, line structure). Each round both are fitted
and the texts that one view is most sure of join the other's training set. Their scores are then
calibrated on labelled texts held back, and combined.

Features are read from all texts in one pass and kept as a narrow table; fitting takes a bounded
sample of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import SPACED, Words, slices, text_bytes
from reliefgrid.session import cut

CONTENT = ("alpha", "upper", "digit", "punct", "high", "space", "mean_word", "odd_words", "distinct", "most_common", "shout", "doubled")
META = ("log_chars", "lines", "mean_line", "short_lines", "repeated_lines")
#: Buckets of hashed sources and languages in the metadata view.
HASHED = 64
SAMPLE = 6000
ROUNDS = 5

_SPACE = ~SPACED
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_PUNCT = ~(_SPACE | _LETTER | _DIGIT | _HIGH) & (np.arange(256) > 32)


def _features(texts: pa.Array) -> np.ndarray:
    """Both views of every text, content first; zeros for an empty text."""
    data, offsets = text_bytes(texts)
    words = Words(texts, SPACED)
    n, size = len(texts), np.maximum(np.diff(offsets), 1)
    def per_text(flags):
        total = np.concatenate(([0], np.cumsum(flags)))
        return np.diff(total[offsets])

    def per_word(flags):
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[words.ends] - total[words.starts]

    def of_words(values):
        total = np.concatenate(([0.0], np.cumsum(values)))
        return np.diff(total[words.first]) / count

    out = np.zeros((n, len(CONTENT) + len(META)))
    count = np.maximum(words.counts, 1)
    for i, flags in enumerate((_LETTER, _UPPER, _DIGIT, _PUNCT, _HIGH, _SPACE)):
        out[:, i] = per_text(flags[data]) / size
    length = words.ends - words.starts
    letters = per_word((_LETTER | _HIGH)[data])
    capitals = per_word(_UPPER[data])
    out[:, 6] = of_words(np.minimum(length, 50))
    out[:, 7] = of_words(length - letters >= 2)
    out[:, 10] = of_words((capitals >= 2) & (capitals == per_word(_LETTER[data])))
    same = np.concatenate(([False], words.hashes[1:] == words.hashes[:-1])) if len(length) else np.zeros(0, bool)
    same[words.first[:-1][words.counts > 0]] = False
    out[:, 11] = of_words(same)
    line_end = np.flatnonzero(data == 10)
    for row in range(n):
        own = words.hashes[words.first[row]:words.first[row + 1]]
        if len(own):
            _, seen = np.unique(own, return_counts=True)
            out[row, 8] = len(seen) / len(own)
            out[row, 9] = seen.max() / len(own)
        low, high = offsets[row], offsets[row + 1]
        if high > low:
            breaks = line_end[np.searchsorted(line_end, low):np.searchsorted(line_end, high)]
            edges = np.concatenate(([low - 1], breaks, [high]))
            lines = np.diff(edges) - 1
            k = len(CONTENT)
            out[row, k] = np.log1p(high - low)
            out[row, k + 1] = np.log1p(len(lines))
            out[row, k + 2] = np.log1p(lines.mean())
            out[row, k + 3] = (lines < 40).mean()
            if len(lines) > 1:
                # Positions of words tell lines apart without cutting out their bytes.
                total = np.concatenate(([0], np.cumsum(own)))
                at = np.searchsorted(words.starts[words.first[row]:words.first[row + 1]], np.append(edges[:-1] + 1, high))
                sums = total[at[1:]] - total[at[:-1]]
                out[row, k + 4] = 1 - len(np.unique(sums)) / len(sums)
    return out


def _feature_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n = batch.column(0), batch.num_columns
        for begin, end in slices(texts):
            values = _features(texts.slice(begin, end - begin))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in range(1, n)), rows], [*batch.schema.names[1:], "features"])


def feature_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """``id, source, lang, features`` of every row, the last two hashed into buckets."""
    bucket = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(HASHED // 2)).cast("int")
    columns = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), bucket(source_col, 1).alias("source"), bucket(lang_col, 2).alias("lang"))
    return columns.mapInArrow(_feature_rows, "id long, source int, lang int, features array<double>")


class View:
    """A logistic model over standardised features and their squares."""

    def __init__(self, columns: int) -> None:
        self.mean, self.scale = np.zeros(columns), np.ones(columns)
        self.weights, self.slope, self.shift = np.zeros(2 * columns + 1), 1.0, 0.0

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        design = self._design(x)
        w = np.zeros(design.shape[1])
        ridge = np.full(len(w), 1.0)
        ridge[-1] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            slope = design.T @ (weight * (p - y)) + ridge * w
            curve = (design * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on labelled rows that the model was not fitted on."""
        z = np.clip(self.logit(x), -20, 20)
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - target) * z).sum() + 2 * (a - 1), (p - target).sum() + 0.1 * b])
            d = np.maximum(p * (1 - p), 1e-4)
            h = np.array([[(d * z * z).sum() + 2, (d * z).sum()], [(d * z).sum(), d.sum() + 0.1]])
            step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = max(a, 1e-3), b

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


class CoTrained:
    def __init__(self, content: View, meta: View, mixed: np.ndarray, constant: float | None = None) -> None:
        self.content, self.meta, self.mixed, self.constant = content, meta, mixed, constant

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probabilities of the two views and of both together."""
        if self.constant is not None:
            return np.full((len(content), 3), self.constant)
        z = np.stack([self.content.calibrated(content), self.meta.calibrated(meta)], axis=1)
        both = z @ self.mixed[:2] + self.mixed[2]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([z, both[:, None]], axis=1), -30, 30)))


def _views(source: np.ndarray, lang: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, half = len(CONTENT), HASHED // 2
    meta = np.zeros((len(features), len(META) + HASHED))
    meta[:, :len(META)] = features[:, k:]
    row = np.arange(len(features))
    meta[row, len(META) + source] = 1
    meta[row, len(META) + half + lang] = 1
    return features[:, :k], meta


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> CoTrained:
    """Fits both views; ``labels`` is -1 where a row has none."""
    known = np.flatnonzero(labels >= 0)
    models = (View(views[0].shape[1]), View(views[1].shape[1]))
    if len(set(labels[known].tolist())) < 2:
        return CoTrained(*models, np.zeros(3), float(labels[known].mean()) if len(known) else 0.5)
    random = np.random.default_rng(seed)
    held = random.random(len(known)) < 0.25
    if len(set(labels[known[held]].tolist())) < 2 or len(set(labels[known[~held]].tolist())) < 2:
        held[:] = False
    judge = known[held] if held.any() else known
    pool = set(np.flatnonzero(labels < 0).tolist())
    own = [{int(i): (float(labels[i]), 1.0) for i in known[~held]} for _ in models]
    for turn in range(rounds + 1):
        for model, view, rows in zip(models, views, own):
            at = np.fromiter(rows, np.int64, len(rows))
            y, w = np.array([rows[int(i)] for i in at]).T
            model.fit(view[at], y, w)
            model.calibrate(view[judge], labels[judge])
        if turn == rounds or not pool:
            break
        open_rows = np.fromiter(pool, np.int64, len(pool))
        for i, (model, view) in enumerate(zip(models, views)):
            z = model.calibrated(view[open_rows])
            share = labels[known].mean()
            want = max(1, len(open_rows) // 20)
            # The surest of each class, in the share that the labels have, if sure enough.
            order = np.argsort(z)
            low = [j for j in order[:max(1, int(want * (1 - share)))] if z[j] < -2]
            high = [j for j in order[::-1][:max(1, int(want * share))] if z[j] > 2]
            for j, y in [*((j, 0.0) for j in low), *((j, 1.0) for j in high)]:
                row = int(open_rows[j])
                own[1 - i][row] = (y, 0.5)
                pool.discard(row)
    z = np.stack([m.calibrated(v[judge]) for m, v in zip(models, views)], axis=1)
    # A logistic mixture of the two calibrated logits, close to their sum where little is known.
    design = np.concatenate([np.clip(z, -10, 10), np.ones((len(z), 1))], axis=1)
    mixed, prior = np.array([1.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ mixed, -30, 30)))
        slope = design.T @ (p - labels[judge]) + mixed - prior
        curve = (design * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ design + np.eye(3)
        mixed = mixed - np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    mixed[:2] = np.maximum(mixed[:2], 0)
    return CoTrained(*models, mixed)


def _score_rows(batches, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        source, lang = (batch.column(i).to_numpy() for i in (1, 2))
        features = np.stack(batch.column(3).to_numpy(zero_copy_only=False))
        p = np.round(model.value.scores(*_views(source, lang, features)), 9)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(3))], ["id", "p_content", "p_metadata", "score"])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``id, p_content, p_metadata, score`` for every row of ``docs``; 1 is good.

    The fit takes at most ``sample`` labelled and ``sample`` unlabelled rows, chosen by a hash of
    ids. Nulls count as empty texts, sources and languages; labels other than 0 and 1 as none. With
    labels of one class only the score is that class's share; without labels it is 0.5. Repeated
    rows are returned each; further columns are ignored; an empty table gives no rows.
    """
    from functools import partial

    rows = cut(feature_table(docs, id_col, text_col, source_col, lang_col))
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64(F.lit(9), "_id"), "_id"]
    chosen = marks.orderBy(*order).limit(sample)
    # Of rows with one id, the one with the smallest hash is fitted on.
    columns = rows.columns

    def one_each(picked: DataFrame, *label: str) -> DataFrame:
        own = picked.groupBy("id", *label).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("own"))
        return own.select("own.*", *label)

    with_label = one_each(rows.join(chosen, F.col("id") == F.col("_id")), "label")
    others = rows.where("id is not null").select(F.col("id").alias("_id")).join(marks, "_id", "left_anti").orderBy(*order).limit(sample)
    without = one_each(rows.join(others.distinct(), F.col("id") == F.col("_id"))).withColumn("label", F.lit(-1))
    table = with_label.unionByName(without).toPandas().sort_values(["label", "id"], kind="stable")
    if len(table):
        views = _views(table["source"].to_numpy(), table["lang"].to_numpy(), np.stack(table["features"].to_numpy()))
        model = co_train(views, table["label"].to_numpy())
    else:
        model = CoTrained(View(1), View(1), np.zeros(3), 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_score_rows, model=shared), "id long, p_content double, p_metadata double, score double").withColumnRenamed("id", id_col)
