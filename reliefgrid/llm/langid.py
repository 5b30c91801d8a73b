"""Language identification by a byte convolutional network, trained in numpy.

Bytes have small embeddings; filters of several widths run over windows of fixed length and are
pooled by their maximum; a softmax layer tells the languages. A text is cut into windows whole,
and its windows' log-probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import LOWER, slices, text_bytes
from reliefgrid.llm.toxicity import _Adam
from reliefgrid.session import cut

WINDOW = 256
DIM = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled texts of each language that a model is fitted on, at most, and windows drawn from each.
SAMPLE = 1200
DRAWS = 4
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


class Model:
    def __init__(self, languages: list[str], seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.languages = languages
        self.embed = random.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((max(WIDTHS) * DIM, len(WIDTHS) * FILTERS), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width * DIM, i * FILTERS:(i + 1) * FILTERS] = 1
        self.filters = (random.normal(0, 0.2, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = random.normal(0, 0.2, (self.mask.shape[1], len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def unrolled(self, windows: np.ndarray) -> np.ndarray:
        """Vectors of the widest filter's bytes at every place; zeros behind the end."""
        n, length = windows.shape
        wide = np.zeros((n, length + max(WIDTHS) - 1, DIM), np.float32)
        wide[:, :length] = self.embed[windows]
        return np.concatenate([wide[:, k:k + length] for k in range(max(WIDTHS))], axis=2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        flat = self.unrolled(windows).reshape(-1, self.filters.shape[0]) @ self.filters
        return np.maximum(flat.reshape(*windows.shape, -1).max(axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i:i + 256]) for i in range(0, len(windows), 256)]
        z = (np.concatenate(parts) if parts else np.zeros((0, len(self.bias)), np.float32)) @ self.out + self.base
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each and the bytes it holds; padding is zero."""
    counts = -(-np.diff(offsets) // length)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * length
    size = np.minimum(length, offsets[1:][text] - begin)
    at = begin[:, None] + np.arange(length)
    out = np.zeros(at.shape, np.uint8)
    inside = np.arange(length) < size[:, None]
    out[inside] = LOWER[data[at[inside]]]
    return out, text, size


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 10, batch: int = 64, seed: int = 11) -> Model:
    model = Model(languages, seed)
    random = np.random.default_rng(seed)
    adam = _Adam({k: getattr(model, k) for k in ("embed", "filters", "bias", "out", "base")}, 0.004)
    epochs = max(epochs, min(60, 20_000 // max(1, len(windows))))
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            adam.apply(_pass(model, windows[own], labels[own]))
            model.embed[0] = 0
    return model


def _pass(model: Model, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    n, length = windows.shape
    cols = model.unrolled(windows)
    out = (cols.reshape(n * length, -1) @ model.filters).reshape(n, length, -1)
    place = out.argmax(axis=1)
    top = np.take_along_axis(out, place[:, None], 1)[:, 0] + model.bias
    pooled = np.maximum(top, 0)
    z = pooled @ model.out + model.base
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), labels] -= 1
    p /= n
    back = (p @ model.out.T) * (top > 0)
    chosen = cols[np.arange(n)[:, None], place]
    grads = {"out": pooled.T @ p, "base": p.sum(axis=0), "bias": back.sum(axis=0),
             "filters": np.einsum("nfd,nf->df", chosen, back) * model.mask, "embed": np.zeros_like(model.embed)}
    toward = (back[:, :, None] * (model.filters * model.mask).T[None]).reshape(n, -1, max(WIDTHS), DIM)
    for k in range(max(WIDTHS)):
        at = place + k
        inside = at < length
        own = windows[np.arange(n)[:, None], np.minimum(at, length - 1)]
        np.add.at(grads["embed"], own[inside], toward[:, :, k][inside])
    return grads


def _draws(text: str) -> list[bytes]:
    """Windows of random place and length of a whole text, short ones among them; the same for the same text."""
    data = np.frombuffer(text.encode(), np.uint8)
    random = np.random.default_rng(zlib.crc32(data))
    out = []
    for _ in range(DRAWS if len(data) else 0):
        size = int(min(len(data), WINDOW, random.choice([12, 24, 48, 96, WINDOW, WINDOW])))
        begin = int(random.integers(0, len(data) - size + 1))
        out.append(data[begin:begin + size].tobytes())
    return out


def _drawn(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for begin, end in slices(texts):
            langs, windows = [], []
            for lang, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist()):
                own = _draws(text or "")
                langs += [lang] * len(own)
                windows += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "window"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` texts of each language, about, chosen by a hash of id and text.

    ``DRAWS`` windows are drawn from anywhere in each of these texts; the driver gets only them.
    Rows without id are chosen by their texts; repeated rows count once. A table without labelled
    texts gives no model.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    # Written out, its known small size lets Spark broadcast it, so that no text moves by its language.
    counts = cut(known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")))
    # A hash decides, at a rate that gives each language its share; nothing is sorted.
    rows = known.select(F.xxhash64(F.lit(5), id_col, text_col).alias("_hash"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.pmod("_hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(counts, F.col("lang") == F.col("_lang")).where(share * F.col("_n") < sample)
    one = chosen.groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    drawn = one.select("lang", "text").mapInArrow(_drawn, "lang string, window binary")
    found = sorted((r[0], bytes(r[1])) for r in drawn.collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    windows = np.zeros((len(found), WINDOW), np.uint8)
    for row, (_, window) in zip(windows, found):
        row[:len(window)] = LOWER[np.frombuffer(window, np.uint8)]
    return fit(windows, np.array([languages.index(lang) for lang, _ in found], np.int64), languages)


def _predict(batches, model) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in batches:
        texts, n = batch.column(0), batch.num_columns
        for begin, end in slices(texts):
            part = texts.slice(begin, end - begin)
            data, offsets = text_bytes(part)
            names, scores = [UNKNOWN] * (end - begin), np.zeros(end - begin)
            ascii_letters = np.add.reduceat(np.append(_LETTERS[data], False), np.minimum(offsets[:-1], len(data))) if len(data) else np.zeros(end - begin)
            has = (ascii_letters > 0) & (np.diff(offsets) > 0)
            for row in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                has[row] = any(c.isalpha() for c in part[int(row)].as_py())
            if own is not None and has.any():
                windows, text, size = windows_of(data, offsets)
                logs = own.log_probabilities(windows) * size[:, None]
                total = np.zeros((end - begin, len(own.languages)))
                np.add.at(total, text, logs)
                total /= np.maximum(np.bincount(text, size, end - begin), 1)[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for row in np.flatnonzero(has):
                    names[row] = own.languages[int(p[row].argmax())]
                scores = np.where(has, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(begin, end - begin) for i in range(1, n)), pa.array(names, pa.string()), pa.array(np.round(scores, 9))],
                [*batch.schema.names[1:], "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, ``lang_pred`` and ``score``, from the whole text alone.

    A null text, one without any letter, and any text without a model is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[1:])
    return columns.mapInArrow(partial(_predict, model=shared), f"{schema}, lang_pred string, score double")
