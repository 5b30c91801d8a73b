"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first few bytes,
so words made from one stem share what is learned. Filters of several widths run over the words
and are pooled by their maximum over the whole text, then a logistic layer gives the logit. The
threshold is calibrated for each language that the training texts have; a text's language is told
from its words. Scores are shifted so that every language's threshold is the same score.

The fit reads every labelled text. Texts are dealt over shards by their ids; in each round every
shard goes on from the common weights, and the mean of the shards' changes makes the next ones.
Counts of words and of languages, and the thresholds, are sums over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import _BYTE, _STEP, ALNUM, LOWER, Words, mix, slices, text_bytes
from reliefgrid.operators.bitfilter import bit_filter, likely
from reliefgrid.session import cut

PREFIXES = (4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 12
#: Labelled texts of a shard, about, and how often all shards' changes are brought together.
SHARD, ROUNDS = 8000, 3
#: A hash has an embedding if at least this many texts of either class have it, and one in so many of them.
LEAST, RARE = 3, 2000
#: Steps of a logit that thresholds tell apart.
STEPS = 256
#: Texts counted or judged at a time.
CHUNK = 256
#: Texts of a training step.
BATCH = 32
CUT = 0.3


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of every word and its prefixes, and the range of words of each text.

    A prefix as long as the word counts too, so ``word`` and ``words`` share their stem.
    """
    words = Words(texts, ALNUM)
    data, _ = text_bytes(texts)
    keys = np.zeros((len(words.starts), 1 + len(PREFIXES)), np.uint32)
    keys[:, 0] = words.hashes >> np.uint64(32)
    sizes = words.ends - words.starts
    total, power = np.zeros(len(sizes), np.uint64), np.ones(1, np.uint64)
    for i in range(max(PREFIXES)):
        long = sizes > i
        total[long] += _BYTE[LOWER[data[words.starts[long] + i]]] * power
        power = power * _STEP
        if i + 1 in PREFIXES:
            hashed = (mix(total + np.uint64(977 * (i + 1))) >> np.uint64(32)).astype(np.uint32)
            keys[:, 1 + PREFIXES.index(i + 1)] = np.where(sizes > i, hashed, 0)
    return keys, words.first


class Model:
    """Known hashes, their embeddings, and the layers above."""

    def __init__(self, known: np.ndarray, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.known = known
        self.embed = random.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
        self.embed[-1] = 0
        pairs = sum(WIDTHS)
        self.filters = random.normal(0, 0.3, (DIM, pairs * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.languages: list[str] = []
        self.telling = np.zeros((len(known) + 1, 0), np.float32)
        self.thresholds = np.zeros(0, np.float32)
        self.constant: float | None = None

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Embedding numbers; strangers and missing prefixes have the last one, which is zero."""
        if not len(self.known):
            return np.zeros(keys.shape, np.int32)
        at = np.searchsorted(self.known, keys).astype(np.int32)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == keys, at, np.int32(len(self.known)))

    def conv(self, projected: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter outputs at every word; places behind a text's end add nothing."""
        n = len(number)
        end = np.repeat(first[1:], np.diff(first))
        out = np.empty((n, len(self.bias)), np.float32)
        column, place = 0, np.arange(n)
        shifted = [number] + [np.where(place + k < end, number[np.minimum(place + k, n - 1)], len(projected) - 1) for k in range(1, max(WIDTHS))]
        for w, width in enumerate(WIDTHS):
            part = slice(w * FILTERS, (w + 1) * FILTERS)
            out[:, part] = self.bias[part]
            for k in range(width):
                out[:, part] += projected[:, column:column + FILTERS][shifted[k]]
                column += FILTERS
        return out

    def logits(self, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language number of each text."""
        _, at, number = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        return self.told(self.rows(keys[at]), number, first)

    def told(self, rows: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from embedding numbers of distinct words and the word that stands at each place."""
        docs = len(first) - 1
        pooled = np.zeros((docs, len(self.bias)), np.float32)
        talk = np.zeros((docs, max(1, len(self.languages))), np.float32)
        full = np.diff(first) > 0
        if len(number):
            vectors = np.concatenate([self.embed[rows].sum(axis=1), np.zeros((1, DIM), np.float32)])
            out = self.conv(vectors @ self.filters, number, first)
            pooled[full] = np.maximum(np.maximum.reduceat(out, first[:-1][full]), 0)
            if self.languages:
                talk[full] = np.add.reduceat(self.telling[rows[:, 0]][number], first[:-1][full])
        return pooled @ self.out + self.base[0], talk.argmax(axis=1)

    def score(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        logit, talk = self.logits(keys, first)
        shift = self.thresholds[talk] if len(self.thresholds) else 0.0
        z = np.clip(logit.astype(np.float64) - shift + np.log(CUT / (1 - CUT)), -40, 40)
        # A text without any word says nothing, so nothing toxic either.
        return np.where(np.diff(first) > 0, 1 / (1 + np.exp(-z)), 0.0)


class _Adam:
    def __init__(self, values: dict[str, np.ndarray], rate: float) -> None:
        self.values, self.rate, self.step = values, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in values.items()}
        self.second = {k: np.zeros_like(v) for k, v in values.items()}

    def apply(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            first, second = self.first[k], self.second[k]
            first *= 0.9
            first += 0.1 * g
            np.square(g, out=g)
            g *= 0.001
            second *= 0.999
            second += g
            root = np.sqrt(second, out=g)
            root *= 1 / np.sqrt(1 - 0.999**self.step)
            root += 1e-7
            np.divide(first, root, out=root)
            root *= self.rate / (1 - 0.9**self.step)
            self.values[k] -= root


def _pass(model: Model, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray, number: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the weighted logistic loss over a batch of non-empty texts.

    ``rows`` are of the words at each place or, with the ``number`` of the word there, of distinct words.
    """
    number = np.arange(len(rows)) if number is None else number
    vectors = model.embed[rows].sum(axis=1)
    projected = np.concatenate([vectors @ model.filters, np.zeros((1, model.filters.shape[1]), np.float32)])
    out = model.conv(projected, number, first)
    top = np.maximum.reduceat(out, first[:-1])
    hits = out == np.repeat(top, np.diff(first), axis=0)
    place = np.where(hits, np.arange(len(number))[:, None], len(number))
    place = np.minimum.reduceat(place, first[:-1])
    pooled = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.base[0], -30, 30)))
    delta = ((p - labels) * weights / len(labels)).astype(np.float32)
    back = delta[:, None] * model.out * (top > 0)
    grads = {"out": pooled.T @ delta + 1e-4 * model.out, "base": delta.sum(keepdims=True), "bias": back.sum(axis=0),
             "filters": np.zeros_like(model.filters), "embed": np.zeros_like(model.embed)}
    column, end = 0, np.repeat(first[1:, None], out.shape[1], axis=1)
    for w, width in enumerate(WIDTHS):
        part = slice(w * FILTERS, (w + 1) * FILTERS)
        for k in range(width):
            at, own = place[:, part] + k, back[:, part]
            fits = at < end[:, part]
            at = number[np.where(fits, at, 0)]
            own = own * fits
            x = vectors[at]
            weights_here = model.filters[:, column:column + FILTERS]
            grads["filters"][:, column:column + FILTERS] = np.einsum("bfd,bf->df", x, own)
            toward = own[:, :, None] * weights_here.T[None]
            flat = rows[at.ravel()]
            for j in range(flat.shape[1]):
                np.add.at(grads["embed"], flat[:, j], toward.reshape(-1, DIM))
            column += FILTERS
    grads["embed"][-1] = 0
    grads["embed"] += 1e-5 * model.embed
    return grads


_SHARD = pa.schema([
    ("shard", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary()), ("sizes", pa.binary()),
    ("labels", pa.list_(pa.int32())), ("judged", pa.list_(pa.bool_())), ("langs", pa.list_(pa.string())),
])


def _squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed: Spark copies a row's bytes several times, so a shard's should be few.

    They go byte by byte, so that the high bytes of small numbers stand together.
    """
    data = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T)
    return data.nbytes.to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _loose(data: bytes, kind: type) -> np.ndarray:
    data = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(kind).ravel()


class _Shard:
    """Training texts: keys of their distinct words, the word at each place, and where texts begin."""

    def __init__(self, row: dict) -> None:
        self.number = row["shard"]
        self.words = _loose(row["words"], np.uint32).reshape(-1, 1 + len(PREFIXES))
        self.places = _loose(row["numbers"], np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.labels = np.array(row["labels"], np.float32)
        self.judged = np.array(row["judged"], bool)
        self.langs = row["langs"]

    def take(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at the places of some texts, and where these begin."""
        parts = [self.places[self.first[i]:self.first[i + 1]] for i in texts.tolist()]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _shards(batches) -> Iterator[_Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Shard(batch.slice(i, 1).to_pylist()[0])


class _Packing:
    """The shard that is being read; words get their numbers as they come."""

    def __init__(self, number: int) -> None:
        self.number, self.wanted, self.label = number, None, 0
        self.words = np.zeros((0, 1 + len(PREFIXES)), np.uint32)
        self.places: list[np.ndarray] = []
        self.about: list[tuple] = []

    def add(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        flat, known = np.concatenate(texts), self.words[:, 0]
        own, at, back = np.unique(flat[:, 0], return_index=True, return_inverse=True)
        numbers = np.full(len(own), -1, np.int32)
        if len(known):
            order = np.argsort(known)
            spot = order[np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)]
            numbers = np.where(known[spot] == own, spot, -1).astype(np.int32)
        new = numbers < 0
        numbers[new] = len(known) + np.arange(int(new.sum()))
        self.words = np.concatenate([self.words, flat[at[new]]])
        self.places += np.split(numbers[back], np.cumsum([len(x) for x in texts])[:-1])

    def batch(self) -> pa.RecordBatch:
        labels, judged, langs = zip(*self.about)
        row = {"shard": self.number, "words": _squeezed(self.words), "numbers": _squeezed(np.concatenate(self.places)),
               "sizes": np.array([len(x) for x in self.places], np.int64).tobytes(), "labels": labels, "judged": judged, "langs": langs}
        return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Shards of rows sorted by shard and id, an id's label first: of its texts the next one, if it has words."""
    shard = _Packing(-1)
    for batch in batches:
        shards, ids, labels, judged, langs = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("shard", "_id", "_label", "judged", "lang"))
        texts = batch.column(batch.schema.get_field_index("text"))
        for begin, end in slices(texts):
            keys, first = word_keys(texts.slice(begin, end - begin))
            fresh: list[np.ndarray] = []
            for i in range(begin, end):
                if shards[i] != shard.number:
                    shard.add(fresh)
                    if shard.about:
                        yield shard.batch()
                    shard, fresh = _Packing(shards[i]), []
                if labels[i] is not None:
                    shard.wanted, shard.label = ids[i], labels[i]
                    continue
                if ids[i] is None or ids[i] != shard.wanted:
                    continue
                shard.wanted = None
                own = keys[first[i - begin]:first[i - begin + 1]]
                if len(own):
                    fresh.append(own)
                    shard.about.append((shard.label, judged[i], langs[i]))
            shard.add(fresh)
    if shard.about:
        yield shard.batch()


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """For each hash and language the texts of a shard that have it, by class, and those that have it as a word."""
    for own in _shards(batches):
        hashes, codes = np.unique(own.words, return_inverse=True)
        codes = codes.reshape(own.words.shape)
        for lang in dict.fromkeys(own.langs):
            texts = np.array([i for i, x in enumerate(own.langs) if x == lang])
            every, whole = np.zeros((2, len(hashes)), np.int64), np.zeros(len(hashes), np.int64)
            for low in range(0, len(texts), CHUNK):
                places, first = own.take(texts[low:low + CHUNK])
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.unique(text * len(own.words) + places)
                text, word = pairs // len(own.words), pairs % len(own.words)
                whole += np.bincount(codes[word, 0], minlength=len(hashes))
                pairs = np.unique(text[:, None] * len(hashes) + codes[word])
                toxic = own.labels[texts[low:low + CHUNK]][pairs // len(hashes)] > 0
                for v in (0, 1):
                    every[v] += np.bincount(pairs[toxic == v] % len(hashes), minlength=len(hashes))
            there = np.flatnonzero((every.sum(axis=0) > 0) & (hashes > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[there], pa.int64()), pa.array([lang] * len(there), pa.string()), *(pa.array(x[there]) for x in (*every, whole))],
                ["hash", "lang", "clean", "toxic", "words"])


#: Changes are added as whole numbers of this fraction, so that their order does not matter.
_UNIT = 2.0**16
#: Weights that are added up together.
_BLOCK = 1024
_LAYERS = ("filters", "bias", "out", "base")


def _layers(model: Model) -> np.ndarray:
    """The weights above the embeddings, in rows as wide as an embedding."""
    flat = np.concatenate([getattr(model, k).ravel() for k in _LAYERS])
    return np.append(flat, np.zeros(-len(flat) % DIM, flat.dtype)).reshape(-1, DIM)


def _changed(batches, model, rate: float, epochs: int, weights: tuple[float, float], hold: bool, seed: int) -> Iterator[pa.RecordBatch]:
    """What a shard's training texts change, from the common weights on: embeddings and, below 0, layers."""
    for own in _shards(batches):
        train = np.flatnonzero(~(own.judged & hold))
        if not len(train):
            continue
        rows = model.value.rows(own.words)
        used, local = np.unique(np.append(rows, len(model.value.known)), return_inverse=True)
        local = local[:-1].reshape(rows.shape)
        mine = Model(model.value.known[used[:-1]])
        mine.embed = model.value.embed[used]
        for k in _LAYERS:
            setattr(mine, k, getattr(model.value, k).copy())
        before, layers = mine.embed.copy(), _layers(mine)
        weight = np.where(own.labels > 0, np.float32(weights[1]), np.float32(weights[0]))
        random, adam = np.random.default_rng([seed, own.number]), _Adam({k: getattr(mine, k) for k in ("embed", *_LAYERS)}, rate)
        number = np.zeros(len(own.words), np.int64)
        for _ in range(epochs):
            order = random.permutation(train)
            for i in range(0, len(order), BATCH):
                part = order[i:i + BATCH]
                places, first = own.take(part)
                there = np.flatnonzero(np.bincount(places, minlength=len(number)))
                number[there] = np.arange(len(there))
                adam.apply(_pass(mine, local[there], first, own.labels[part], weight[part], number[places]))
        change = np.concatenate([mine.embed - before, _layers(mine) - layers])
        change = np.rint(np.delete(change, len(used) - 1, axis=0).astype(np.float64) * _UNIT).astype(np.int32)
        at = np.concatenate([used[:-1], len(model.value.known) + np.arange(len(layers))]).astype(np.int32)
        cuts = np.flatnonzero(np.diff(at // _BLOCK)) + 1
        blocks = list(zip(np.split(at, cuts), np.split(change, cuts)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(x[0]) // _BLOCK for x, _ in blocks], pa.int32()), pa.array([x.tobytes() for x, _ in blocks], pa.binary()),
             pa.array([_thin(x) for _, x in blocks], pa.binary())], ["block", "at", "change"])


def _thin(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, the sign lowest: small ones leave zeros that compress away in a shuffle."""
    return np.ascontiguousarray(((values << 1) ^ (values >> 31)).view(np.uint8).reshape(-1, 4).T).tobytes()


def _thick(data: bytes) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return (values >> np.uint32(1)).astype(np.int64) ^ -(values & np.uint32(1)).astype(np.int64)


def _mean(table: pa.Table) -> pa.Table:
    """The mean change of every weight of a block over the shards that use it."""
    block = table.column("block")[0].as_py()
    total, n = np.zeros((_BLOCK, DIM), np.int64), np.zeros(_BLOCK, np.int64)
    for at, change in zip(table.column("at").to_pylist(), table.column("change").to_pylist()):
        own = np.frombuffer(at, np.int32) - block * _BLOCK
        total[own] += _thick(change).reshape(-1, DIM)
        n[own] += 1
    there = np.flatnonzero(n)
    mean = (total[there] / _UNIT / n[there][:, None]).astype(np.float32)
    return pa.table({"at": pa.array([(there + block * _BLOCK).astype(np.int32).tobytes()], pa.binary()), "change": pa.array([mean.tobytes()], pa.binary())})


def _judged(batches, model, hold: bool) -> Iterator[pa.RecordBatch]:
    """Counts of the judging texts by language told and logit."""
    for own in _shards(batches):
        rows = model.value.rows(own.words)
        texts = np.flatnonzero(own.judged) if hold else np.arange(len(own.labels))
        for low in range(0, len(texts), CHUNK):
            part = texts[low:low + CHUNK]
            logit, talk = model.value.told(rows, *own.take(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(talk, pa.int32()), pa.array(np.rint(logit.astype(np.float64) * STEPS).astype(np.int64)), pa.array(own.labels[part].astype(np.int64))],
                ["talk", "step", "label"])


def _threshold(steps: np.ndarray, texts: np.ndarray, toxic: np.ndarray) -> float:
    """The logit with the best F1; the middle of the gap it falls in."""
    order = np.argsort(-steps)
    steps, hits = steps[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(texts[order]) + toxic.sum())
    best = int(np.argmax(f1))
    below = steps[best + 1] if best + 1 < len(steps) else steps[best] - 2 * STEPS
    return float(steps[best] + below) / 2 / STEPS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", seed: int = 7) -> Model:
    """Fits on all labelled texts that have words.

    An id is toxic if any of its labels says so. Of texts with one id, the one with the smallest
    hash counts. The driver gets the weights, word counts by language of words in use, and counts
    by logit; a task holds one shard. The result does not depend on how rows are partitioned.
    """
    own = cut(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("_label")))
    shards = max(1, -(-own.count() // SHARD))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = F.xxhash64(F.col("_id").cast("string"))
    rows = likely(rows, hashed, bit_filter(own.select(hashed.alias("hash")), "hash")).withColumn("_label", F.lit(None).cast("int"))
    # Labels travel with the texts, so texts pass one shuffle only: the label of an id comes before its texts.
    rows = own.select("_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "_label").union(rows)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")).withColumn("judged", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(5)) == 0)
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", F.xxhash64("_id"), "_id", F.col("_label").asc_nulls_last(), F.xxhash64("text", "lang"))
    packed = cut(dealt.mapInArrow(
        _packed, "shard int, words binary, numbers binary, sizes binary, labels array<int>, judged array<boolean>, langs array<string>"))

    each = packed.select(F.explode(F.arrays_zip("labels", "judged", "langs")).alias("x")).select("x.*")
    seen = each.groupBy("labels", "judged", "langs").count().collect()
    every = [sum(r["count"] for r in seen if r.labels == v) for v in (0, 1)]
    held = [sum(r["count"] for r in seen if r.labels == v and r.judged) for v in (0, 1)]
    # Texts judge that were not trained on, unless there are too few.
    hold = min(held) >= 5 and all(n < m for n, m in zip(held, every))
    trained = [m - n * hold for n, m in zip(held, every)]
    texts = {x: sum(r["count"] for r in seen if r.langs == x) for x in sorted({r.langs for r in seen if r.langs is not None})}
    if min(every) == 0:
        model = Model(np.zeros(0, np.uint32), seed)
        model.constant = every[1] / max(1, sum(every))
        return model
    model = _start(packed, every, texts, seed)

    total = sum(trained)
    weights = (0.5 * total / trained[0], 0.5 * total / trained[1])
    epochs = 1 if shards > 1 else max(12, min(60, 6000 // total))
    for i in range(ROUNDS if shards > 1 else 1):
        _together(packed, model, rate=0.01 / (1 + i), epochs=epochs, weights=weights, hold=hold, seed=seed + i)

    shared = docs.sparkSession.sparkContext.broadcast(model)
    told = packed.mapInArrow(partial(_judged, model=shared, hold=hold), "talk int, step long, label long")
    found = told.groupBy("talk", "step").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).collect()
    shared.unpersist()
    talk, step, n, toxic = np.array([tuple(r) for r in found], np.int64).T
    steps, at = np.unique(step, return_inverse=True)
    overall = _threshold(steps, np.bincount(at, n), np.bincount(at, toxic))
    model.thresholds = np.full(max(1, len(model.languages)), overall, np.float32)
    for i in range(len(model.languages)):
        mine = talk == i
        if toxic[mine].sum() >= 5 and (n - toxic)[mine].sum() >= 5:
            model.thresholds[i] = _threshold(step[mine], n[mine], toxic[mine])
    return model


def _start(packed: DataFrame, every: list[int], texts: dict[str, int], seed: int) -> Model:
    """A model of the hashes that enough texts have, and how much each word speaks for each language."""
    counts = packed.mapInArrow(_counted, "hash long, lang string, clean long, toxic long, words long").groupBy("hash").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), *(F.sum(F.when(F.col("lang") == x, F.col("words")).otherwise(0)).alias(f"w{i}") for i, x in enumerate(texts)))
    enough = [F.col(x) >= max(LEAST, n // RARE) for x, n in zip(("clean", "toxic"), every)]
    found = counts.where(enough[0] | enough[1]).drop("clean", "toxic").toArrow()
    hashes = found.column("hash").to_numpy()
    order = np.argsort(hashes)
    model = Model(hashes[order].astype(np.uint32), seed)
    model.languages = list(texts)
    if texts:
        there = np.zeros((len(hashes) + 1, len(texts)), np.float64)
        for i in range(len(texts)):
            there[:-1, i] = found.column(f"w{i}").to_numpy()[order]
        odds = np.log((there + 0.5) / (np.array(list(texts.values())) + 1))
        model.telling = (odds - odds.mean(axis=1, keepdims=True)).astype(np.float32)
        model.telling[-1] = 0
    return model


def _together(packed: DataFrame, model: Model, **how) -> None:
    """One round: every weight changes by the mean over the shards that use it."""
    shared = packed.sparkSession.sparkContext.broadcast(model)
    changed = packed.mapInArrow(partial(_changed, model=shared, **how), "block int, at binary, change binary")
    found = changed.groupBy("block").applyInArrow(_mean, "at binary, change binary").collect()
    shared.unpersist()
    layers = _layers(model)
    for row in found:
        at, change = np.frombuffer(row.at, np.int32), np.frombuffer(row.change, np.float32).reshape(-1, DIM)
        words = at < len(model.known)
        model.embed[at[words]] += change[words]
        layers[at[~words] - len(model.known)] += change[~words]
    flat = layers.ravel()
    for k in _LAYERS:
        own = getattr(model, k)
        setattr(model, k, flat[:own.size].reshape(own.shape).copy())
        flat = flat[own.size:]


def _scores(batches, model, text_col: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        own = [batch.column(batch.schema.get_field_index(x)) for x in keep]
        for begin, end in slices(texts):
            keys, first = word_keys(texts.slice(begin, end - begin))
            found = np.round(model.value.score(keys, first), 9)
            yield pa.RecordBatch.from_arrays([*(x.slice(begin, end - begin) for x in own), pa.array(found)], [*keep, "score"])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row and its ``score``, from the whole text alone.

    Null and wordless texts score 0, unless the labels are of one class only. Repeated rows are
    returned each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*dict.fromkeys((*keep, text_col)))
    schema = ", ".join(f"`{x}` {columns.schema[x].dataType.simpleString()}" for x in keep)
    return columns.mapInArrow(partial(_scores, model=shared, text_col=text_col, keep=tuple(keep)), f"{schema}, score double")
