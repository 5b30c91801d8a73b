"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every benchmark item is cut into windows of consecutive words. A document holds a window only if
it holds the window's rarest shingle, so with full containment the necessary prefix is that one
shingle. Documents are probed for those shingles only; a probe that fits by position and length
is verified word by word.

The benchmark is worked through in blocks of bounded size. A block's shingles are counted over
all documents first, which gives the order by rarity, and then its windows are matched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import ALNUM, Words, run_hashes, slices
from reliefgrid.session import cut

#: Windows of the benchmark that are matched at once; one takes about a hundred bytes.
BLOCK = 200_000
PAIRS = 1_000_000


class _Sieve:
    """Sorted hashes behind a table of bits that most strangers fail."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - 20)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known hashes and their numbers among the keys."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes >> self.shift])
        place = np.searchsorted(self.keys, hashes[at])
        place[place == len(self.keys)] = 0
        right = self.keys[place] == hashes[at]
        return at[right], place[right]


def _windows(batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for begin, end in slices(texts):
            words = Words(texts.slice(begin, end - begin), ALNUM)
            names, found = [], []
            for row in range(end - begin):
                own = words.hashes[words.first[row]:words.first[row + 1]]
                size = min(window, len(own))
                if ids[begin + row] is not None and size:
                    for i in range(len(own) - size + 1):
                        names.append(ids[begin + row])
                        found.append(own[i:i + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], ["item", "words"])


class _Block:
    """Windows of a block, their sizes, and where the shingles of each begin."""

    def __init__(self, table: pa.Table, window: int, shingle: int) -> None:
        self.items = table.column("item").to_pylist()
        rows = table.column("words").to_pylist()
        self.sizes = np.array([len(x) // 8 for x in rows], np.int64)
        self.words = np.zeros((len(rows), window), np.uint64)
        for i, x in enumerate(rows):
            self.words[i, :self.sizes[i]] = np.frombuffer(x, np.uint64)
        self.width = np.minimum(self.sizes, shingle)
        self.shingles = [run_hashes(self.words[i, :n], int(k)) for i, (n, k) in enumerate(zip(self.sizes, self.width))]

    def by_width(self) -> dict[int, np.ndarray]:
        return {int(k): np.unique(np.concatenate([s for s, w in zip(self.shingles, self.width) if w == k])) for k in np.unique(self.width)}

    def index(self, counts: dict[tuple[int, int], int]) -> dict:
        """The rarest shingle of each window, grouped by shingle width."""
        rare = [min(range(len(s)), key=lambda i: (counts.get((int(k), int(s[i])), 0), int(s[i]), i)) for s, k in zip(self.shingles, self.width)]
        out = {}
        for k in np.unique(self.width):
            rows = np.flatnonzero(self.width == k)
            keys = np.array([self.shingles[r][rare[r]] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            sieve = _Sieve(keys)
            out[int(k)] = (sieve, np.searchsorted(keys, sieve.keys), np.searchsorted(keys, sieve.keys, "right"), rows, np.array(rare)[rows])
        return {"width": out, "words": self.words, "sizes": self.sizes, "items": self.items}


def _probes(words: Words, width: int) -> np.ndarray:
    """Shingle hashes at every word; what crosses into the next text is sorted out by position later."""
    return run_hashes(words.hashes, width)


def _count(batches, sieves) -> Iterator[pa.RecordBatch]:
    """Occurrences of the block's shingles in this part of the documents."""
    total = {k: np.zeros(len(s.keys), np.int64) for k, s in sieves.value.items()}
    for batch in batches:
        texts = batch.column(0)
        for begin, end in slices(texts):
            words = Words(texts.slice(begin, end - begin), ALNUM)
            for k, sieve in sieves.value.items():
                _, place = sieve.find(_probes(words, k))
                total[k] += np.bincount(place, minlength=len(sieve.keys))
    for k, sieve in sieves.value.items():
        seen = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(seen), k)), pa.array(sieve.keys[seen].view(np.int64)), pa.array(total[k][seen])], ["width", "shingle", "n"])


def _verified(words: Words, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of every occurrence."""
    found = []
    n = len(words.hashes)
    for width, (sieve, low, high, rows, offsets) in index["width"].items():
        at, place = sieve.find(_probes(words, width))
        fan = high[place] - low[place]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(fan) // PAIRS)) + 1):
            each = fan[part]
            which = np.repeat(low[place[part]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            window = rows[which]
            begin = np.repeat(at[part], each) - offsets[which]
            size = index["sizes"][window]
            text = np.searchsorted(words.first, np.repeat(at[part], each), "right") - 1
            fits = (begin >= words.first[text]) & (begin + size <= words.first[text + 1])
            window, begin, size, text = window[fits], begin[fits], size[fits], text[fits]
            same = np.ones(len(window), bool)
            for i in range(index["words"].shape[1]):
                same &= (i >= size) | (words.hashes[np.minimum(begin + i, n - 1)] == index["words"][window, i])
            found.append((text[same], begin[same], window[same]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (begin, end) rows made one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _match(batches, index, text_col: str, keep: tuple[str, ...], first: bool) -> Iterator[pa.RecordBatch]:
    """Adds a block's spans and items to each document."""
    for batch in batches:
        column = lambda x: batch.column(batch.schema.get_field_index(x))
        texts = column(text_col)
        for begin, end in slices(texts):
            words = Words(texts.slice(begin, end - begin), ALNUM)
            if first:
                spans, items = [[] for _ in range(end - begin)], [[] for _ in range(end - begin)]
            else:
                spans, items = (column(x).slice(begin, end - begin).to_pylist() for x in ("spans", "items"))
            text, at, window = _verified(words, index.value)
            for row in np.unique(text):
                own = text == row
                start = at[own] - words.first[row]
                new = np.stack([start, start + index.value["sizes"][window[own]]], axis=1)
                old = np.array(spans[row], np.int64).reshape(-1, 2)
                spans[row] = _merged(np.concatenate([old, new])).ravel().tolist()
                items[row] = sorted({*items[row], *(index.value["items"][w] for w in np.unique(window[own]))})
            yield pa.RecordBatch.from_arrays(
                [*(column(x).slice(begin, end - begin) for x in keep), pa.array(words.counts),
                 pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                [*keep, "n_words", "spans", "items"])


class _Nothing:
    """Stands for the index of an empty benchmark."""

    value = {"width": {}}


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 4,
) -> DataFrame:
    """Columns ``keep`` and ``n_words, n_hit, spans, items, contaminated`` of every row of ``docs``.

    Words are lower-cased (A-Z) runs of ASCII letters and digits and anything beyond ASCII. An
    item's windows are its runs of ``window`` words; a shorter item is one window. ``spans`` holds
    begin and end (exclusive) word numbers of merged hits, flat; ``items`` the ids, as strings, of
    items with a window in the text. Texts that are null or without words have zero words and no
    hits. Items that are null, without words or without id take no part; an empty benchmark hits
    nothing. Repeated rows are returned each; further columns are ignored.
    """
    spark = docs.sparkSession
    windows = cut(
        benchmark.select(F.col(item_col).cast("string"), F.col(item_text))
        .mapInArrow(partial(_windows, window=window), "item string, words binary").distinct()
    )
    blocks = -(-windows.count() // BLOCK)
    texts = docs.select(*dict.fromkeys((*keep, text_col)))
    kept = ", ".join(f"`{x}` {texts.schema[x].dataType.simpleString()}" for x in keep)
    added = "n_words long, spans array<long>, items array<string>"
    state = texts
    for i in range(blocks):
        block = _Block(windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i).toArrow(), window, shingle)
        sieves = spark.sparkContext.broadcast({k: _Sieve(keys) for k, keys in block.by_width().items()})
        counts = (
            docs.select(text_col).mapInArrow(partial(_count, sieves=sieves), "width long, shingle long, n long")
            .groupBy("width", "shingle").agg(F.sum("n").alias("n")).toPandas()
        )
        known = {(k, s % 2**64): n for k, s, n in zip(counts["width"].tolist(), counts["shingle"].tolist(), counts["n"].tolist())}
        index = spark.sparkContext.broadcast(block.index(known))
        # All blocks but the last pass the text on.
        own = tuple(keep) if i == blocks - 1 or text_col in keep else (*keep, text_col)
        schema = kept if len(own) == len(keep) else f"{kept}, `{text_col}` string"
        state = state.mapInArrow(partial(_match, index=index, text_col=text_col, keep=own, first=i == 0), f"{schema}, {added}")
    if not blocks:
        state = state.mapInArrow(partial(_match, index=_Nothing(), text_col=text_col, keep=tuple(keep), first=True), f"{kept}, {added}")
    n_hit = F.aggregate(
        F.sequence(F.lit(1), (F.size("spans") / 2).cast("int")), F.lit(0).cast("long"),
        lambda total, i: total + F.element_at("spans", (2 * i).cast("int")) - F.element_at("spans", (2 * i - 1).cast("int")),
    )
    return state.select(
        *keep, "n_words",
        F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        "spans", "items", (F.size("spans") > 0).alias("contaminated"),
    )
