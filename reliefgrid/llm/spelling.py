"""Spelling variants grouped by bidirectional FM-index search schemes over the corpus vocabulary.

Two words are near if one inserted, deleted or replaced code point separates them. One error lies
in one half of a word, so the other half is found exactly. The vocabulary is dealt into shards
twice, by the first and by the last letters, which an exact half always covers. A shard writes its
words between delimiters, and indexes that text and its reverse by the ranks of their rotations.
A search keeps one interval in either index: it grows leftward over the exact half up to the
delimiter, then rightward over the other half with one error at any place, up to the delimiter
behind it. All words of a shard are searched at once, a letter at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import slices
from reliefgrid.session import cut

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as its variant.
FACTOR = 5
#: One in so many (document, word) pairs loses a letter.
NOISE = 199
#: Code points of words that a shard indexes, about; hot keys are split so that none holds more.
SHARD_CHARS = 1 << 19
#: Words that a task counts before it passes its counts on, and their characters.
COUNT_WORDS, COUNT_CHARS = 400_000, 1 << 24
#: Rows of the rank table's blocks, and intervals whose letters are read row by row.
BLOCK, NARROW = 8, 8


def worn(doc_id, run: str, noise: int = NOISE) -> str:
    """The lower-cased run, without one letter if its hash with the document's id says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % noise else run[:h % len(run)] + run[h % len(run) + 1:]


def _count_words(batches, least: int, noise: int) -> Iterator[pa.RecordBatch]:
    """Words of whole texts and how often a task saw them."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    counts: dict[str, int] = {}
    chars = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for low, high in slices(texts):
            for doc, text in zip(ids[low:high], texts.slice(low, high - low).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                seen: dict[str, int] = {}
                for run in runs.findall(text.encode().translate(_LOWER).decode()):
                    seen[run] = seen.get(run, 0) + 1
                for run, n in seen.items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % noise == 0:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                        if len(run) < least:
                            continue
                    if run in counts:
                        counts[run] += n
                    else:
                        counts[run] = n
                        chars += len(run)
                if len(counts) > COUNT_WORDS or chars > COUNT_CHARS:
                    yield flush()
                    counts, chars = {}, 0
    yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """``word, n`` of all words with enough code points and occurrences; a null text has none."""
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    counted = rows.mapInArrow(partial(_count_words, least=least_length, noise=noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rotations(codes: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all rotations of a text in order; no two rotations are equal."""
    n = len(codes)
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << bits | np.roll(codes, -i)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if int(rank[order[-1]]) == n - 1:
            return order
        key = rank * n + np.roll(rank, -step)
        step *= 2


class Ranks:
    """Letters before the ordered rotations of a text, and how many of them lie below a letter up to a row."""

    def __init__(self, codes: np.ndarray, letters: int) -> None:
        order = _rotations(codes, max(1, letters.bit_length()))
        n = len(codes)
        kind = np.uint8 if letters < 255 else np.uint32
        self.before, self.fill = codes[order - 1].astype(kind), np.iinfo(kind).max
        blocks = n // BLOCK + 1
        padded = np.full(blocks * BLOCK, self.fill, kind)
        padded[:n] = self.before
        self.rows = padded.reshape(blocks, BLOCK)
        held = np.zeros((blocks + 1, letters + 1), np.int32)
        at = np.arange(n) // BLOCK + 1
        np.add.at(held, (at, self.before.astype(np.int64) + 1), 1)
        #: Letters below c in all rows before a block.
        self.below = np.cumsum(np.cumsum(held, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=letters))]).astype(np.int64)

    def less_and_equal(self, letter: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many letters of the rows before ``row`` lie below a letter, and how many equal it."""
        block, rest = row // BLOCK, row % BLOCK
        less = self.below[block, letter].astype(np.int64)
        equal = self.below[block, letter + 1] - less
        rows = self.rows[block]
        for j in range(BLOCK - 1):
            own = np.where(rest > j, rows[:, j], self.fill)
            less += own < letter
            equal += own == letter
        return less, equal


class Index:
    """The ranks of a delimited text and of its reverse; letter 0 is the delimiter.

    An interval is ``(low, back, size)``: its first row in the text's order, its first row in the
    order of the reverse, and its number of rows. Delimiters come first in the order, so row ``i``
    of a whole word between delimiters stands for the ``i``-th word.
    """

    def __init__(self, words: list[str]) -> None:
        text = "\0" + "\0".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        codes = np.searchsorted(self.alphabet, points).astype(np.int64)
        self.size, self.letters = len(codes), len(self.alphabet)
        self.ahead, self.behind = Ranks(codes, self.letters), Ranks(codes[::-1], self.letters)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of words as a table filled with delimiters, and their lengths; strangers are the number of letters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        at[at == self.letters] = 0
        codes = np.where(self.alphabet[at] == points, at, self.letters)
        table = np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = codes
        return table, lengths

    def _grow(self, ranks: Ranks, letter: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        known = letter < self.letters
        c = np.where(known, letter, 0)
        (below, start), (under, end) = ranks.less_and_equal(c, low), ranks.less_and_equal(c, low + size)
        return ranks.first[c] + start, other + under - below, np.where(known, end - start, 0)

    def leftward(self, letter, low, back, size):
        return self._grow(self.ahead, letter, low, back, size)

    def rightward(self, letter, low, back, size):
        back, low, size = self._grow(self.behind, letter, back, low, size)
        return low, back, size

    def branches(self, low: np.ndarray, back: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        """Every letter that follows the intervals, as (their numbers, letters, grown intervals)."""
        narrow = np.flatnonzero(size <= NARROW)
        seen = np.zeros((len(narrow), NARROW), np.int64)
        for j in range(NARROW):
            has = size[narrow] > j
            letter = np.zeros(len(narrow), np.int64)
            letter[has] = self.behind.before[back[narrow[has]] + j]
            new = has & (letter > 0) & ~(seen[:, :j] == letter[:, None]).any(axis=1)
            seen[:, j] = letter
            at = narrow[new]
            if len(at):
                yield at, letter[new], self.rightward(letter[new], low[at], back[at], size[at])
        wide = np.flatnonzero(size > NARROW)
        for c in range(1, self.letters if len(wide) else 0):
            letter = np.full(len(wide), c)
            grown = self.rightward(letter, low[wide], back[wide], size[wide])
            some = grown[2] > 0
            if some.any():
                yield wide[some], letter[some], tuple(x[some] for x in grown)


def search(index: Index, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a word, number of an indexed word) that share the first ``halves`` letters
    of the former and are one error apart behind them. Each pair once."""
    table, lengths = index.codes(words)
    n = len(words)
    who, low, back, size = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size, np.int64)
    for t in range(int(halves.max(initial=-1)) + 1):
        place = halves[who] - 1 - t
        letter = np.where(place >= 0, table[who, np.maximum(place, 0)], 0)
        moving = place >= -1
        grown = index.leftward(letter[moving], low[moving], back[moving], size[moving])
        low[moving], back[moving], size[moving] = grown
        some = size > 0
        who, low, back, size = who[some], low[some], back[some], size[some]
    place = halves[who].copy()
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    pool: list[tuple] = []
    none = np.zeros(0, np.int64)
    while len(who) or pool:
        letter = table[who, place]
        at_end = place == lengths[who]
        later: list[tuple] = []
        # A letter left out; of equal neighbours the last.
        out = ~at_end & (letter != table[who, np.minimum(place + 1, table.shape[1] - 1)])
        if out.any():
            later.append((who[out], place[out] + 1, low[out], back[out], size[out]))
        for at, other, grown in index.branches(low, back, size):
            strange = other != letter[at]
            at, grown = at[strange], tuple(x[strange] for x in grown)
            pool.append((who[at], place[at], *grown))
            put = ~at_end[at]
            later.append((who[at[put]], place[at[put]] + 1, *(x[put] for x in grown)))
        # With the error behind them, words go on exactly.
        if pool:
            own, where, *held = (np.concatenate(x) for x in zip(*pool))
            letter_here = table[own, where]
            grown = index.rightward(letter_here, *held)
            done = (where == lengths[own]) & (grown[2] > 0)
            hits.append((own[done], grown[0][done]))
            going = (where < lengths[own]) & (grown[2] > 0)
            if going.any():
                later.append((own[going], where[going] + 1, *(x[going] for x in grown)))
        pool = [x for x in later if len(x[0])]
        on = ~at_end
        who, place = who[on], place[on]
        if len(who):
            low, back, size = index.rightward(letter[on], low[on], back[on], size[on])
            place = place + 1
            some = size > 0
            who, place, low, back, size = (x[some] for x in (who, place, low, back, size))
        else:
            low = back = size = none
    if not hits:
        return none, none
    own, found = (np.concatenate(x) for x in zip(*hits))
    both = np.unique(own * index.size + found)
    return both // index.size, both % index.size


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _search_shard(table: pa.Table) -> pa.Table:
    """The near words of a shard's queries: their number, and the most frequent one."""
    backward = table.column("side")[0].as_py() == 1
    rows = sorted(zip(*(table.column(x).to_pylist() for x in ("word", "n", "indexed", "asked"))))
    kept = [(w[::-1] if backward else w, n, i) for i, (w, n, x, _) in enumerate(rows) if x]
    kept.sort()
    asked = [w for w, _, _, x in rows if x]
    if not kept or not asked:
        return _FOUND.empty_table()
    index = Index([w for w, _, _ in kept])
    count = np.array([n for _, n, _ in kept], np.int64)
    order = np.array([i for _, _, i in kept], np.int64)
    lengths = np.fromiter(map(len, asked), np.int64, len(asked))
    halves = lengths - lengths // 2 if backward else lengths // 2
    out = []
    for begin in range(0, len(asked), 20_000):
        part, half = asked[begin:begin + 20_000], halves[begin:begin + 20_000]
        own, near = search(index, [w[::-1] for w in part] if backward else part, half)
        if backward and len(own):
            # With the other half equal too, the other side finds the pair.
            new = np.array([not kept[j][0].endswith(part[i][:lengths[begin + i] // 2][::-1]) for i, j in zip(own.tolist(), near.tolist())])
            own, near = own[new], near[new]
        if not len(own):
            continue
        best = np.lexsort((order[near], -count[near], own))
        own, near = own[best], near[best]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sizes = np.diff(np.append(first, len(own)))
        top = near[first].tolist()
        out.append(pa.table([
            pa.array([part[i] for i in own[first].tolist()], pa.string()), pa.array(sizes, pa.int64()), pa.array(count[top]),
            pa.array([kept[j][0][::-1] if backward else kept[j][0] for j in top], pa.string())], schema=_FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


def near_words(words: DataFrame, key_length: int = LEAST_LENGTH // 2, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``word, n_near, near_n, near`` of the words of a vocabulary ``word, n`` that have near words.

    Words need ``2 * key_length`` letters. A key that holds more than a shard's letters is split
    into pieces, and each piece of its words is searched in each piece of its index, so no task
    holds more than two pieces however frequent the key is.
    """
    keys = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.left("word", F.lit(key_length)).alias("key")),
        F.struct(F.lit(1).alias("side"), F.right("word", F.lit(key_length)).alias("key")),
    ))
    dealt = words.select("word", "n", keys.alias("k")).select("word", "n", "k.side", "k.key")
    sizes = cut(dealt.groupBy("side", "key").agg(F.sum(F.length("word") + 1).alias("chars")).select(
        "side", "key", F.ceil(F.col("chars") / shard_chars).cast("int").alias("pieces"), "chars"))
    total = sizes.where("side = 0").agg(F.sum("chars")).head()[0] or 0
    shards = max(1, -(-2 * total // shard_chars))
    split = sizes.where("pieces > 1").select("side", "key", "pieces")
    rows = dealt.join(split, ["side", "key"], "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("pieces", F.lit(1))).cast("int"))
    whole = rows.where("pieces is null").select(
        "side", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "word", "n", F.lit(True).alias("indexed"), F.lit(True).alias("asked"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    # A word is indexed in its own piece for all pieces of words, and asked in all pieces of the index.
    both: Column = F.concat(
        F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
        F.transform(F.filter(every, lambda i: i != F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    pieces = rows.where("pieces is not null").select("side", "key", "word", "n", "own", F.explode(both).alias("g")).select(
        "side", F.xxhash64("key", "g.i", "g.j").alias("shard"), "word", "n",
        (F.col("g.i") == F.col("own")).alias("indexed"), (F.col("g.j") == F.col("own")).alias("asked"))
    found = whole.union(pieces).groupBy("side", "shard").applyInArrow(
        _search_shard, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near"))


def _roots(forms: DataFrame, factor: int) -> DataFrame:
    """``word, root`` of all words with a form: each round doubles the steps that a link spans.

    Along a chain counts grow by ``factor`` at least, so 63 bits of counts bound its length and
    the rounds; they end sooner when no link's end goes on.
    """
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return links


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    factor: int = FACTOR, noise: int = NOISE, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary of ``docs``.

    Words are maximal runs of ASCII letters and of U+00C0 to U+00FF in whole texts, A to Z
    lower-cased, one in ``noise`` by its hash without one letter. ``form`` is the most frequent near
    word (ties: the smaller) if it is ``factor`` times as frequent, else null; ``root`` is where
    forms lead. Null and empty texts have no words; a document without id hashes as an empty id;
    repeated rows count each; further columns are ignored; an empty table gives no rows.
    """
    if least_length < 2 or factor < 2:
        raise ValueError("words need two halves, and forms must be more frequent than their variants")
    words = cut(vocabulary(docs, id_col, text_col, least_length, least_count, noise))
    near = near_words(words, least_length // 2, shard_chars)
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "near_n", "near"))
    is_form = F.col("near_n") >= factor * F.col("n")
    found = known.select(
        "word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    roots = _roots(found.where("form is not null"), factor)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
