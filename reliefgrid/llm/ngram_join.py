"""N-gram Jaccard join: signature trees within blocks of documents that share a rare shingle.

Two sets that link share ``k`` of their first ``n - ceil(t * n) + k`` shingles in any order of all
shingles, so blocks by those shingles lose no link. ``k`` grows with the set: a set whose leading
shingles are seldom held by another one of like size links with none. The order puts frequent
shingles last.
Inside a block a signature tree is joined with itself by dual traversal.

1. One pass over the texts gives each document's set size and fingerprint, and the shingles that
   at least ``1 / SHARE`` of the documents hold (at most ``SHARE`` times the mean set size many,
   whatever the table holds, so that list is collected and broadcast).
2. Equal fingerprints form a class; only classes go on.
3. A second pass packs the leading shingles into buckets of bounded size; each bucket finds the
   shingles that several classes of like size hold. Frequent shingles are spread over buckets by
   class. Shingles with the same classes become one block. Classes with fewer than ``k`` such
   shingles go no further, and each class leaves the ``k - 1`` that most classes hold.
4. Classes that blocks connect form clusters. A small cluster is one tree, joined with itself.
5. In larger clusters each class meets its largest block in two random divisions into small
   chunks. What links is merged, so a large group of near copies is one component after this step.
   Blocks that still hold several components are joined completely, large ones as a grid of
   chunk pairs; chunk pairs of one component are skipped.

No block, group or partner list is cut: what is skipped is already known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.llm import sigtree
from reliefgrid.llm.components import components
from reliefgrid.llm.textbytes import fingerprint, mix, shingle_sets, slices
from reliefgrid.session import cut

#: A shingle is frequent when one document in so many holds it, and spread over buckets when one
#: in ``SPREAD`` and 256 do.
SHARE = 4000
SPREAD = 1000
#: Leading shingles in a bucket, about. A task holds one bucket.
BUCKET = 1_000_000
#: Leading shingles that a task gathers before it sends them on.
FLUSH = 500_000
#: Bytes of texts, and of sets of classes, that a task holds as arrays at a time.
HELD_BYTES = 1 << 19
#: ``k`` is this part of the percentage: more leading shingles, fewer sets with enough of them in common.
AGREED = 600
#: Classes of a block up to which their bitmaps meet in one task.
HOPE_LIMIT = 1024
#: Members and shingles of a chunk, about.
CHUNK_MEMBERS = 96
CHUNK_SHINGLES = 200_000
#: The same where chunks are joined in pairs.
PAIR_MEMBERS = 1024
PAIR_SHINGLES = 4_000_000
#: A cluster of classes that share leading shingles is joined at once up to this size.
SMALL_MEMBERS = 192
SMALL_SHINGLES = 2_000_000
#: Bits of the filter that keeps texts of no wanted class out of a shuffle.
FILTER_BITS = 1 << 26


def _sets(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(batch.schema.get_field_index(column))
    for begin, end in slices(texts, HELD_BYTES):
        yield from enumerate(shingle_sets(texts.slice(begin, end - begin), size), begin)


def _repeated(hashes: np.ndarray, counts: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes with their counts after ``fresh`` ones came; new are those there at least twice. Sorts ``fresh``."""
    fresh.sort()

    def there(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(fresh, values, "right") - np.searchsorted(fresh, values, "left")

    same = fresh[1:] == fresh[:-1]
    new = np.setdiff1d(fresh[1:][same], hashes)
    both, total = np.concatenate([hashes, new]), np.concatenate([counts + there(hashes), there(new)])
    order = np.argsort(both)
    return both[order], total[order]


def _profile(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document's size and fingerprint; of kind 1: a shingle frequent here and its count."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("bits", pa.binary())])
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, held, seen, documents = [], 0, set(), 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = []
        for row, members in _sets(batch, "text", size):
            prints = fingerprint(members)
            rows.append((0, ids[row], len(members), *prints, sigtree.bitmap(members, sigtree.narrow_width(len(members))).tobytes()))
            documents += 1
            if prints[0] not in seen:
                seen.add(prints[0])
                waiting.append(members)
                held += len(members)
            if held > 2_000_000:
                fresh, waiting, held = np.concatenate(waiting), [], 0
                hashes, counts = _repeated(hashes, counts, fresh)
                del fresh
            if len(seen) > 200_000:
                seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
    hashes, counts = _repeated(hashes, counts, np.concatenate([hashes[:0], *waiting]))
    often = counts >= max(2, documents // (4 * SHARE))
    hashes, counts = hashes[often], counts[often]
    n = len(hashes)
    if n:
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(counts),
            pa.array(hashes.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
        ], schema=schema)


def _agreed(n: int, percent: int) -> int:
    """How many leading shingles two sets share at least if they link, the smaller one of this size.

    It is far below ``percent`` of them, so a link of sets with different sizes holds as many.
    """
    return max(1, n * percent // AGREED)


def _leading(members: np.ndarray, frequent: np.ndarray, counts: np.ndarray, spread: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading shingles of a set, rare ones first, and which of them are to be spread."""
    n = len(members)
    want = n - -(-n * percent // 100) + _agreed(n, percent)
    at = np.searchsorted(frequent, members)
    if len(frequent):
        at[at == len(frequent)] = 0
        known = frequent[at] == members
    else:
        known = np.zeros(n, bool)
    if want <= n - int(known.sum()):
        rare = members[~known][:want]
        return rare, np.zeros(len(rare), bool)
    often, size = members[known], counts[at[known]]
    order = np.lexsort((often, size))
    both = np.concatenate([members[~known], often[order]])[:want]
    wide = np.concatenate([np.zeros(n - len(often), bool), size[order] >= spread])[:want]
    return both, wide


def _postings(batches, size: int, percent: int, buckets: int, frequent) -> Iterator[pa.RecordBatch]:
    """Leading shingles packed by bucket, with the fingerprint, set size and number of shingles there of each class."""
    names = ["bucket", "tokens", "often", "prints", "sizes", "runs"]
    tokens, prints, sizes, often, held = [], [], [], [], 0

    def packed():
        token, owner, n, hot = (np.concatenate(x) for x in (tokens, prints, sizes, often))
        # A frequent shingle goes to as many buckets as its classes need.
        spread = np.where(hot, mix(owner.view(np.uint64)), np.uint64(0))
        bucket = (mix(token ^ spread) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for part in np.split(order, edges[1:]):
            own = owner[part]
            begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            runs = np.diff(np.append(begin, len(own))).astype(np.int32)
            yield (int(bucket[part[0]]), token[part].tobytes(), np.packbits(hot[part]).tobytes(),
                   own[begin].tobytes(), n[part][begin].tobytes(), runs.tobytes())

    def flush():
        rows = list(packed())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 5))], names)

    seen: set[int] = set()
    for batch in batches:
        for _, members in _sets(batch, "text", size):
            if not len(members):
                continue
            own = fingerprint(members)[0]
            if own in seen:
                continue
            if len(seen) > 200_000:
                seen = set()
            seen.add(own)
            lead, hot = _leading(members, *frequent.value, percent)
            # Not a view, which would keep the whole set.
            tokens.append(lead.copy())
            prints.append(np.full(len(lead), own, np.int64))
            sizes.append(np.full(len(lead), len(members), np.int32))
            often.append(hot)
            held += len(lead)
            if held > FLUSH:
                yield flush()
                tokens, prints, sizes, often, held = [], [], [], [], 0
    if held:
        yield flush()


def _dealt(postings: DataFrame, buckets: int) -> DataFrame:
    """One bucket a task. Hashes of their numbers would put several into one task and none into others."""
    return postings.repartitionById(buckets, F.col("bucket").cast("int"))


def _blocks(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket: shingles that several classes of like size hold, one for each distinct list of classes.

    ``weight`` counts the shingles of the block.
    """
    parts = []
    for batch in batches:
        for tokens, hot, prints, sizes, runs in zip(*([x.as_buffer() for x in batch.column(i)] for i in range(1, 6))):
            token, run = np.frombuffer(tokens, np.uint64), np.frombuffer(runs, np.int32)
            parts.append((token, np.repeat(np.frombuffer(prints, np.int64), run), np.repeat(np.frombuffer(sizes, np.int32), run),
                          np.unpackbits(np.frombuffer(hot, np.uint8), count=len(token)).astype(bool)))
    if not parts:
        return
    token, owner, n, often = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((owner, n, token))
    token, owner, n, often = token[order], owner[order], n[order].astype(np.int64), often[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner, n, often = token[new], owner[new], n[new], often[new]
    # A list ends where the next larger set is too large to link; a spread shingle is not seen whole here.
    ends = (token[1:] != token[:-1]) | (~often[1:] & (100 * n[:-1] < percent * n[1:]))
    begin = np.flatnonzero(np.concatenate(([True], ends)))
    count = np.diff(np.append(begin, len(token)))
    lists = mix(np.add.reduceat(mix(owner.view(np.uint64)), begin) + count.astype(np.uint64))
    hot = often[begin]
    lists[hot] = token[begin][hot]
    _, first, copies = np.unique(lists, return_index=True, return_counts=True)
    weight = np.zeros(len(begin), np.int64)
    weight[first] = copies
    weight[~hot & (count < 2)] = 0
    weights = np.repeat(weight, count)
    chosen = weights > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(lists, count)[chosen].view(np.int64)), pa.array(owner[chosen]), pa.array(weights[chosen])], ["block", "fp", "weight"]
    )


def _set_rows(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The sets of classes; their clusters come along."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def packed():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["class", "cluster", "small", "members"])

    rows, held = [], 0
    for batch in batches:
        owner, wanted, cluster, small = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
        for row, members in _sets(batch, "text", size):
            if fingerprint(members)[0] != wanted[row]:
                continue
            rows.append((owner[row], cluster[row], small[row], members.tobytes()))
            held += members.nbytes
            if held > HELD_BYTES:
                yield packed()
                rows, held = [], 0
    if rows:
        yield packed()


def _hopeful_rows(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block those whose bitmap could link with another one of the block."""
    current, rows = None, []

    def kept():
        marks = sigtree.hopeful([np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], percent)
        own = [r[0] for r, m in zip(rows, marks) if m]
        return pa.RecordBatch.from_arrays([pa.array([current] * len(own), pa.int64()), pa.array(own, pa.int64())], ["block", "class"])

    for batch in batches:
        for block, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if block != current:
                if len(rows) > 1:
                    yield kept()
                current, rows = block, []
            rows.append(row)
    if len(rows) > 1:
        yield kept()


def _link_group(table: pa.Table, percent: int) -> pa.Table:
    """Links of one chunk, or of a pair of chunks when both sides are there."""
    owner, label, side, blobs = (table.column(x).to_pylist() for x in ("class", "label", "side", "members"))
    sets = [np.frombuffer(x, np.uint64) for x in blobs]
    left = [i for i, s in enumerate(side) if s == 0]
    right = [i for i, s in enumerate(side) if s == 1]
    found = sigtree.cross_links(sets, label, left, right, percent) if left and right else sigtree.links(sets, label, percent)
    return pa.table({"a": pa.array([owner[i] for i, _ in found], pa.int64()), "b": pa.array([owner[j] for _, j in found], pa.int64())})


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each group of ``block, x, y`` of rows with their sets."""
    def link(table: pa.Table) -> pa.Table:
        return _link_group(table, percent)

    keys = ["block", "x", "y"]
    return rows.select(*keys, "class", "label", "side", "members").groupBy(*keys).applyInArrow(link, "a long, b long")


def _likely_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of ``wanted`` classes and few others, without a shuffle of the texts.

    The ids set bits of a filter of ``FILTER_BITS`` bits, so at most a 64th of that many rows are
    broadcast whatever the table holds. A full filter lets more texts through and loses none.
    """
    def slot(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))

    def word(key: str) -> Column:
        return F.floor(slot(key) / 64)

    def place(key: str) -> Column:
        return F.pmod(slot(key), F.lit(64)).cast("int")

    one = F.lit(1).cast("long")
    bits = wanted.groupBy(word("class").alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, place("class"))).alias("bits"))
    return (
        texts.withColumn("word", word("id")).join(F.broadcast(bits), "word")
        .where(F.getbit("bits", place("id")) == 1).select("id", "text")
    )


def _parts(count: str, weight: str) -> Column:
    return F.ceil(F.greatest(F.col(count) / CHUNK_MEMBERS, F.col(weight) / CHUNK_SHINGLES))


def _pair_parts(count: str, weight: str) -> Column:
    """Chunks of a block that are joined in pairs; at least four where there is work for several tasks."""
    least = F.when(F.col(count) > SMALL_MEMBERS, 4).otherwise(1)
    return F.greatest(least, F.ceil(F.col(count) / PAIR_MEMBERS), F.ceil(F.col(weight) / PAIR_SHINGLES))


def _first_chunks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each class in its largest block, under two random divisions of large blocks."""
    best = (
        members.join(sizes, "block")
        .groupBy("class")
        .agg(F.max(F.struct("count", "block", "parts")).alias("best"))
        .select("class", "best.block", "best.parts")
    )
    seeds = F.when(F.col("parts") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return best.withColumn("seed", F.explode(seeds)).select(
        "block", F.col("seed").cast("long").alias("x"),
        F.pmod(F.xxhash64("seed", "class"), F.col("parts")).alias("y"),
        "class", F.col("class").alias("label"), F.lit(0).alias("side"),
    )


def _wide_blocks(wide: DataFrame, open_rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and sizes of the blocks of large clusters.

    A cluster is one block where that moves fewer rows than its blocks do together.
    """
    rows = cut(open_rows.join(wide, "class"))
    moved = rows.groupBy("cluster").agg(F.count("*").alias("moved"))
    merged = moved.join(spans, "cluster").where(F.col("count") * _pair_parts("count", "weight") <= F.col("moved")).select("cluster")
    whole = wide.join(merged, "cluster").select(F.col("cluster").alias("block"), "class", "n")
    apart = rows.join(merged, "cluster", "left_anti").select("block", "class", "n")
    members = cut(whole.union(apart))
    sizes = members.groupBy("block").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).withColumn("parts", _parts("count", "weight"))
    return members.select("block", "class"), cut(sizes)


def _mixed_chunks(members: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks and chunk pairs of blocks that still hold several components."""
    known = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "block", "class", F.coalesce("label", "class").alias("label")
    )
    mixed = known.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("block")
    # What is left meets in pairs, so fewer and larger chunks move less.
    larger = sizes.select("block", "count", _pair_parts("count", "weight").alias("parts"))
    rows = known.join(mixed, "block", "left_semi").join(larger, "block")
    inner = rows.groupBy("block", "label").agg(F.count("*").alias("own"))
    rows = rows.join(inner, ["block", "label"]).withColumn(
        "chunk",
        F.when(F.col("parts") == 1, F.lit(0).cast("long")).otherwise(
            F.pmod(F.xxhash64("label"), F.col("parts")) * 1048576
            + F.pmod(F.xxhash64(F.lit(3), "class"), F.ceil(F.col("own") * F.col("parts") / F.col("count")))
        ),
    )
    rows = cut(rows.select("block", "chunk", "class", "label"))
    parts = rows.groupBy("block", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x = parts.select("block", F.col("chunk").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh"))
    y = parts.select("block", F.col("chunk").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    pairs = x.join(y, "block").where("x <= y and least(xl, yl) < greatest(xh, yh)").select("block", "x", "y")
    sides = pairs.withColumn(
        "part", F.explode(F.expr("case when x = y then array(struct(x as chunk, 0 as side)) else array(struct(x as chunk, 0 as side), struct(y as chunk, 1 as side)) end"))
    ).select("block", "x", "y", "part.chunk", "part.side")
    return sides.join(rows, ["block", "chunk"]).select("block", "x", "y", "class", "label", "side")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space. Two documents link when their sets of
    ``size``-word shingles have a Jaccard similarity of at least ``percent / 100``. The component
    id is the smallest id reachable by links. A null or wordless text has no shingles and links
    with nothing, not even with its like. Rows of a repeated id are returned each; a row without
    id takes no part in links and has no component. Further columns are ignored.

    Sets are held as 64-bit hashes: for N classes the chance of any false merge is N^2 / 2^64.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = cut(texts.mapInArrow(partial(_profile, size=size), "kind int, id long, n long, fp long, fp2 long, bits binary"))
    rows = profile.where("kind = 0")
    totals = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    often = (
        profile.where("kind = 1").groupBy("fp").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(2, totals[0] // SHARE)).toArrow()
    )
    hashes = often.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], often.column("n").to_numpy().astype(np.int64)[order], max(256, totals[0] // SPREAD)))
    del often, hashes, order

    buckets = max(16, int(totals[1] * (AGREED * (100 - percent) + 100 * percent) // (100 * AGREED) // BUCKET) + 1)
    postings = texts.mapInArrow(
        partial(_postings, size=size, percent=percent, buckets=buckets, frequent=frequent),
        "bucket long, tokens binary, often binary, prints binary, sizes binary, runs binary",
    )
    blocks = cut(
        _dealt(postings, buckets).mapInArrow(partial(_blocks, percent=percent), "block long, fp long, weight long")
        .groupBy("block", "fp").agg(F.sum("weight").alias("weight"))
    )
    # The blocks are written, so nothing reads the list again.
    frequent.destroy()

    classes = cut(rows.where("n > 0 and id is not null").groupBy("fp", "fp2", "n").agg(F.min("id").alias("class")))
    # The partner of a class can be smaller than the class; what both share follows from the smaller one.
    agreed = F.greatest(F.lit(1), F.expr(f"(n * {percent} + 99) div 100 * {percent} div {AGREED}"))
    likely = blocks.groupBy("fp").agg(F.sum("weight").alias("shared")).join(classes, "fp").where(F.col("shared") >= agreed)
    shared = cut(blocks.join(likely, "fp").select("block", "class", "n", "fp", "weight"))
    # All classes rank blocks alike, so of the shingles that two of them must share the rarest one is never left out.
    popular = Window.partitionBy("class", "fp").orderBy(F.desc("count"), "block")
    counts = shared.groupBy("block").agg(F.count("*").alias("count")).where("count > 1")
    ranked = shared.join(counts, "block").withColumn("so_far", F.sum("weight").over(popular.rowsBetween(Window.unboundedPreceding, 0)))
    members = cut(ranked.where(F.col("so_far") >= agreed).select("block", "class", "n", "fp"))
    sizes = cut(
        members.groupBy("block").agg(F.count("*").alias("count"), F.sum("n").alias("weight")).where("count > 1")
        .withColumn("parts", _parts("count", "weight"))
    )
    # The bitmaps of a block tell which classes could link at all. Very large blocks go on whole:
    # most of their classes are near copies, and merging them is cheaper than telling them apart.
    bits = rows.where("n > 0").select(F.col("id").alias("class"), "fp", "bits")
    tested = members.join(sizes.where(F.col("count") <= HOPE_LIMIT).select("block"), "block").join(bits, ["class", "fp"])
    hopeful = tested.select("block", "class", "n", "bits").repartition("block").sortWithinPartitions("block").mapInArrow(
        partial(_hopeful_rows, percent=percent), "block long, class long")
    untested = members.join(sizes.where(F.col("count") > HOPE_LIMIT).select("block"), "block", "left_semi").select("block", "class")
    open_rows = cut(hopeful.union(untested).distinct())
    least = open_rows.groupBy("block").agg(F.min("class").alias("least"))
    clusters = components(open_rows.join(least, "block").select(F.col("class").alias("a"), F.col("least").alias("b"))).select(
        F.col("node").alias("class"), F.col("label").alias("cluster"))
    inner = cut(members.select("class", "n", "fp").distinct().join(clusters, "class"))
    spans = inner.groupBy("cluster").agg(F.count("*").alias("count"), F.sum("n").alias("weight"))
    small = (F.col("count") <= SMALL_MEMBERS) & (F.col("weight") <= SMALL_SHINGLES)
    placed = cut(inner.join(spans.select("cluster", small.alias("small")), "cluster"))
    sets = cut(
        placed.join(_likely_texts(texts, placed), F.col("class") == F.col("id")).select("class", "text", "fp", "cluster", "small")
        .mapInArrow(partial(_set_rows, size=size), "class long, cluster long, small boolean, members binary")
    )
    zero = F.lit(0).cast("long")
    found = cut(_linked(sets.where("small").select(
        F.col("cluster").alias("block"), zero.alias("x"), zero.alias("y"), "class", F.col("class").alias("label"), F.lit(0).alias("side"), "members"), percent))
    wide = cut(placed.where("not small").select("class", "n", "cluster"))
    if not wide.isEmpty():
        # Only the sets of large clusters move once more.
        large = sets.where("not small").select("class", "members")
        members, sizes = _wide_blocks(wide, open_rows, spans)
        near = cut(_linked(_first_chunks(members, sizes).join(large, "class"), percent))
        rest = cut(_linked(_mixed_chunks(members, sizes, components(near)).join(large, "class"), percent))
        found = found.union(near).union(rest)
    labels = components(found)

    grouped = classes.join(labels, F.col("class") == F.col("node"), "left").select(
        F.col("fp").alias("g1"), F.col("fp2").alias("g2"), F.col("n").alias("g3"), F.coalesce("label", "class").alias("component"),
    )
    same = (F.col("fp") == F.col("g1")) & (F.col("fp2") == F.col("g2")) & (F.col("n") == F.col("g3"))
    result = rows.join(grouped, same, "left").withColumn(
        "component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    )
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
