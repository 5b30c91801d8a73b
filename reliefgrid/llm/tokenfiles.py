"""Token-id files: fixed-width bit packing in blocks that hold whole documents.

Every id takes the fewest bits that the vocabulary needs. A block is one Parquet row: the packed
ids of consecutive documents, their ids and lengths, its shard, and where it begins in the shard.
Blocks unpack on their own with numpy, so a block, or a document of it, can be read alone. Parquet
carries the blocks, so writing is atomic and works on any store that Spark can reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import slices

BLOCK_IDS = 1 << 16
#: Pieces of text whose ids a worker remembers, and their characters; it starts over beyond either.
MEMO, MEMO_CHARS = 800_000, 16_000_000


def bit_width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, lowest bit first, the last byte filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, count: int, begin: int = 0) -> np.ndarray:
    """``count`` ids from the ``begin``-th on."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, begin * width // 8).astype(np.uint32)
    first, last = begin * width // 8, -(-(begin + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)[first:last], bitorder="little")
    skip = begin * width - 8 * first
    bits = bits[skip:skip + count * width].reshape(count, width)
    return bits @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class _Memo(dict):
    """Numbers pieces as they come and lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece):
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Encodes texts with a tokenizers file, each distinct word once.

    Byte-level BPE works on pieces that a single space between two other characters always
    separates, so a text is the pieces between its spaces, encoded one by one. Texts with other
    white space around a space, and at their ends, are encoded whole, and so are texts with one of
    the vocabulary's added tokens, which are found before a text is cut into pieces.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        vocabulary = self.model.get_vocab()
        #: Ids that begin with a space; in byte-level vocabularies that byte is written so.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.memo, self.flat, self.used, self.chars = _Memo(), np.zeros(1 << 16, np.uint32), 0, 0
        self.begin, self.size, self.odd = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, bool))

    def _learn(self, new: list) -> None:
        """Encodes new pieces: all that follow a space in one text, the first ones of texts alone."""
        known, n = len(self.memo) - len(new), len(self.memo)
        begins, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        parts: list[np.ndarray] = []
        heads, tails, at = [], [], self.used
        for i, piece in enumerate(new):
            text = piece if isinstance(piece, str) else piece[0]
            self.chars += len(text)
            if text and not text[0].isspace() and not text[-1].isspace():
                (tails if text is piece else heads).append(i)
        for i, x in zip(heads, self.model.encode_batch_fast([new[i][0] for i in heads], add_special_tokens=False)):
            parts.append(np.array(x.ids, np.uint32))
            begins[i], sizes[i] = at, len(parts[-1])
            at += len(parts[-1])
        for low in range(0, len(tails), 4096):
            part = tails[low:low + 4096]
            joined = np.array(self.model.encode(" " + " ".join([new[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            first = np.flatnonzero(self.spaced[joined])
            begins[part], sizes[part] = at + first, np.diff(np.append(first, len(joined)))
            parts.append(joined)
            at += len(joined)
        if n > len(self.size):
            more = max(n, 2 * len(self.size)) - len(self.size)
            self.begin, self.size, self.odd = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.begin, self.size, self.odd))
        if at > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(at - self.used, len(self.flat)), np.uint32)])
        if parts:
            self.flat[self.used:at] = np.concatenate(parts)
        self.size[known:n] = sizes
        self.begin[known:n] = begins
        self.odd[known:n] = sizes == 0
        self.used = at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.clear()
        slots, new = [], self.memo.new
        number = self.memo.__getitem__
        for text in texts:
            if any(x in text for x in self.added):
                slots.append(None)
                continue
            pieces = text.split(" ")
            pieces[0] = (pieces[0],)
            slots.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if new:
            self._learn(new)
            new.clear()
        out = []
        for text, own in zip(texts, slots):
            if own is None or self.odd[own].any():
                out.append(np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            sizes = self.size[own]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.begin[own] - ends + sizes, sizes) + np.arange(int(ends[-1]))])
        return out

    @property
    def vocabulary(self) -> int:
        return self.model.get_vocab_size()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of a tokenizers file, or of one of the public vocabularies by its name."""
    if name not in _ENCODERS:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]


_BLOCK = pa.schema([
    ("shard", pa.int32()), ("begin", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def _encode_blocks(batches, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    width, shard, begin = bit_width(model.vocabulary), TaskContext.get().partitionId(), 0
    docs, parts, held = [], [], 0

    def block() -> pa.RecordBatch:
        row = {"shard": shard, "begin": begin, "n_ids": held, "width": width, "docs": docs,
               "lengths": [len(x) for x in parts], "payload": pack(np.concatenate(parts), width)}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for low, high in slices(texts):
            encoded = model.encode([x or "" for x in texts.slice(low, high - low).to_pylist()])
            for doc, own in zip(ids[low:high], encoded):
                docs.append(doc)
                parts.append(np.append(own, np.uint32(end_id)))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block()
                    docs, parts, begin, held = [], [], begin + held, 0
    if docs:
        yield block()


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes blocks in ascending order of ids.

    ``vocabulary`` is a path that every worker reaches, or the name of a public vocabulary, whose
    place each worker asks for. A null text is empty and has the end id alone. Rows without id come first; rows of a repeated
    id follow each other in the order of a hash of their texts. Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(
        partial(_encode_blocks, path=vocabulary, end_id=end_id),
        "shard int, begin long, n_ids long, width int, docs array<long>, lengths array<long>, payload binary",
    )
    blocks.write.parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before each in all shards."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    bases = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    return blocks.join(bases, "shard").withColumn("start", F.col("_base") + F.col("begin")).drop("_base")


def _documents(batches, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, width, docs, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
            ids = unpack(payload, width, sum(lengths))
            ends = np.cumsum(lengths)
            own = [ids[e - n:e] for e, n in zip(ends.tolist(), lengths)]
            last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last],
                ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids of every document, or with ``digest`` their crc32."""
    columns = read_blocks(spark, path).select("start", "width", "docs", "lengths", "payload")
    last = "ids_crc32 long" if digest else "ids array<int>"
    return columns.mapInArrow(partial(_documents, digest=digest), f"doc_id long, start long, n_tokens long, {last}")


def read_range(spark: SparkSession, path: str, begin: int, count: int) -> np.ndarray:
    """Random access: ids ``begin`` to ``begin + count`` of the whole stream, from the blocks that hold them."""
    rows = (
        read_blocks(spark, path).where((F.col("start") < begin + count) & (F.col("start") + F.col("n_ids") > begin))
        .orderBy("start").select("start", "n_ids", "width", "payload").collect()
    )
    parts = []
    for row in rows:
        low, high = max(begin, row.start) - row.start, min(begin + count, row.start + row.n_ids) - row.start
        parts.append(unpack(row.payload, row.width, high - low, low))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
