"""Token-ID output: fixed-width bit packing with block offsets.

A file ("shard") holds whole documents in ascending id order. Little-endian:

    4s magic "BPK1" | u8 bits | 3 zero bytes | u32 documents | u32 ids a block | u64 ids | u64 blocks
    i64 id of each document | u8 1 where that id is null | u64 first id of each document, and the end
    u64 byte offset of each block in the data, and the end | data

Each id takes the fewest bits that the vocabulary needs, lowest bit first; a
block holds a multiple of eight ids and so starts on a whole byte. Any range of
ids is read by unpacking just the blocks that hold it.

Documents are range-partitioned by id, so the shards of partition 0 come before
those of partition 1, and so on; where a document starts in the whole output is
a sum over partitions (one row each), plus where its shard starts in the
partition (the writer counts that), plus an offset in the shard. Shards are
written as binary values by Spark's own writer, which commits them atomically to
any file system Spark knows and repeats lost tasks; each value is the image of
one file. A shard closes at SHARD_IDS ids (128 kB at 16 bits), and each stands in
a row with its first and last document id, so a reader that wants one document
seeks to the pages of the shards that may hold it (read_documents) and unpacks
the blocks it needs. A longer document has a shard of its own.

Null and empty texts hold the end id only; null document ids come first; rows
with the same id stay apart, in any order among themselves; an empty table
gives no shards. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowsql.llm.bpe import byte_alphabet
from sparrowsql.llm.common import scratch, slices, utf8

HEAD = struct.Struct("<4sB3xIIQQ")
MAGIC = b"BPK1"
BLOCK_IDS = 1024
SHARD_IDS = 1 << 16
#: Entries in a process's table of encoded pieces before it starts anew, and their longest key.
TABLE_SIZE, KEY_SIZE = 350_000, 64


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    step = 64 * BLOCK_IDS
    return b"".join(
        np.packbits(((ids[a : a + step, None].astype(np.uint32) >> places) & 1).astype(np.uint8), bitorder="little").tobytes()
        for a in range(0, len(ids), step)
    )


def unpack_bits(raw: np.ndarray, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return raw[: count * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    flags = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack(doc_ids: list, tokens: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    """The image of one file."""
    if block % 8:
        raise ValueError("a block holds a multiple of eight ids")
    sizes = np.array([len(t) for t in tokens], np.int64)
    ids = np.concatenate([*tokens, np.zeros(0, np.uint32)])
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = -(-len(ids) // block)
    data = pack_bits(ids, bits)
    edges = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block * bits // 8), np.uint64(len(data)))
    return b"".join(
        [
            HEAD.pack(MAGIC, bits, len(doc_ids), block, len(ids), blocks),
            np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
            edges.astype("<u8").tobytes(),
            data,
        ]
    )


class Shard:
    """Random access to the image of one file."""

    def __init__(self, image: bytes):
        magic, self.bits, docs, self.block, self.size, blocks = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        raw, at = np.frombuffer(image, np.uint8), HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a, at = at, at + count * np.dtype(kind).itemsize
            return raw[a:at].view(kind)

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.edges = take("<u8", blocks + 1).astype(np.int64)
        self.data = raw[at:]

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to b, from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, -(-b // self.block)
        count = min(last * self.block, self.size) - first * self.block
        part = unpack_bits(self.data[self.edges[first] : self.edges[last]], self.bits, count)
        return part[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of each document, unpacked a run of blocks at a time."""
        a = 0
        while a < len(self.doc_ids):
            b = int(np.searchsorted(self.starts, self.starts[a] + 64 * self.block, side="right")) - 1
            b = min(max(b, a + 1), len(self.doc_ids))
            run = self.ids(int(self.starts[a]), int(self.starts[b]))
            for i in range(a, b):
                yield self.doc_ids[i], int(self.starts[i]), run[self.starts[i] - self.starts[a] : self.starts[i + 1] - self.starts[a]]
            a = b


class _Table(dict):
    """Encoded pieces; a piece that isn't there is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        made = self.encode(piece)
        if len(piece) <= KEY_SIZE:
            if len(self) >= TABLE_SIZE:
                self.clear()
            self[piece] = made
        return made


class ChunkEncoder:
    """A library tokenizer whose pieces never cross white space, behind a table of pieces.

    Texts of characters below U+0300 only are lower-cased and cut into the
    scheme's own pieces here (they are in normal form already, and each lower
    case is one character), and the library's model merges each piece's bytes;
    other texts are cut at white space, and the library does the rest.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.chunk = re.compile("[^ \t\n\r]+")
        low = [chr(c) for c in range(0x300)]
        letters = "".join(c for c in low if c.isalpha())
        numbers = "".join(c for c in low if unicodedata.category(c)[0] == "N")
        space = "\t\n\x0b\x0c\r \x85\xa0"  # Unicode's White_Space below U+0300
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.odd = re.compile("[\u0130\u023a\u023e\u0300-\U0010ffff]|<\\|")
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.pieces, self.chunks = _Table(self._piece), _Table(self._whole)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces, chunks = self.pieces.__getitem__, self.chunks.__getitem__
        made = []
        for t in texts:
            plain = "<|" not in t if t.isascii() else not self.odd.search(t)
            made.append(b"".join(map(pieces, self.piece.findall(t.lower()))) if plain else b"".join(map(chunks, self.chunk.findall(t))))
        return made

    def _piece(self, piece: str) -> bytes:
        said = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.lib.model.tokenize(said)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, chunk: str) -> bytes:
        ids = self.lib.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(spec: str) -> ChunkEncoder:
    return ChunkEncoder(spec)


# in_part: ids before the shard in its partition; low, high: the least and greatest document id, null where one is null.
SHARDS = "part int, shard int, n_docs long, n_tokens long, in_part long, low long, high long, image binary"
_SHARD_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
_SHARD_NAMES = ["part", "shard", "n_docs", "n_tokens", "in_part", "low", "high", "image"]
#: Partitions whose sums are broadcast; with more the sums are joined by a shuffle.
BROADCAST_PARTS = 1_000_000


def write(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode all documents and write their shards under path, in ascending id order."""
    spark = docs.sparkSession
    text = Path(vocabulary).read_text(encoding="utf-8")
    spec = spark.sparkContext.broadcast(text)
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_str(text).get_vocab_size(), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches):
        enc, part, count, before = encoder(spec.value), TaskContext.get().partitionId(), 0, 0
        ids, tokens, size = [], [], 0

        def close():
            nonlocal ids, tokens, size, count, before
            low, high = (None, None) if None in ids else (ids[0], ids[-1])
            row = [part, count, len(ids), size, before, low, high, pack(ids, tokens, bits)]
            ids, tokens, before, size, count = [], [], before + size, 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SHARD_KINDS, strict=True)], _SHARD_NAMES)

        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                names = batch.column(0).slice(a, b - a).to_pylist()
                for name, raw in zip(names, enc.encode(texts), strict=True):
                    made = np.frombuffer(raw + end, "<u4")
                    if ids and (size + len(made) > shard_ids or (name is None) != (ids[-1] is None)):
                        yield close()
                    ids.append(name)
                    tokens.append(made)
                    size += len(made)
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # rows of one id may be dealt to several tasks
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id").select("id", "text")
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "none").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """The shards under path, with the number of ids before each; the images aren't shuffled."""
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return files.join(parts, "part").withColumn("start", F.col("part_start") + F.col("in_part"))


def read_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """id, tokens of the documents with these ids: only the shards that may hold them are read, and only their blocks unpacked."""
    wanted = sorted(set(ids))
    may = F.lit(False)
    for i in wanted:
        may = may | ((F.col("low") <= i) & (F.col("high") >= i))

    def run(batches):
        for batch in batches:
            for image in batch.column(0):
                shard = Shard(image.as_py())
                found = [(name, shard.document(i)) for i, name in enumerate(shard.doc_ids) if name in wanted]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tokens"])

    held = spark.read.schema(SHARDS).parquet(path).where(may).select("image")
    return held.mapInArrow(run, "id long, tokens array<long>").withColumnRenamed("id", id_col)


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [
                    (name, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for name, at, ids in Shard(image.as_py()).documents()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["id", "start", "n_tokens", "ids_crc32"]
                )

    out = starts(spark, path).select("start", "image").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read each document's digest back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, vocabulary, path, end_id, id_col, text_col)
    return read_digests(spark, path, id_col)
