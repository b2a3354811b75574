"""Token ids in files of bit-plane-shuffled, zstandard-compressed blocks.

A chunk holds whole documents. Its ids are cut into blocks of BLOCK ids (the last one shorter); each block is transposed
into planes - bytes or bits of the 32-bit ids, most alike values side by side - and every plane is compressed by itself.
The layout of a chunk, all numbers little-endian:

    magic "BPZ1" | u8 plane bits (1 or 8) | u32 documents | u32 block size | u64 ids
    documents: i64 id each, then a byte each that is 1 where the id is null, then u32 number of ids each
    index: for each block and plane, u32 length in bytes
    planes, in the order of the index

Chunks are rows of a Parquet table (shard, chunk, first, n_ids, payload), so Spark's writers commit them, on any file
system, and a lost task is written again. Shards are ranges of document ids; ``first`` counts the shard's ids before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks
from .tokens import white_space_ids_of

BLOCK = 1 << 14
#: A chunk is closed when it has this many ids; one longer document is a chunk of its own.
CHUNK_IDS = 1 << 18
#: Bytes of text whose words are looked up together; the more, the more of them are equal.
TEXT_BYTES = 1 << 23
PLANE_BITS = 8
MAGIC = b"BPZ1"
_HEAD = struct.Struct("<4sBIIQ")
SCHEMA = "shard int, chunk int, first long, n_ids long, payload binary"


def to_planes(block: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of uint32 ids, the lowest bits first."""
    rows = block.view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [rows[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view(np.uint32)[:, 0]
    flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(flat, axis=1, bitorder="little")).view(np.uint32)[:, 0]


def write_chunk(docs: list[int | None], ids: list[np.ndarray], bits: int = PLANE_BITS, block: int = BLOCK) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    planes = [press(p) for at in range(0, len(flat), block) for p in to_planes(flat[at : at + block], bits)]
    return b"".join(
        [
            _HEAD.pack(MAGIC, bits, len(docs), block, len(flat)),
            np.array([d or 0 for d in docs], np.int64).tobytes(),
            bytes(d is None for d in docs),
            np.array([len(x) for x in ids], np.uint32).tobytes(),
            np.array([len(p) for p in planes], np.uint32).tobytes(),
            *planes,
        ]
    )


def read_chunk(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, where each one's token ids start (and the end), and all token ids."""
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress
    magic, bits, docs, block, n = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("this is no chunk of a token-id file")
    at = _HEAD.size
    names = np.frombuffer(payload, np.int64, docs, at).tolist()
    missing = payload[at + 8 * docs : at + 9 * docs]
    sizes = np.frombuffer(payload, np.uint32, docs, at + 9 * docs)
    at += 13 * docs
    per, blocks = 32 // bits, -(-n // block)
    index = np.frombuffer(payload, np.uint32, per * blocks, at)
    ends = at + 4 * len(index) + np.cumsum(index, dtype=np.int64)
    planes = [unpress(payload[e - k : e]) for e, k in zip(ends.tolist(), index.tolist(), strict=True)]
    parts = [from_planes(planes[k * per : (k + 1) * per], min(block, n - k * block), bits) for k in range(blocks)]
    starts = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return [None if m else d for d, m in zip(names, missing, strict=True)], starts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shards: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encodes each whole text (null: empty), appends ``end_id`` to each, and writes all ids to ``path`` in ascending
    order of the document ids: null ids first, rows that repeat an id in the order of their texts. Very long
    texts are encoded whole. Other columns are not read; an empty table gives a table without chunks."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        from pyspark import TaskContext

        shard, number, first = TaskContext.get().partitionId(), 0, 0
        docs, ids, held = [], [], 0

        def chunk():
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "chunk": pa.array([number], pa.int32()), "first": [first], "n_ids": [held], "payload": pa.array([write_chunk(docs, ids)], pa.binary())}
            )

        end = np.array([] if end_id is None else [end_id], np.uint32)
        for part in chunks(batches, most=TEXT_BYTES):
            found = white_space_ids_of(tokenizer, part.column("text").to_pylist())
            for doc, own in zip(part.column("doc_id").to_pylist(), found, strict=True):
                docs.append(doc)
                ids.append(np.append(own, end))
                held += len(ids[-1])
                if held >= CHUNK_IDS:
                    yield chunk()
                    number, first, docs, ids, held = number + 1, first + held, [], [], 0
        if docs:
            yield chunk()

    ordered = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str, make=None, schema: str = "ids array<int>") -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, and its ids, or
    what ``make(starts, ids)`` makes of those of a chunk. Chunks are read on their own, wherever they are needed.

    A null or empty text's document has its end id alone, a very long one's is a chunk of its own, repeated ids are documents
    of their own; files of an empty table give no rows."""
    table = spark.read.schema(SCHEMA).parquet(path)
    # One row a shard: their sums, and not ids, are put in order in one place.
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    names = ["doc_id", "start", "n_tokens", *[x.split()[0] for x in schema.split(",")]]

    def listed(starts, ids):
        return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))]

    def run(batches):
        for batch in batches:
            for base, first, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs, starts, ids = read_chunk(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts[:-1] + (base + first)), pa.array(np.diff(starts)), *(make or listed)(starts, ids)], names
                )

    rows = table.join(F.broadcast(before), "shard").select("before", "first", "payload")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def crc32s(starts: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    return [pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64())]
