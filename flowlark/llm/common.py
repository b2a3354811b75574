"""What the corpus operators share: shared storage, bounded Arrow chunks, and vectorised words and hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import fresh_path, scratch, shared_dir, stored  # noqa: F401

#: Bytes of text that a task holds as NumPy arrays at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: White space between words, and nothing else: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"

#: Which bytes belong to a word: all but white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Each byte, with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 5)


#: Bytes of a batch that goes to a Python worker, where the session leaves Spark's 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def light_workers(spark: SparkSession) -> None:
    """Settings that keep Python workers small; the registered queries and the pipeline make them for their session.

    Batches of at most BATCH_BYTES where the session leaves Spark's 64 MB, and Arrow's memory from the system, since
    Arrow's own pool keeps what it once held and workers stay to serve one operator after the other.
    """
    if spark.conf.get(_BATCH, None) in ("67108864", "67108864b", "64MB", None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(0))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with at most ``most`` bytes of text each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its rows' offsets into them; null reads as empty. Offsets have 64 bits in Arrow's large
    types, which a session may ask for (``spark.sql.execution.arrow.useLargeVarTypes``)."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word; words never cross rows. ``table``: which bytes are in words."""
    inside = table[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    heads, tails = offsets[full], offsets[full + 1] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Keeps so many bytes of a load of 8.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: of up to 8 bytes the bytes themselves, mixed with their number; else a digest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, np.uint64, padded.data, strides=(1,))
    n = ends - starts
    out = mix64(mix64(loads[starts] & _KEEP[np.minimum(n, 8)]) + n.astype(np.uint64))
    long = np.flatnonzero(n > 8)
    if len(long):
        raw, known, found = data.tobytes(), {}, []
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            word = raw[a:b]
            digest = known.get(word)
            if digest is None:
                digest = known[word] = hashlib.blake2b(word, digest_size=8).digest()
            found.append(digest)
        out[long] = np.frombuffer(b"".join(found), "<u8")
    return out


class Vocabulary:
    """A bounded list of words that are found among others in byte buffers: looked up by a hash of all their bytes and
    confirmed on the bytes themselves, so that no other word is ever taken for one of them."""

    def __init__(self, known: list[bytes]):
        self.words = sorted({w for w in known if w})
        data = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.longest = max(self.sizes.tolist(), default=0)
        self.loads = list(self._loads(data, ends - self.sizes, self.sizes))
        hashes = self._hashes(self.loads, self.sizes)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # Words that share a hash (never seen) stand side by side and are all tried.
        self.tries = max(np.unique(hashes, return_counts=True)[1].tolist(), default=0)

    def __len__(self) -> int:
        return len(self.words)

    def _loads(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Bytes 0 to 7 of each word, 8 to 15 and so on as integers, zeros after its end."""
        reach = -(-self.longest // 8) * 8
        padded = np.concatenate([data, np.zeros(reach + 8, np.uint8)])
        whole = np.ndarray(len(data) + reach + 1, np.uint64, padded.data, strides=(1,))
        for at in range(0, reach, 8):
            yield whole[starts + at] & _KEEP[np.clip(sizes - at, 0, 8)]

    @staticmethod
    def _hashes(loads: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        out = sizes.astype(np.uint64)
        for k, load in enumerate(loads):
            if k:
                long = np.flatnonzero(sizes > 8 * k)
                out[long] = mix64(out[long] + load[long])
            else:
                out = mix64(out + load * np.uint64(0x9E3779B97F4A7C15))
        return out

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its place in ``words``, -1 if it isn't there."""
        sizes = ends - starts
        out = np.full(len(starts), -1, np.int64)
        may = np.flatnonzero(sizes <= self.longest)
        if not len(may) or not len(self):
            return out
        sizes = sizes[may]
        loads = list(self._loads(data, starts[may], sizes))
        hashes = self._hashes(loads, sizes)
        at = np.searchsorted(self.hashes, hashes)
        for k in range(self.tries):
            place = np.minimum(at + k, len(self) - 1)
            word = self.order[place]
            same = (self.hashes[place] == hashes) & (self.sizes[word] == sizes)
            for mine, theirs in zip(self.loads, loads, strict=True):
                same &= mine[word] == theirs
            out[may[same]] = word[same]
        return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values, over row borders too; the caller drops those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= _MULT
        out += hashes[j : n + j]
    return mix64(out)


class IdFilter:
    """Tells which ids are surely not among those of ``df``'s ``column``, before texts are shuffled to meet them.

    It holds one bit for each of 2**BITS hash values, so its size (1 MB) is fixed whatever the input; it lets false
    positives through and an exact join must follow.
    """

    BITS = 23

    def __init__(self, df: DataFrame, column: str):
        rows = (
            df.select(self.slot(F.col(column)).alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(slot, 64) as int)))").alias("bits"))
            .toPandas()
        )
        table = np.zeros(1 << (self.BITS - 6), np.int64)
        table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self.held = df.sparkSession.sparkContext.broadcast(table)

    def slot(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << self.BITS))

    def hits(self, slots: np.ndarray) -> np.ndarray:
        bits = self.held.value[slots >> 6].view(np.uint64) >> (slots & 63).astype(np.uint64)
        return bits & np.uint64(1) == 1

    def __call__(self, column: Column) -> Column:
        """A boolean column: may the id be among them."""

        @F.arrow_udf("boolean")
        def among(slots: pa.Array) -> pa.Array:
            return pa.array(self.hits(slots.to_numpy(zero_copy_only=False).astype(np.int64)))

        return among(self.slot(column))


def distinct_ids_filter(df: DataFrame, column: str) -> IdFilter:
    return IdFilter(df, column)


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id isn't among ``ids``' (a null id never is). Only rows that may be are shuffled."""
    may = F.coalesce(distinct_ids_filter(ids, column)(F.col(column)), F.lit(False)) & F.col(column).isNotNull()
    return df.where(~may).unionByName(df.where(may).join(ids.select(column).distinct(), column, "left_anti"))


def in_chunks(function, texts: pa.Array, most: int) -> np.ndarray:
    """``function`` over lists of texts with about ``most`` bytes each, the results joined."""
    rows = chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), most=most)
    return np.concatenate([np.zeros(0), *[function(part.column(0).to_pylist()) for part in rows]])
