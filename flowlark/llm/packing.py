"""Packing documents into token windows by lexical retrieval.

Documents are cut where they fill whole windows; what is left of each, its tail, is packed. Tails are dealt to shards of
a range of lexical sketches, so that alike tails meet and copies of one text, however many, spread over as many shards as
their length asks for: a task goes through its sorted range and ends a shard whenever it holds SHARD_TOKENS. Each shard is
an inverted index with BM25 scores over the words of its tails; document frequencies and mean lengths are the shard's. A seed takes
its nearest unused neighbours, best first, until its window is full; the last one taken is cut, and its rest stays in the index.
The last window of a shard is cut into pieces of powers of two, which need no padding.

Texts are encoded once; tails are stored as ids, so a lost executor costs no second encoding.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, stored
from .tokens import rank_encoding, rank_ids

WINDOW = 2048
#: Tokens that a shard's index should hold.
SHARD_TOKENS = 1 << 19
#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Words in more than this share of a shard's tails are scored from rows of weights of all tails, others from lists of
#: those that hold them. Both give the same scores; rows are the faster for words that many tails hold.
COMMON = 0.1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TAILS = PIECES + ", sketch long, tail binary"


@functools.cache
def _word_starts(path: str) -> np.ndarray:
    """For each id: does its token begin a word, that is with a space or line break, or stand alone."""
    enc = rank_encoding(path)
    out = np.ones(enc.n_vocab + 1, bool)
    for i in range(enc.n_vocab):
        try:
            first = enc.decode_single_token_bytes(i)[:1]
        except KeyError:
            continue
        out[i] = first in (b" ", b"\n", b"\t", b"\r") or not (first.isalnum() or first >= b"\x80")
    return out


def word_terms(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each word of a token sequence; a word is a run of tokens up to the next that begins one."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    first = begins[ids]
    first[0] = True
    at = np.flatnonzero(first)
    place = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    return mix64(np.add.reduceat(mix64(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), at))


def _sketch(terms: np.ndarray) -> int:
    """Alike sets of words tend to have the same least hash; its order sorts alike tails together."""
    return int(terms.min().view(np.int64)) if len(terms) else 0


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Index:
    """BM25 over a shard's tails: for each word the tails that hold it, with their weights."""

    def __init__(self, terms: list[np.ndarray]):
        lengths = np.array([len(t) for t in terms], float)
        doc = np.repeat(np.arange(len(terms)), lengths.astype(int))
        words, word = np.unique(np.concatenate(terms), return_inverse=True)
        pair, count = np.unique(word * len(terms) + doc, return_counts=True)
        word, doc = pair // len(terms), pair % len(terms)
        held = np.bincount(word, minlength=len(words))
        idf = np.log1p((len(terms) - held + 0.5) / (held + 0.5))
        scale = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        self.weight = (idf[word] * count * (K1 + 1) / (count + scale[doc])).astype(np.float32)
        self.doc, self.n = doc, len(terms)
        self.first = np.append(0, np.cumsum(held))
        common = held > max(32, COMMON * len(terms))
        # Each word in a row has more than COMMON of the tails, so all rows hold less than 1 / COMMON of what the lists would.
        row = np.cumsum(common) - 1
        self.rows = np.zeros((int(common.sum()), len(terms)), np.float32)
        dense = common[word]
        self.rows[row[word[dense]], doc[dense]] = self.weight[dense]
        # The query words of each tail: those that another tail holds too; in lists, and in rows.
        own = np.flatnonzero((held > 1)[word] & ~dense)
        order = own[np.argsort(doc[own], kind="stable")]
        self.asks = word[order]
        self.asks_first = np.searchsorted(doc[order], np.arange(len(terms) + 1))
        order = np.flatnonzero(dense)
        order = order[np.argsort(doc[order], kind="stable")]
        self.asks_rows = row[word[order]]
        self.rows_first = np.searchsorted(doc[order], np.arange(len(terms) + 1))

    def scores(self, seed: int) -> np.ndarray:
        words = self.asks[self.asks_first[seed] : self.asks_first[seed + 1]]
        a, n = self.first[words], self.first[words + 1] - self.first[words]
        where = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.bincount(self.doc[where], self.weight[where], minlength=self.n)
        asked = self.asks_rows[self.rows_first[seed] : self.rows_first[seed + 1]]
        if len(asked):
            chosen = np.zeros(len(self.rows), np.float32)
            chosen[asked] = 1
            out = out + chosen @ self.rows
        return out


def _follow(index: Index, left: np.ndarray, seed: int):
    """The seed, its neighbours with unused tokens by falling score, and then whatever comes after the seed."""
    yield seed
    score = index.scores(seed)
    near = np.flatnonzero((score > 0) & (left > 0))
    yield from near[np.argsort(-score[near], kind="stable")].tolist()
    yield from range(seed, len(left))


def pack_shard(lengths: np.ndarray, terms: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (tail, start in it, length, sequence, offset) that cover each tail once; sequences count from 0.

    Seeds come in the order given. What is left when no window can be filled is cut into sequences of powers of two.
    """
    index, left, seed = Index(terms), lengths.astype(np.int64).copy(), 0
    out: list[tuple[int, int, int, int, int]] = []
    total = int(left.sum())
    rest = total % window
    sizes = [window] * (total // window) + [1 << b for b in range(rest.bit_length(), -1, -1) if rest >> b & 1]
    for sequence, size in enumerate(sizes):
        while not left[seed]:
            seed += 1
        filled = 0
        for k in _follow(index, left, seed):
            take = min(int(left[k]), size - filled)
            if take:
                out.append((k, int(lengths[k] - left[k]), take, sequence, filled))
                left[k] -= take
                filled += take
            if filled == size:
                break
    return out


def pack(df: DataFrame, ranks: str, tokenizer: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own, each with its own
    starts. A null id stays null. A very long text is a run of whole windows and one tail; it is encoded as a chunk of its
    own. Tails that tie in score are taken in the order of their sketch and id. An empty table gives no rows; other columns
    are not read.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        begins = _word_starts(ranks)
        names = [x.split()[0] for x in _TAILS.split(", ")]
        for part in chunks(batches, most=1 << 19):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(rank_ids(ranks, tokenizer, text), np.uint32(end_id))
                whole = len(ids) - len(ids) % WINDOW
                for at in range(0, whole, WINDOW):
                    rows.append((doc, at, WINDOW, _crc(ids[at : at + WINDOW]), len(ids), sequence, 0, None, None))
                    sequence += 1
                if whole < len(ids):
                    tail = ids[whole:]
                    rows.append((doc, whole, len(tail), None, len(ids), None, None, _sketch(word_terms(tail, begins)), tail.astype(np.uint16 if tail.max() < 1 << 16 else np.uint32).tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], names)

    pieces = stored(src.mapInArrow(cut, _TAILS), "pieces")
    tails = pieces.where("tail is not null").select("doc_id", "start", "doc_tokens", "sketch", "length", "tail")
    total = tails.agg(F.sum("length")).first()[0] or 0

    def fill(batches):
        """Packs the sorted tails shard by shard, so that a partition of any size is held one shard at a time."""
        from pyspark import TaskContext

        begins, sequence = _word_starts(ranks), TaskContext.get().partitionId() << 33 | 1 << 32
        held, tokens = [], 0
        for batch in itertools.chain(_small(batches), [None]):
            if batch is not None:
                held.append(batch)
                tokens += int(batch.column("length").to_numpy().sum())
            if held and (batch is None or tokens >= SHARD_TOKENS):
                table = pa.Table.from_batches(held)
                held, tokens = [], 0
                done, n = packed_shard(table, begins, sequence)
                sequence += n
                yield from done.to_batches(max_chunksize=8192)

    def packed_shard(table: pa.Table, begins: np.ndarray, base: int) -> tuple[pa.Table, int]:
        lengths = table.column("length").to_numpy()
        ids = [np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32).astype(np.uint32) for x, n in zip(table.column("tail").to_pylist(), lengths.tolist(), strict=True)]
        got = pack_shard(lengths, [word_terms(x, begins) for x in ids])
        k, at, n, sequence, offset = (np.array(x, np.int64) for x in zip(*got, strict=True))
        crc = [_crc(ids[a][b : b + c]) for a, b, c in zip(k.tolist(), at.tolist(), n.tolist(), strict=True)]
        of = pa.array(k)
        start = table.column("start").to_numpy()[k] + at
        columns = {"doc_id": table.column("doc_id").take(of), "start": start, "length": n, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": table.column("doc_tokens").take(of), "sequence_id": base + sequence, "offset": offset}
        return pa.table(columns), int(sequence.max()) + 1

    # Shards are cut from sorted partitions, whose number is the session's; a small table has one for each shard.
    shards = max(1, -(-total // SHARD_TOKENS))
    partitions = int(min(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    packed = tails.repartitionByRange(partitions, "sketch", "doc_id", "start").sortWithinPartitions("sketch", "doc_id", "start").mapInArrow(fill, PIECES)
    return pieces.where("tail is null").drop("sketch", "tail").unionByName(packed)


def _small(batches):
    """The batches in slices of few rows, so that a shard ends soon after it is full."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield batch.slice(at, 64)
