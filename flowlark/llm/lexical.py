"""Ranked lexical search with a bit-sliced impact index.

A posting's impact is the integer that its term adds to its document's score. Documents are dealt to blocks of ``BLOCK``; in
a block a term has one bitmap of the documents for each bit of its impacts. The scores of all items of a block of queries
are those bitmaps added up, one term of each item at a time, by a ripple of bitwise ANDs and XORs: a score is never an
integer of its own but a column of bits. Going down the sums from their most significant bit splits the documents into
those surely among the best, those tied so far and those that are out, until k are left.

Texts are read once for each block of queries; it stores each document's counts of the queried terms, from which Spark sums
up the corpus' statistics. The search then needs no shuffle but that of k rows for each item and task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, Vocabulary, chunks, stored, utf8, words

#: A term is a run of the bytes of ASCII letters and digits and of all other code points, with A-Z lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Documents of a block, a multiple of 64; fewer where one item has more than TERMS terms.
BLOCK = 4096
#: Items and different terms of a block of queries, at most (one item's terms alone may be more); all blocks are run.
ITEMS, TERMS = 256, 8192
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER.tobytes()))


def counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (the text's terms), and how often each term of the vocabulary occurs in it. Texts without a term, null ones
    too, give no row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most TERMS words, or one item's

    def run(batches):
        known = held.value
        for batch in chunks(batches):
            data, offsets = utf8(batch.column(1))
            data = LOWER[data]
            starts, ends, first = words(data, offsets, _TERM)
            n = np.diff(first)
            found = known.find(data, starts, ends)
            hit = np.flatnonzero(found >= 0)
            key, times = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(known) + found[hit], return_counts=True)
            at = np.searchsorted(key, np.arange(len(n) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (key % max(1, len(known)), times)]
            whole = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield whole.filter(pa.array(n > 0))

    return rows.mapInArrow(run, _COUNTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score each time that an item has it."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def slices(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_words: int) -> np.ndarray:
    """The index of one block: bitmaps [bit of the impact, term, 64 documents]. Postings come in the order of (term, doc);
    the last bitmap of each bit is empty and stands for no term."""
    depth = max(1, int(impact.max(initial=0)).bit_length())
    out = np.zeros((depth, n_terms + 1, n_words), np.uint64)
    place, bit = term * n_words + (doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64)
    for s in range(depth):
        on = np.flatnonzero(impact >> s & 1)
        if len(on):
            heads = np.flatnonzero(np.diff(place[on], prepend=-1))
            out[s].reshape(-1)[place[on][heads]] = np.bitwise_or.reduceat(bit[on], heads)
    return out


def add_up(index: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """The sums [bit, item, 64 documents] of the items' terms: ``rounds`` has one row of terms for each round, one a item."""
    depth = len(index) + max(1, len(rounds)).bit_length()
    sums = np.zeros((depth, rounds.shape[1], index.shape[2]), np.uint64)
    for terms in rounds:
        carry = None
        for s in range(depth):
            a = sums[s]
            if s < len(index):
                b = index[s][terms]
                x = a ^ b
                sums[s], carry = (x, a & b) if carry is None else (x ^ carry, (a & b) | (carry & x))
            else:
                sums[s], carry = a ^ carry, a & carry
                if not carry.any():
                    break
    return sums


def best(sums: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` documents with the highest sums above 0 for each item, as bitmaps; of equal sums the first ones stay."""
    size = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None]
    sure, tied = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums, axis=0)
    few = size(tied) <= k
    sure |= np.where(few, tied, 0)
    tied &= np.where(few, np.uint64(0), ~np.uint64(0))
    for s in range(len(sums) - 1, -1, -1):
        high = tied & sums[s]
        n = size(sure) + size(high)
        # More than k are high: only these are still tied. At most k: they are sure, and the rest is tied for what is left.
        sure = np.where(n <= k, sure | high, sure)
        tied = np.where(n > k, high, np.where(n < k, tied & ~high, np.uint64(0)))
    for item in np.flatnonzero(tied.any(axis=1)).tolist():
        left = k - int(size(sure[item : item + 1])[0, 0])
        at = np.flatnonzero(np.unpackbits(tied[item].view(np.uint8), bitorder="little"))[:left]
        np.bitwise_or.at(sure[item], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return sure


def _blocks_of_items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms in blocks of bounded size, read one after the other."""
    block, known = [], set()
    for row in items.select(id_col, text_col).distinct().toLocalIterator():
        terms = terms_of(row[1])
        if not terms:
            continue
        if block and (len(block) == ITEMS or len(known | set(terms)) > TERMS):
            yield block
            block, known = [], set()
        block.append((row[0], terms))
        known |= set(terms)
    if block:
        yield block


def _search_block(docs: DataFrame, items: list[tuple[object, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary([t for _, terms in items for t in terms])
    found = stored(counts(docs, vocabulary, id_col, text_col), "term-counts")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most len(vocabulary) rows
        weights[term] = weight(n_docs, df)
    place = {w: i for i, w in enumerate(vocabulary.words)}
    rounds = np.full((max(len(terms) for _, terms in items), len(items)), len(vocabulary))
    for j, (_, terms) in enumerate(items):
        rounds[: len(terms), j] = [place[t] for t in terms]
    held = spark.sparkContext.broadcast((weights, rounds))

    def run(batches):
        weights, rounds = held.value
        size = max(64, BLOCK * TERMS // max(TERMS, len(weights)) // 64 * 64)
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                # Of equal scores the smaller id comes first, and a missing one last.
                order = np.argsort(part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                each = np.diff(part.column(2).offsets.to_numpy())
                doc, n = np.repeat(rank, each), np.repeat(part.column(1).to_numpy(), each)
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                ordered = np.lexsort((doc, term))
                here, row = np.unique(term[ordered], return_inverse=True)
                row_of = np.full(len(weights) + 1, len(here))
                row_of[here] = np.arange(len(here))
                impact = impacts(weights[term], tf, n, n_docs, n_terms)[ordered]
                index = slices(row, doc[ordered], impact, len(here), -(-part.num_rows // 64))
                sums = add_up(index, row_of[rounds])
                chosen = best(sums, k)
                item, bit = np.nonzero(np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little"))
                score = np.zeros(len(item), np.int64)
                for s in range(len(sums)):
                    score |= (sums[s][item, bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << s
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.take(pa.array(at + order[bit])), pa.array(score)], ["item", "doc_id", "score"])

    found = found.mapInArrow(run, "item int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = F.array(*[F.lit(i) for i, _ in items])
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item_id, rank (from 1), doc_id, score.

    Null and empty texts have no terms: as documents they don't count, as items they find nothing. Very long texts are
    read whole. Repeated rows of ``docs`` are documents of their own, ties go to the smaller id and a missing id comes last;
    repeated rows of ``items`` are one item, and one id with several texts is ranked for each. Empty tables give no rows.
    Other columns are not read.
    """
    kind = dict(items.dtypes)[item_col]
    out = None
    for block in _blocks_of_items(items, item_col, text_col):
        found = _search_block(docs, block, k, id_col, text_col)
        found = found.withColumn("item_id", F.col("item_id").cast(kind))
        out = found if out is None else stored(out, "ranked").unionByName(found)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
