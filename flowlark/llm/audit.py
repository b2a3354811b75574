"""Filter interaction audit: what each filter of a list removes, for every order in which the list may be applied.

One pass scans the texts in Arrow buffers: byte classes and their prefix sums count words, capitals and symbols, and each
document's sorted word hashes, confirmed on the bytes, give its distinct words. What leaves that pass is a narrow row: an
id, a part, a digest of the text, and a mask with one bit for each filter that it fails. Nothing else about an order
matters: the audit is a sum over the masks' counts in each part, 2^k numbers for k filters, whatever the documents' number.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, utf8, word_hashes, words

#: Set for a document whose text a smaller id has too; not a statistic of the text alone.
COPY = "earlier_copy"
#: A letter for each filter, and when a document fails it: a condition on the statistics, or COPY.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
    "E": COPY,
}
STATISTICS = "n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long, digest binary"

_CAPITAL, _SYMBOL, _LEAD = (np.zeros(256, np.int64) for _ in range(3))
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_SYMBOL[list(b"#$%&*|")] = 1
#: The first byte of each code point: all but those of the form 10xxxxxx.
_LEAD[[b for b in range(256) if b >> 6 != 2]] = 1
#: Words of up to so many bytes are compared 8 bytes at a time, all at once.
_SHORT = 64


def _counts(data: np.ndarray, offsets: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The rows' sums of their bytes' worths, as differences of one prefix sum."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(worth[data], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _equal(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are the words ``a`` and ``b`` the same bytes, pair by pair."""
    same = sizes[a] == sizes[b]
    padded = np.concatenate([data, np.zeros(_SHORT + 8, np.uint8)])
    loads = np.ndarray(len(data) + _SHORT + 1, np.uint64, padded.data, strides=(1,))
    short = np.flatnonzero(same & (sizes[a] <= _SHORT))
    for at in range(0, _SHORT, 8):
        short = short[sizes[a[short]] > at]
        if not len(short):
            break
        spare = (8 * np.maximum(0, at + 8 - sizes[a[short]])).astype(np.uint64)
        same[short] &= (loads[starts[a[short]] + at] ^ loads[starts[b[short]] + at]) << spare == 0
    for k in np.flatnonzero(same & (sizes[a] > _SHORT)).tolist():
        n, p, q = sizes[a[k]], starts[a[k]], starts[b[k]]
        same[k] = data[p : p + n].tobytes() == data[q : q + n].tobytes()
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different words each row has. Neighbours in the order of (row, hash) count as one word where their bytes
    agree; a row where equal keys hide different words is counted word by word."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    bits = max(1, len(n).bit_length())
    key = row.astype(np.uint64) << np.uint64(64 - bits) | word_hashes(data, starts, ends) >> np.uint64(bits)
    order = np.argsort(key)
    key = key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[twin], order[twin + 1]
    out = n - np.bincount(row[a], minlength=len(n))
    for k in np.unique(row[a[~_equal(data, starts, ends - starts, a, b)]]).tolist():
        mine = slice(first[k], first[k + 1])
        out[k] = len({data[p:q].tobytes() for p, q in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)})
    return out


def statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of the texts, each read whole. Null is empty: no words, and the digest of
    the empty text. Repeated rows are counted each; an empty table gives an empty one. Columns of ``keep`` that are named
    like a statistic are left out."""
    kept = [c for c in keep if c not in {x.split()[0] for x in STATISTICS.split(", ")}]
    rows = df.select(*kept, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], STATISTICS])

    def scan(batches):
        for batch in chunks(batches, "_text"):
            data, offsets = utf8(batch.column(len(kept)))
            starts, ends, first = words(data, offsets)
            view, cut = memoryview(data), offsets.tolist()
            made = [
                np.diff(first), distinct_words(data, starts, ends, first),
                *(_counts(data, offsets, worth) for worth in (_CAPITAL, _SYMBOL, _LEAD)),
            ]
            digests = [hashlib.sha256(view[p:q]).digest() for p, q in zip(cut[:-1], cut[1:], strict=True)]
            columns = [*batch.columns[:-1], *map(pa.array, made), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *(x.split()[0] for x in STATISTICS.split(", "))])

    return rows.mapInArrow(scan, schema)


def failures(df: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, part and mask of each document: bit k is set if it fails the filter at place k.

    A text is a copy if the same text has a smaller id anywhere in the table; equal ids are no copies of each other, a
    document without an id is never one and makes no other one. Texts are the same if their 256-bit digests are.
    """
    bit = {letter: 1 << k for k, letter in enumerate(filters)}
    failed = sum((F.when(F.expr(rule), bit[x]).otherwise(0) for x, rule in filters.items() if rule != COPY), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = stored(statistics(rows, ["id", "part"]).select("id", "part", "digest", failed.cast("int").alias("mask")), "audit")
    # Copies meet in partial minima first; the join's large side is split where one text has very many rows.
    copies = rows.groupBy("digest").agg(F.min("id").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copy = sum((F.lit(bit[x]) for x, rule in filters.items() if rule == COPY), F.lit(0))
    late = F.when(F.col("id") > F.col("earliest"), copy).otherwise(0)
    return rows.join(copies, "digest", "left").select("id", "part", (F.col("mask") + late).alias("mask"))


def interactions(masks: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: what the step's filter removes, and what it would have removed.

    ``masks``: part, mask, and the booleans good and toxic of each document. Each part is first summed up to three arrays
    with a number for each mask, with partial sums before the shuffle; orders are products with 0-1 matrices over the masks.
    """
    letters, size = list(filters), 1 << len(filters)
    counted = [F.array(*[F.count(F.when((F.col("mask") == m) & which, 1)) for m in range(size)]).alias(name) for name, which in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    cells = masks.groupBy("part").agg(*counted)
    orders = list(permutations(range(len(letters))))
    own = 1 << np.array(orders).reshape(-1)
    before = np.array([sum(1 << x for x in order[:k]) for order in orders for k in range(len(letters))])
    mask = np.arange(size)[:, None]
    fails, earlier = mask & own != 0, mask & before != 0
    names = np.repeat(["".join(letters[x] for x in order) for order in orders], len(letters)).tolist()
    steps = np.tile(np.arange(1, len(letters) + 1), len(orders)).astype(np.int32)
    among = [kept, removed, redundant, alone] = [x.astype(np.int64) for x in (~fails & ~earlier, fails & ~earlier, fails & earlier, mask == own)]
    same = (own[:, None] == own[None, :]).astype(np.int64)

    def expand(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, good, toxic = (np.array(row[c], np.int64) for c in ("n", "good", "toxic"))
                sums = [*(n @ m for m in among), good @ removed, toxic @ removed, (n @ removed) @ same]
                columns = [pa.array([row["part"]] * len(names)), pa.array(names), pa.array(steps), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells.mapInArrow(expand, schema)


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """The interactions of the filters in each part of ``df``; ``labels`` (id, quality, toxic) say what losses are bad.

    Null texts are empty, very long ones are scanned whole; a null part is the part ''. An id that is labelled more than
    once counts as good or toxic if any label says so; a null label, or none, says neither. Repeated rows count each. An
    empty table gives no rows, an empty table of labels no losses. Other columns of either table are not read.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failures(df, filters, id_col, part_col, text_col).join(known, "id", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return interactions(rows.select("part", "mask", said("good"), said("toxic")), filters)
