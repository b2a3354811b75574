"""Repeated passages by prefix-partitioned suffix trees.

A suffix is the text from one word on, cut at ``width`` words. Its path in the tree has three labels: hashes of its first
quarter, its second quarter and its second half. Only suffixes that may occur twice get into trees: every window of
``width`` words holds the same least quarter-length gram wherever it occurs, so a window whose least gram is found once in
the whole corpus is unique. Those least grams, about two in w + 1, are counted over all documents.

Suffixes are dealt to subtrees by the shortest prefix of their path - one, two or three labels - that isn't heavy; a
prefix is heavy if it would fill more than a quarter of a partition, so a common beginning is split by what follows it. A
whole path that is heavy (one very common window) is split by its documents: each part sends on its earliest suffix alone,
few rows in all, and the earliest of these is the path's.
Each subtree is its suffixes in sorted order: neighbours with the same path hang below one internal node of depth
``width`` or more, whose earliest suffix stays and whose others repeat it. Spark sorts the partitions on disk if need be, and
they are read as a stream, so a subtree need not fit into memory. Repeated windows that overlap in a document
are joined into maximal runs.

A document with the same words as an earlier one is one run, and takes no further part. Within a chunk of
documents, only the earliest suffix of a path is sent to the trees; the others are known to be repeats.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, distinct_ids_filter, mix64, stored, utf8, window_hashes, word_hashes, words

#: One suffix in so many is sampled to find the heavy prefixes.
SAMPLED = 64
_RUNS = "doc_id long, runs array<struct<start:int,n:int>>"


class Chunk:
    """The words of a chunk of texts, the hashes of their quarter-length grams, and each window's least gram."""

    def __init__(self, column: pa.Array, width: int):
        self.data, offsets = utf8(column)
        self.starts, self.ends, self.first = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.width, self.gram = width, width // 4
        self.grams = window_hashes(self.hashes, self.gram)
        self.least = _sliding_min(self.grams, width - self.gram + 1)

    def span(self, row: int) -> tuple[int, int]:
        return int(self.first[row]), int(self.first[row + 1])

    def windows(self, row: int) -> slice:
        """Where the row's windows start; words, grams and windows are numbered alike."""
        a, b = self.span(row)
        return slice(a, max(a, b - self.width + 1))

    def paths(self, at: np.ndarray) -> np.ndarray:
        """The three labels of the suffixes that start at the words ``at``."""
        g, k = self.grams, self.gram
        return np.stack([g[at], g[at + k], mix64(g[at + 2 * k] * np.uint64(0x9E3779B97F4A7C15) + g[at + 3 * k])])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) < n:
        return x[:0]
    size, m = 1, x
    while 2 * size <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - n + 1], m[n - size :][: len(x) - n + 1])


def _prefixes(paths: np.ndarray) -> np.ndarray:
    """A hash of the first label, of the first two, and of all three."""
    one = paths[0]
    two = mix64(one * np.uint64(0xD6E8FEB86659FD93) + paths[1])
    return np.stack([one, two, mix64(two * np.uint64(0xD6E8FEB86659FD93) + paths[2])])


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, seq_key (of texts with a window: a digest of all words), least (the distinct least grams, twice
    if the text holds the gram twice), sampled (prefix hashes of sampled suffixes, three for each)."""

    def run(batches):
        for part in chunks(batches):
            c = Chunk(part.column("text"), width)
            keys, least, sampled = [], [], []
            for row in range(part.num_rows):
                a, b = c.span(row)
                if b - a < width:
                    keys.append(None)
                    least.append(np.zeros(0, np.uint64))
                    sampled.append(np.zeros(0, np.uint64))
                    continue
                key = hashlib.blake2b(c.hashes[a:b].tobytes(), digest_size=16).digest()
                own, n = np.unique(c.grams[a : b - c.gram + 1], return_counts=True)
                mine = np.unique(c.least[c.windows(row)])
                keys.append(key)
                least.append(np.concatenate([mine, mine[n[np.searchsorted(own, mine)] > 1]]))
                at = np.arange(a + key[0] % SAMPLED, b - width + 1, SAMPLED)
                sampled.append(_prefixes(c.paths(at)).T.ravel())
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in x])), pa.int32()), pa.array(np.concatenate(x).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(c.first)), pa.array(keys, pa.binary()), lists(least), lists(sampled)], ["doc_id", "n_words", "seq_key", "least", "sampled"]
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, seq_key binary, least array<long>, sampled array<long>")


def _heavy(survey: DataFrame, sent: int, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes with more than 1 / (4 * partitions) of what is about to be sent, and how many quarters of a partition each
    would fill. ``sent``: about how many suffixes that is; it counts as a sixteenth of all at least, so that prefixes are
    192 * partitions at most."""
    counts = survey.select(F.explode("sampled").alias("prefix")).groupBy("prefix").count()
    every = (survey.agg(F.sum(F.size("sampled"))).first()[0] or 0) / 3
    share = max(sent / SAMPLED, every / 16) / (4 * partitions)
    rows = counts.where(F.col("count") > max(32.0, share)).toPandas()
    prefix, parts = rows["prefix"].to_numpy(np.int64).view(np.uint64), np.ceil(rows["count"].to_numpy(float) / max(share, 1.0)).astype(np.int64)
    order = np.argsort(prefix)
    return prefix[order], parts[order]


def _runs_of(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans [at, at + n) of a document joined; spans come sorted by (doc, at)."""
    if not len(doc):
        return doc, at, n
    base = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int((at + n).max()) + 2)
    reach = np.maximum.accumulate(base + at + n)
    new = np.flatnonzero(np.append(True, base[1:] + at[1:] > reach[:-1]))
    return doc[new], at[new], reach[np.append(new[1:] - 1, len(doc) - 1)] - base[new] - at[new]


def repeated_runs(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, runs) of the documents (doc_id, text) with repeats: runs are disjoint spans of words (start, n), in order,
    that cover just the words of windows of ``width`` words whose sequence also starts earlier: in a smaller doc_id, or
    in the same document before. ``width`` is a multiple of 4.

    Texts without a window (null and empty ones too) have no repeats. Rows without an id don't count as occurrences and
    have no runs. Rows that repeat an id are taken as one document where their texts agree, and get each other's runs
    where they don't. Very long texts are searched whole; an empty table gives no rows; other columns are not read.
    """
    if width < 4 or width % 4:
        raise ValueError("width must be a multiple of 4")
    docs = docs.where("doc_id is not null and text is not null")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    survey = stored(_survey(docs.select("doc_id", "text"), width).where("seq_key is not null"), "survey")
    classes = stored(survey.groupBy("seq_key").agg(F.min("doc_id").alias("rep"), F.min_by("least", "doc_id").alias("least"), F.count("*").alias("n")), "classes")
    copies = survey.select("doc_id", "n_words", "seq_key").join(classes.where("n > 1").select("seq_key", "rep"), "seq_key").where("doc_id > rep")
    copied = copies.select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("n"))).alias("runs"))

    grams = classes.select(F.col("rep").alias("doc_id"), F.explode("least").alias("gram"))
    twice = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    once = classes.select(F.col("rep").alias("doc_id"), F.explode(F.array_distinct("least")).alias("gram"))
    found = once.where(distinct_ids_filter(twice, "gram")(F.col("gram"))).join(twice, "gram")
    wanted = stored(found.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")), "candidates")
    # A gram is the least one of half of the windows that hold it, about.
    sent = (wanted.agg(F.sum(F.size("grams"))).first()[0] or 0) * (width - width // 4 + 2) // 2
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(survey, sent, partitions))

    def suffixes(batches):
        for part in chunks(batches, most=1 << 18):
            c = Chunk(part.column("text"), width)
            grams_of = part.column("grams")
            flat, cut = grams_of.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(np.diff(grams_of.offsets.to_numpy())))
            at, of = [], []
            for row in range(part.num_rows):
                w = c.windows(row)
                hit = w.start + np.flatnonzero(np.isin(c.least[w], flat[cut[row] : cut[row + 1]]))
                at.append(hit)
                of.append(np.full(len(hit), row))
            at, of = np.concatenate(at), np.concatenate(of)
            doc, pos = part.column("doc_id").to_numpy()[of], at - c.first[of]
            paths = c.paths(at)
            prefix = _prefixes(paths)
            order = np.lexsort((pos, doc, prefix[2]))
            doc, pos, paths, prefix = doc[order], pos[order], paths[:, order], prefix[:, order]
            first, repeat = _repeats(paths, doc, pos)
            common, parts = heavy.value
            depth = np.where(np.isin(prefix[0], common), np.where(np.isin(prefix[1], common), 3, 2), 1)[first]
            place = np.minimum(np.searchsorted(common, prefix[2][first]), max(0, len(common) - 1))
            hot = common[place] == prefix[2][first] if len(common) else np.zeros(len(first), bool)
            # A hot path's suffixes name the part of their documents, from 1 on; other suffixes have none.
            part_of = np.zeros(len(first), np.int64)
            part_of[hot] = 1 + (mix64(doc[first][hot].astype(np.uint64)) % parts[place[hot]].astype(np.uint64)).astype(np.int64)
            depth[hot] = 3
            own = np.lexsort((pos[repeat], doc[repeat]))
            rd, rp, rn = _runs_of(doc[repeat][own], pos[repeat][own], np.full(len(own), width))
            zero = np.zeros(len(rd), np.int64)
            label = lambda k: np.append(paths[k][first].view(np.int64), rd if k == 0 else zero)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (label(0), label(1), label(2), np.append(doc[first], rd), np.append(pos[first] << 32 | part_of << 2 | depth, rp << 32 | rn << 2))],
                ["s1", "s2", "s3", "doc_id", "at"],
            )

    def subtrees(batches):
        """Reads sorted suffixes; passes on the runs that were known before (those without a depth), and with its path the
        earliest suffix of a hot path's part."""
        last = None
        for batch in batches:
            s, doc, at = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(3)]), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            known, pos, n = at & 3 == 0, at >> 32, at >> 2 & ((1 << 30) - 1)
            out, open_ = [(doc[known], pos[known], n[known])], np.zeros(0, np.int64)
            s, doc, pos, hot = s[:, ~known], doc[~known], pos[~known], n[~known] > 0
            if last is not None:
                hot = np.append(False, hot)  # it was passed on with its own batch
                s, doc, pos = np.concatenate([last[0], s], axis=1), np.append(last[1], doc), np.append(last[2], pos)
            if len(doc):
                first, repeat = _repeats(s, doc, pos)
                last = s[:, first[-1:]], doc[first[-1:]], pos[first[-1:]]
                out.append((doc[repeat], pos[repeat], np.full(int(repeat.sum()), width)))
                open_ = first[hot[first]]
                out.append((doc[open_], pos[open_], np.full(len(open_), width)))
            d, p, k = (np.concatenate(x) for x in zip(*out, strict=True))
            paths = [pa.concat_arrays([pa.nulls(len(d) - len(open_), pa.int64()), pa.array(s[j][open_].view(np.int64))]) for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), *paths], ["doc_id", "start", "n", "s1", "s2", "s3"])

    def joined(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.append(a, batch.column(k).to_numpy().astype(np.int64)) for k, a in enumerate(held)]
            doc, start, n = held
            if not len(doc):
                continue
            # The last document may go on in the next batch.
            cut = len(doc) if batch is None else int(np.searchsorted(doc, doc[-1]))
            held = [x[cut:] for x in held]
            doc, start, n = _runs_of(doc[:cut], start[:cut], n[:cut])
            names, first = np.unique(doc, return_index=True)
            runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["start", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), runs)], ["doc_id", "runs"])

    texts = docs.select("doc_id", "text").where(distinct_ids_filter(wanted, "doc_id")(F.col("doc_id"))).join(wanted, "doc_id")
    sent = texts.mapInArrow(suffixes, "s1 long, s2 long, s3 long, doc_id long, at long")
    depth, part_of = F.col("at").bitwiseAND(F.lit(3)), F.shiftright("at", 2).bitwiseAND(F.lit((1 << 30) - 1))
    subtree = F.when(depth <= 1, F.col("s1")).when(depth == 2, F.xxhash64("s1", "s2")).otherwise(F.xxhash64("s1", "s2", "s3", part_of))
    trees = sent.repartition(partitions, subtree).sortWithinPartitions("s1", "s2", "s3", "doc_id", "at").mapInArrow(subtrees, "doc_id long, start int, n int, s1 long, s2 long, s3 long")
    trees = stored(trees, "repeated-windows")
    # The parts' earliest suffixes, few for each partition: all but the earliest of a path are repeats.
    place = F.rank().over(W.partitionBy("s1", "s2", "s3").orderBy("doc_id", "start"))
    late = trees.where("s1 is not null").withColumn("_place", place).where("_place > 1")
    trees = trees.where("s1 is null").select("doc_id", "start", "n").unionByName(late.select("doc_id", "start", "n"))
    runs = trees.repartition(partitions, "doc_id").sortWithinPartitions("doc_id", "start", "n").mapInArrow(joined, _RUNS)
    return stored(runs.unionByName(copied.distinct()), "runs")


def _repeats(paths: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in sorted order: where each path begins, and which suffixes repeat that first one elsewhere."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = np.append(True, (paths[:, 1:] != paths[:, :-1]).any(axis=0))
    first = np.flatnonzero(new)
    of = first[np.cumsum(new) - 1]
    return first, ~new & ((doc != doc[of]) | (pos != pos[of]))


def without_runs(df: DataFrame, runs: DataFrame, make, schema: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Applies ``make(rows, kept, n_words, n_removed)`` to chunks of ``df``: a RecordBatch of its rows, the kept words
    joined by one space as bytes, and the counts. It returns the columns of ``schema``. Only texts that
    may have runs are shuffled to meet them."""
    known = distinct_ids_filter(runs, "doc_id")

    def run(batches):
        for part in chunks(batches, text_col, 1 << 18):
            if "__slot" in part.schema.names:  # the others meet their runs
                slots = part.column(part.schema.get_field_index("__slot")).fill_null(-1).to_numpy(zero_copy_only=False)
                part = part.filter(pa.array((slots < 0) | ~known.hits(slots))).drop_columns(["__slot"])
                if not part.num_rows:
                    continue
            c = Chunk(part.column(part.schema.get_field_index(text_col)), 4)
            keep = np.ones(len(c.starts), bool)
            lists = part.column(part.schema.get_field_index("__runs")) if "__runs" in part.schema.names else [None] * part.num_rows
            for row, spans in enumerate(lists):
                a, b = c.span(row)
                for span in (spans.as_py() if spans is not None else None) or []:
                    keep[a + span["start"] : min(b, a + span["start"] + span["n"])] = False
            total = np.append(0, np.cumsum(keep))
            n_words, kept = np.diff(c.first), np.diff(total[c.first])
            data, texts = c.data.tobytes(), []
            for row in range(part.num_rows):
                at = range(*c.span(row))
                texts.append(b" ".join([data[c.starts[k] : c.ends[k]] for k in at if keep[k]]) if kept[row] < n_words[row] else b" ".join(data[c.starts[at[0]] : c.ends[at[-1]]].split()) if len(at) else b"")
            rows = part.drop_columns(["__runs"]) if "__runs" in part.schema.names else part
            yield pa.RecordBatch.from_arrays(make(rows, texts, n_words, n_words - kept), [x.split()[0] for x in schema.split(", ")])

    slot = F.when(F.col(id_col).isNotNull(), known.slot(F.col(id_col)))
    alone = df.withColumn("__slot", slot).mapInArrow(run, schema)
    spans = runs.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("__runs")).withColumnRenamed("doc_id", "__id")
    met = df.where(F.col(id_col).isNotNull()).where(known(F.col(id_col))).join(spans, F.col(id_col) == F.col("__id"), "left").drop("__id")
    return alone.unionByName(met.mapInArrow(run, schema))
