"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations of the 32-bit numbers make a whole signature: the first scatters a set's elements, the second, shifted
circularly by k, gives coordinate k. BANDS bands of ROWS coordinates find candidates: two sets with similarity 0.8 share
no band with probability (1 - 0.8**4)**28 = 4e-7.

Documents with the same set are one class, whose members never meet each other; only classes are banded. In each
bucket all members are compared with its smallest one, links are checked on the full sets of words, and components are
built; then the members of a bucket that are still in different components are compared with each other. In small buckets
these are all pairs. Members of large buckets are compared if they share one of their rarest shingles: of two sets with the
wanted similarity, each has a common shingle among its first n - ceil(percent * n / 100) + 1 in any order of all shingles,
and the order taken has those first that only one component holds (see ``rare_shingles``). So a bucket of thousands of copies
mostly costs one comparison a member, and no candidate between different components is left out.

Hashes only find links: each link is confirmed on the two texts' words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct_ids_filter, mix64, stored, utf8, window_hashes, word_hashes, words
from .components import components

ROWS, BANDS = 4, 28
#: Buckets with more members than SMALL are compared by their rarest shingles, and what shares such a shingle with more
#: than SMALL others in blocks of about BLOCK documents.
SMALL, BLOCK = 32, 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted set of hashes of each text's ``size``-word shingles, A-Z lower-cased; of all its words if they are fewer."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    runs = window_hashes(hashes, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix64(window_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_shingles(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The set of shingles itself, of a text's words (bytes.split parts words at the white space of ``common.SPACES``)."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)} if w else set()


def alike(s: set, t: set, percent: int) -> bool:
    common = len(s & t)
    return common > 0 and 100 * common >= percent * (len(s) + len(t) - common)


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: products by odd numbers and shifted differences can be undone."""
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(elements: np.ndarray, length: int = ROWS * BANDS) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of 64-bit hashes."""
    scattered = _permuted((elements >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(length, dtype=np.uint32)[:, None]
    out = np.full(length, np.uint32(0xFFFFFFFF))
    for at in range(0, len(scattered), 1024):
        np.minimum(out, _permuted(scattered[None, at : at + 1024] + shifts, 0x9E3779B1, 0xC2B2AE3D).min(axis=1), out=out)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    pairs = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for j in range(0, ROWS, 2):
        key = mix64(key + (pairs[:, j] << np.uint64(32) | pairs[:, j + 1]))
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set; null: empty), bands."""

    def run(batches):
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [_bands(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.append(0, np.cumsum([len(b) for b in bands]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.where(distinct_ids_filter(ids, "id")(F.col("doc_id")))
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches):
        for part in chunks(batches, "text_b", 1 << 18):
            a = part.column("a").to_numpy()
            own, at, of = np.unique(a, return_index=True, return_inverse=True)
            left_texts, right_texts = part.column("text_a").take(pa.array(at)), part.column("text_b")
            lefts, rights = shingle_sets(left_texts, size), shingle_sets(right_texts, size)
            exact: dict[int, set] = {}  # the words' own shingles of left texts, where they were needed
            good = np.zeros(len(a), bool)
            for k, s in enumerate(rights):
                t = lefts[of[k]]
                if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) > 0:
                    common = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        if of[k] not in exact:
                            exact[of[k]] = word_shingles(left_texts[int(of[k])].as_py().encode(), size)
                        good[k] = alike(exact[of[k]], word_shingles(right_texts[k].as_py().encode(), size), percent)
            yield part.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _linked(sets: list[np.ndarray], roots: np.ndarray, apart: np.ndarray, percent: int, confirm) -> list[tuple[int, int]]:
    """Links between the sets that join different roots, as a spanning forest: at most one link a set. ``confirm(k, j)``
    has the last word on each.

    ``apart``: the side of each set; sets of side 0 meet those of side 1, or all meet each other if there's one side.
    Intersections are counted over an inverted index, one set against all others at a time.
    """
    size = np.array([len(s) for s in sets])
    right = np.flatnonzero(apart == apart.max())
    every = np.concatenate([sets[k] for k in right]) if len(right) else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(right, size[right])[order]
    boss = {r: r for r in roots.tolist()}

    def top(x):
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    out = []
    for k in np.flatnonzero(apart == apart.min()).tolist():
        a, b = np.searchsorted(every, sets[k], "left"), np.searchsorted(every, sets[k], "right")
        n = b - a
        where = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(sets))
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * (size[k] + size - common))).tolist():
            x, y = top(int(roots[k])), top(int(roots[j]))
            if x != y and confirm(k, j):
                boss[max(x, y)] = min(x, y)
                out.append((k, j))
    return out


def rare_shingles(large: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key (a shingle's hash), rep, root, held (set size), least (smallest rep of the key) and n (members) for what the
    members of large buckets (rows: rep, root) have to be compared by: whoever is linked across components shares a key.

    All shingles are ordered: first those that one component alone holds, then by the number of members that hold them,
    then by hash. A set's first held - ceil(percent * held / 100) + 1 shingles are its prefix, and two sets that have no
    common shingle among these can't have the wanted similarity. A shingle of one component can't be common to two, so
    only the others are sorted, and a set that shares too few of its shingles with other components drops out.
    Rows that repeat an id with other texts have a prefix for each text.
    """
    held = stored(large.select("rep", "root").distinct(), "apart")
    texts = docs.where(distinct_ids_filter(held, "rep")(F.col("doc_id")))
    texts = held.join(texts, F.col("rep") == F.col("doc_id")).select("rep", "root", F.xxhash64("text").alias("copy"), "text")

    def run(batches):
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), size)
            sizes = np.array([len(s) for s in sets], np.int64)
            of = pa.array(np.repeat(np.arange(len(sets)), sizes))
            columns = [*(part.column(name).take(of) for name in ("rep", "root", "copy")), pa.array(np.repeat(sizes, sizes))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sets).view(np.int64))], ["rep", "root", "copy", "held", "key"])

    # Stored, as is what is counted of it, so that a shingle of very many members is a split join, not one task's.
    rows = stored(texts.mapInArrow(run, "rep long, root long, copy long, held long, key long"), "shingles")
    across = lambda of: of.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    common = stored(across(rows).select("key", "n"), "common-shingles")
    sets = rows.join(common, "key").groupBy("rep", "copy", "root", "held").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("common"))
    take = F.size("common") + 1 - F.ceil(F.col("held") * percent / 100)
    first = sets.withColumn("take", take.cast("int")).where("take > 0").select("rep", "root", "held", F.explode(F.slice("common", 1, F.col("take"))).alias("c"))
    first = stored(first.select("rep", "root", "held", "c.key"), "prefixes")
    return first.join(across(first).select("key", "least", "n"), "key")


def _pairs_apart(rows: DataFrame, also: str) -> DataFrame:
    """The pairs (a, b) of what shares a key (rows: key, rep, root, n) and isn't in one component, where the key has at most
    SMALL members and ``also``, a condition on the two rows x and y, holds."""
    x, y = rows.where(F.col("n") <= SMALL).alias("x"), rows.where(F.col("n") <= SMALL).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")))
    return met.where(also).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _compared_in_blocks(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of large buckets (rows: least, rep, root), all of them against each other.

    Buckets with common members make a cluster. A cluster is dealt by a hash into blocks of about BLOCK members, large
    components into blocks of their own; each pair of blocks is one group, except two blocks of one component. So no pair
    of documents is a row anywhere, no group holds more than two blocks, and no member is left out.
    """
    rows = stored(rows, "large-buckets")
    clusters = components(rows.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    inside = stored(rows.select("rep", "root").distinct().join(clusters, F.col("rep") == F.col("node")).select("rep", rows["root"], clusters["root"].alias("cluster")), "clusters")
    own = inside.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    own = own.select("cluster", "root", "n", F.when(F.col("n") >= BLOCK // 2, F.col("root")).alias("part"))
    parts = own.groupBy("cluster", "part").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    dealt = inside.join(own, ["cluster", "root"]).alias("i").join(parts.alias("p"), (F.col("i.cluster") == F.col("p.cluster")) & F.col("i.part").eqNullSafe(F.col("p.part")))
    block = F.concat_ws("/", F.col("i.cluster"), F.coalesce(F.col("i.part").cast("string"), F.lit("-")), F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = stored(dealt.select("i.cluster", "i.part", "rep", "root", block.alias("block")), "blocks")
    blocks = dealt.select("cluster", "part", "block").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, F.col("x.cluster") == F.col("y.cluster")).where("x.block <= y.block and not (x.part <=> y.part and x.part is not null)")
    meet = meet.select(F.concat_ws("|", "x.block", "y.block").alias("pair"), F.col("x.block").alias("b0"), F.col("y.block").alias("b1"))
    sides = meet.select("pair", F.lit(0).alias("side"), F.col("b0").alias("block")).union(meet.where("b0 <> b1").select("pair", F.lit(1), "b1"))
    texts = docs.where(distinct_ids_filter(dealt, "rep")(F.col("doc_id")))
    held = dealt.join(texts, F.col("rep") == F.col("doc_id")).select("block", "rep", "root", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [s for part in chunks(iter(table.to_batches())) for s in shingle_sets(part.column("text"), size)]
        rep = table.column("rep").to_numpy()
        words = lambda k: word_shingles(table.column("text")[k].as_py().encode(), size)
        got = _linked(sets, table.column("root").to_numpy(), table.column("side").to_numpy(), percent, lambda k, j: alike(words(k), words(j), percent))
        return pa.table({"a": pa.array([rep[k] for k, _ in got], pa.int64()), "b": pa.array([rep[j] for _, j in got], pa.int64())})

    return held.join(sides, "block").select("pair", "side", "rep", "root", "text").groupBy("pair").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links lead to), kept (is it that id itself).

    A null or wordless text has the empty set and links to nothing, copies of it included. A null id takes part in no
    link and is its own component. Rows that repeat an id with the same text are all kept or none; if the texts differ,
    a link of either links the id. Very long texts are compared whole, as chunks of their own. An empty table gives an
    empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(signatures(docs, size), "signatures")
    # Stored, so that the join below has no aggregate beside it and a class of very many copies can be split.
    classes = stored(sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = sets.join(classes, "set_key", "left").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    members = stored(members, "members")
    rows = members.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least")
    rows = stored(rows.join(buckets.hint("shuffle_hash"), "key").distinct(), "buckets")
    links = stored(confirmed(stored(rows.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "pairs"), docs, size, percent), "links")
    roots = components(links)
    # Second round: what shares a bucket and is still apart, in large buckets only if it shares a rare shingle too.
    named = rows.join(roots, rows["rep"] == roots["node"], "left").select("key", "least", "rep", F.coalesce("root", "rep").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n")).where("r1 < r2").select("key", "n")
    open_ = stored(named.join(apart.hint("shuffle_hash"), "key"), "open-buckets")
    rest = _pairs_apart(open_, "x.rep <> x.least")  # those were compared in the first round
    large = open_.where(F.col("n") > SMALL)
    more = []
    if not large.isEmpty():
        by_shingle = stored(rare_shingles(large, docs, size, percent), "rare-shingles")
        rest = rest.union(_pairs_apart(by_shingle, f"100 * least(x.held, y.held) >= {percent} * greatest(x.held, y.held)"))
        many = by_shingle.where(F.col("n") > SMALL)
        if not many.isEmpty():
            more.append(_compared_in_blocks(many.select("least", "rep", "root"), docs, size, percent))
    pairs = stored(rest.distinct(), "pairs")
    if not pairs.isEmpty():
        more.append(confirmed(pairs, docs, size, percent))
    done = members.join(roots, members["rep"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("root"))
    component = F.col("root")
    if more:
        # The new links join components, so only those are gone through again, not all links.
        ends = more[0] if len(more) == 1 else more[0].union(more[1])
        for x in "ab":
            ends = ends.join(roots, ends[x] == roots["node"], "left").withColumn(x, F.coalesce("root", x)).select("a", "b")
        merged = components(ends).select("node", F.col("root").alias("merged"))
        done, component = done.join(merged, done["root"] == merged["node"], "left"), F.coalesce("merged", "root")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
