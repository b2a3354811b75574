"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more coordinate: x gets sqrt(M**2 - |x|**2), M the largest norm, and a query gets
0; the nearest point then has the largest inner product. The tree is built on a bounded sample (``SAMPLE`` distinct vectors); every
vector is dealt to the leaf it descends to. A query walks the tree with a priority queue of nodes by their distance and
visits leaves in that order. How many it visits is calibrated: the true neighbours of ``PROBES`` queries, found by brute
force over all vectors, tell the recall for any number of leaves; the smallest number with the wanted recall is taken,
or more where these leaves hold fewer than k candidates.

Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, since ties go to the smaller id; the
others are no candidates, which changes no result and keeps a vector that a third of all rows share from filling a leaf.
Rows that repeat an id and its vector are one row; rows that repeat an id with other vectors are queries of their own, told
apart by ``query_key``.
Leaves are dealt out in blocks of about BLOCK vectors, and the queries of a leaf in blocks too, so a large leaf is many
tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
PROBES = 200
BRANCHES = 8
#: The fewest vectors a leaf should hold (more of n: 4 * sqrt(n)), and the fewest sampled ones that a node is split for.
LEAF, LEAST = 256, 32
BLOCK = 2048
RECALL = 0.96


@dataclass
class Tree:
    top: float  # the largest norm
    centers: np.ndarray  # of all nodes; 0 is the root
    children: list[np.ndarray] = field(default_factory=list)  # node numbers; empty: a leaf
    sizes: np.ndarray | None = None  # rows dealt to each leaf

    def raised(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector descends to, nearest child by nearest child."""
        x, at = self.raised(x), np.zeros(len(x), np.int64)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            below = self.children[node]
            if not len(below):
                at[rows] = node
            elif len(rows):
                c = self.centers[below]
                near = ((c * c).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
                open_ += [(int(n), rows[near == k]) for k, n in enumerate(below)]
        return at

    def leaves(self, query: np.ndarray, visits: int, rows: int = 0):
        """Leaves in the order of a best-bin-first walk, until ``visits`` of them and ``rows`` rows are reached."""
        q, queue, seen, held = np.append(query, 0.0), [(0.0, 0)], 0, 0
        while queue and (seen < visits or held < rows):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if len(below):
                d = self.centers[below] - q
                for dist, n in zip(np.einsum("ij,ij->i", d, d).tolist(), below.tolist(), strict=True):
                    heapq.heappush(queue, (dist, n))
            else:
                seen, held = seen + 1, held + (int(self.sizes[node]) if self.sizes is not None else 0)
                yield node


def usable(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part: an id, and a finite vector that isn't zero. If
    lengths differ, the most frequent one takes part, the shorter one of two that tie."""
    v = F.col("embedding")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (common.n if common else 0))


def _matrix(batch, name: str = "embedding") -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(vectors: DataFrame, seed: int = 3) -> Tree:
    """The tree of the rows' vectors; with ``sizes`` still open."""
    n, norm = vectors.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    x = np.unique(_matrix(drawn), axis=0)
    tree = Tree(float(np.sqrt(norm or 0)), np.zeros((1, x.shape[1] + 1)), [np.zeros(0, np.int64)])
    if not n:
        return tree
    x, rng, centers = tree.raised(x), np.random.default_rng(seed), [np.zeros(x.shape[1] + 1)]
    enough = max(LEAST, int(max(LEAF, 4 * n**0.5) * len(x) / n))
    open_ = [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        if len(rows) <= enough:
            continue
        own, c = x[rows], x[rng.choice(rows, min(BRANCHES, len(rows)), replace=False)]
        for _ in range(12):
            near = ((c * c).sum(axis=1) - 2 * (own @ c.T)).argmin(axis=1)
            filled = np.unique(near)
            c = np.stack([own[near == k].mean(axis=0) for k in filled])
        near = ((c * c).sum(axis=1) - 2 * (own @ c.T)).argmin(axis=1)
        groups = [(c[k], rows[near == k]) for k in np.unique(near)]
        if len(groups) < 2:
            continue
        tree.children[node] = np.arange(len(centers), len(centers) + len(groups))
        for center, part in groups:
            open_.append((len(centers), part))
            centers.append(center)
            tree.children.append(np.zeros(0, np.int64))
    tree.centers = np.array(centers)
    return tree


def top_products(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query, place, score) of each query's k largest inner products, nearest first, ties to the smaller id.

    ``own``: the queries' ids, left out of their own candidates. A matrix product finds who may be among the k; the
    scores are summed again in a way that gives equal vectors equal scores wherever they stand.
    """
    rough = queries @ vectors.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    take = min(k, len(ids))
    edge = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
    slack = 1e-12 * (np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0) + 1)
    q, v = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
    score = (queries[q] * vectors[v]).sum(axis=1)
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], v[keep], score[keep]


def _calibrated(dealt: DataFrame, queries: DataFrame, tree: Tree, k: int) -> int:
    """The number of leaves to visit for the wanted recall, from PROBES queries' true neighbours among all rows."""
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(PROBES).toArrow()
    leaves = int(sum(not len(c) for c in tree.children))
    if not len(probes):
        return 1
    q, own = _matrix(probes), probes.column("vec_id").to_numpy()
    held = dealt.sparkSession.sparkContext.broadcast((q, own))

    def best(batches):
        qs, names = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                a, v, score = top_products(qs, names, _matrix(part), part.column("vec_id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), part.column("vec_id").take(pa.array(v)), pa.array(score), part.column("leaf").take(pa.array(v))], ["q", "vec_id", "score", "leaf"])

    first = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = dealt.mapInArrow(best, "q long, vec_id long, score double, leaf long").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).toPandas()
    needed = []
    for a, leaf in rows.groupby("q")["leaf"]:
        order = {n: at for at, n in enumerate(tree.leaves(q[a], leaves), 1)}
        needed.append(np.bincount([order[x] for x in leaf.tolist()], minlength=leaves + 1).cumsum() / len(leaf))
    recall = np.mean(needed, axis=0) if needed else np.ones(leaves + 1)
    return int(np.argmax(recall >= RECALL)) or 1


def nearest(df: DataFrame, is_query, k: int = 20, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest found of each query (rows of ``df`` where ``is_query``, a condition on vec_id): query_id, rank,
    vec_id, score, query_key (a hash of the query's vector).

    Rows with the query's own id are no candidates. Rows that repeat an id and its vector count once; an id with several
    vectors has one list for each as a query, and each may be found as a candidate. Null, zero and non-finite vectors and
    rows without an id take no part; an empty table gives no rows; other columns are not read."""
    vectors = usable(df, vector_col, id_col)
    tree = build(vectors)
    sc = df.sparkSession.sparkContext
    held = sc.broadcast(tree)

    def deal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.leaf_of(_matrix(batch))), *batch.columns], ["leaf", "vec_id", "embedding"])

    among = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    queries = vectors.where(is_query)
    # Equal rows are in one partition already, so dropping repeated ones needs no other shuffle.
    candidates = vectors.withColumn("copy", among).where(F.col("copy") <= k + 1).groupBy("embedding", "vec_id").agg(F.lit(0)).select("vec_id", "embedding")
    dealt = stored(candidates.mapInArrow(deal, "leaf long, vec_id long, embedding array<double>"), "vectors")
    # A row for each leaf, as many as the tree has; the tree has at most SAMPLE / LEAST leaves.
    tree.sizes = np.zeros(len(tree.children), np.int64)
    for r in dealt.groupBy("leaf").count().toLocalIterator():
        tree.sizes[r["leaf"]] = r["count"]
    visits = _calibrated(dealt, queries, tree, k)
    walked = sc.broadcast(tree)

    def walk(batches):
        t = walked.value
        for batch in batches:
            x = _matrix(batch)
            lists = [list(t.leaves(q, visits, k + 1)) for q in x]
            of = np.repeat(np.arange(len(x)), [len(v) for v in lists])
            leaf, of = pa.array(np.concatenate(lists).astype(np.int64)), pa.array(of)
            yield pa.RecordBatch.from_arrays([leaf, *(c.take(of) for c in batch.columns)], ["leaf", "vec_id", "query_key", "embedding"])

    # Without the leaf that the query itself lies in as a column, names stay apart from those of the vectors.
    keyed = queries.select("vec_id", F.xxhash64("embedding").alias("query_key"), "embedding").dropDuplicates(["vec_id", "query_key"])
    asked = stored(keyed.mapInArrow(walk, "leaf long, vec_id long, query_key long, embedding array<double>"), "walks")
    size = lambda rows, name: rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = size(dealt, "vs").join(size(asked, "qs"), "leaf")
    part = lambda rows, own, other: (  # noqa: E731  each row meets every block of the other side
        rows.join(F.broadcast(blocks), "leaf")
        .withColumn("own", F.pmod(F.xxhash64("vec_id", F.lit(11)), own))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    left = part(dealt, F.col("vs"), "qs").select("leaf", F.col("own").alias("v"), F.col("other").cast("long").alias("q"), "vec_id", "embedding")
    right = part(asked, F.col("qs"), "vs").select("leaf", F.col("other").cast("long").alias("v"), F.col("own").alias("q"), "vec_id", "query_key", "embedding")

    def search(vecs: pa.Table, asking: pa.Table) -> pa.Table:
        ids, names, keys = (t.column(c).to_numpy() for t, c in ((vecs, "vec_id"), (asking, "vec_id"), (asking, "query_key")))
        none = np.zeros(0, np.int64)
        x, y, out = _matrix(vecs), _matrix(asking), [_best(none, none, np.zeros(1, np.int64), np.zeros(0), none)]
        for at in range(0, len(names) if len(ids) else 0, 512):
            own = names[at : at + 512]
            q, v, score = top_products(y[at : at + 512], own, x, ids, k)
            out.append(_best(own, keys[at : at + 512], np.searchsorted(q, np.arange(len(own) + 1)), -score, ids[v]))
        return pa.concat_tables(out)

    kind = "array<struct<far:double,vec_id:bigint>>"
    found = left.groupBy("leaf", "v", "q").cogroup(right.groupBy("leaf", "v", "q")).applyInArrow(search, f"query_id long, query_key long, best {kind}")
    best = found.groupBy("query_id", "query_key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = best.select("query_id", "query_key", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"), "query_key")


def _best(query: np.ndarray, key: np.ndarray, starts: np.ndarray, far: np.ndarray, ids: np.ndarray) -> pa.Table:
    entries = pa.StructArray.from_arrays([pa.array(far), pa.array(ids)], ["far", "vec_id"])
    return pa.table({"query_id": pa.array(query), "query_key": pa.array(key), "best": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries)})
