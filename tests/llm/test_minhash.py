import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import minhash
from flowlark.llm.components import components
from flowlark.llm.queries import op5_minhash_dedup

from .helpers import EDGE_TEXTS, WORD, documents, save, twins

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(texts, size=4, percent=80):
    sets, boss = [shingles(t, size) for t in texts], list(range(len(texts)))

    def top(x):
        return x if boss[x] == x else top(boss[x])

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            boss[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in range(len(texts))}


def family(n, edits, seed, length=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    base = [word() for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(length)] = word()
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,block", [(32, 512), (4, 16)])
def test_components_match_brute_force(spark, tmp_path, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [*EDGE_TEXTS, *family(70, 5, 1), *family(30, 3, 2), *family(20, 0, 3), "One Two", "one two", "ONE TWO three four", "É x", "é x"]
    random.Random(4).shuffle(texts)
    got = {r.doc_id: tuple(r)[1:] for r in op5_minhash_dedup(spark, save(documents(spark, texts).withColumn("rep", F.lit("clash")), tmp_path, "documents")).collect()}
    assert got == brute(texts)


def offshoots(n, own, seed):
    """Texts of one passage, each with words of its own after it; every fourth has three near copies."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    out = []
    for k in range(n):
        w = [*passage, *(f"o{k}-{j}" for j in range(own))]
        out.append(" ".join(w))
        for c in range(3 if k % 4 == 0 else 0):
            w[r.randrange(60, len(w))] = f"c{k}-{c}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("own,blocks", [(24, False), (12, True)])
def test_large_buckets_are_compared_by_rare_shingles(spark, tmp_path, monkeypatch, own, blocks):
    """Texts that share a passage but not enough of it meet nobody; those near the bound are compared in blocks."""
    used = []
    compare = minhash._compared_in_blocks
    monkeypatch.setattr(minhash, "_compared_in_blocks", lambda *a: used.append(1) or compare(*a))
    monkeypatch.setattr(minhash, "SMALL", 6)
    texts = offshoots(120, own, 5)
    random.Random(6).shuffle(texts)
    got = {r.doc_id: tuple(r)[1:] for r in op5_minhash_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts) and bool(used) == blocks


def test_rare_shingles_lose_no_link(spark, tmp_path):
    """Every pair of different components with the wanted similarity shares a key, for random sets and components."""
    r = random.Random(9)
    texts = [*family(40, 8, 11), *family(40, 2, 12), *offshoots(30, 13, 13)]
    docs = documents(spark, texts).select("doc_id", "text")
    roots = [r.randrange(i // 3 + 1) for i in range(len(texts))]
    rows = spark.createDataFrame(list(enumerate(roots)), "rep long, root long")
    keys = {}
    for x in minhash.rare_shingles(rows, docs, 4, 80).collect():
        keys.setdefault(x.rep, set()).add(x.key)
    sets = [shingles(t, 4) for t in texts]
    wanted = [(i, j) for i, j in combinations(range(len(texts)), 2) if roots[i] != roots[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(wanted) > 100 and all(keys.get(i, set()) & keys.get(j, set()) for i, j in wanted)


def test_empty_null_ids_and_repeated_rows(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    odd = df.union(df).union(df.withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert [x[:2] + x[3:] for x in got][:4] == [(False, 0, True)] * 2 + [(False, 1, False)] * 2


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, np.uint64)
    for shared in (0.3, 0.8):
        n = int(2000 * 2 * shared / (1 + shared))
        a, b = x[:2000], x[2000 - n : 4000 - n][:2000]
        assert abs((minhash.signature(a, 2048) == minhash.signature(b, 2048)).mean() - n / (len(a) + len(b) - n)) < 0.05


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(5000, 100)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (8, None), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 160), 5000]}
    assert components(df.limit(0)).count() == 0


def test_words_that_a_polynomial_hash_takes_for_equal(spark, tmp_path):
    s, t = twins()
    texts = [f"{s} x y z", f"{t} x y z", f"{s} w0 w1 w2 w3", f"{t} w0 w1 w2 w3"]
    got = {r.doc_id: tuple(r)[1:] for r in op5_minhash_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts) and all(k for _, _, k in got.values())


def test_texts_of_over_a_megabyte(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(180_000)]
    near = [w if r.random() > 0.02 else "changed" for w in words]
    texts = [" ".join(words), " ".join(near), "short text of five words", "y" * 1_500_000]
    got = {r.doc_id: tuple(r)[1:] for r in op5_minhash_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts) and got[1][1] == 0
