import math
import random
import re
from collections import Counter

import numpy as np

from flowlark.llm import lexical
from flowlark.llm.queries import op12_lexical_search

from .helpers import EDGE_TEXTS, save

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    out = []
    for item, text in sorted({x for x in items}, key=repr):
        scored = []
        for i, c, n in counts:
            m, score = 100 - 75 + (75 * n * n_docs) // n_terms, 0
            for t in terms(text):
                if c[t]:
                    df = sum(t in other for _, other, _ in counts)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    pool = ["alpha", "Beta", "gamma", "délta", "e1", "zeta", "事", "averyveryverylongtermindeed", "averyveryverylongtermindeee"]
    text = lambda most: " ".join(r.choices(pool, weights=[9, 7, 5, 4, 3, 2, 1, 1, 1], k=r.randint(0, most))).replace("e1 ", "e1,_-")
    return [(i, text(30)) for i in range(n)], [(j, text(8)) for j in range(9)]


def rows(df):
    return sorted((tuple(x) for x in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus(1, 90)
    docs += [(200 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [docs[3], (None, docs[5][1]), (None, docs[5][1]), (4, "alpha other text of the same id"), (300, "alpha " * 5000)]
    items += [items[2], (2, "gamma zeta gamma"), (50, None), (51, ""), (52, "unheard of"), (None, "alpha zeta"), (53, "alpha " * 70), (54, "Ünïcödé 😀 x nul")]
    folder = save(spark.createDataFrame(docs, DOCS), tmp_path, "documents")
    save(spark.createDataFrame(items, ITEMS), tmp_path, "benchmark")
    assert rows(op12_lexical_search(spark, folder)) == brute(docs, items)


def test_blocks_of_items_and_documents(spark, monkeypatch):
    docs, items = corpus(2, 300)
    df, asked = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(lexical, "BLOCK", 64)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    assert rows(lexical.search(df, asked, 3)) == brute(docs, items, 3)
    monkeypatch.setattr(lexical, "TERMS", 2)  # items have more terms than a block may
    assert rows(lexical.search(df, asked, 3)) == brute(docs, items, 3)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(3, 20)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", terms string, n int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS + ", score int")
    assert rows(lexical.search(df, asked)) == brute(docs, items)
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df.limit(0), asked).columns == lexical.search(df, asked.limit(0)).columns


def test_bitwise_sums_and_their_best():
    r = np.random.default_rng(4)
    for n_docs, n_terms, k in ((1, 1, 1), (70, 5, 3), (200, 9, 10), (130, 4, 500)):
        impact = r.integers(0, 1 << 36, (n_terms, n_docs)) * (r.random((n_terms, n_docs)) < 0.5)
        impact[:, : n_docs // 2] //= 1 << 34  # many ties
        term, doc = np.nonzero(impact)
        words = -(-n_docs // 64)
        index = lexical.slices(term, doc, impact[term, doc], n_terms, words)
        rounds = r.integers(0, n_terms + 1, (6, 7))
        sums = lexical.add_up(index, rounds)
        want = np.vstack([impact, np.zeros((1, n_docs), np.int64)])[rounds].sum(axis=0)
        bits = np.unpackbits(sums.view(np.uint8), axis=2, bitorder="little")[:, :, :n_docs].astype(np.int64)
        assert (np.tensordot(1 << np.arange(len(sums)), bits, axes=(0, 0)) == want).all()
        found = np.unpackbits(lexical.best(sums, k).view(np.uint8), axis=1, bitorder="little")
        for j in range(7):
            top = sorted((d for d in range(n_docs) if want[j, d] > 0), key=lambda d: (-want[j, d], d))[:k]
            assert np.flatnonzero(found[j]).tolist() == sorted(top)


def test_texts_of_over_a_megabyte(spark):
    docs = [(0, "alpha beta " * 100_000 + "gamma"), (1, "gamma"), (2, "z" * 1_200_000)]
    items = [(0, "gamma alpha"), (1, "beta " * 300)]
    assert rows(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)
