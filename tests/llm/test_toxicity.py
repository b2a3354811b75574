import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowlark.llm import toxicity
from flowlark.llm.queries import op2_toxicity

from .helpers import EDGE_TEXTS, save
from .test_langid import table, texts_of

BAD = ["gralpok", "zwibbix", "frumtosk"]


def corpus(n):
    r, out = random.Random(5), []
    for i, t in enumerate(texts_of("en", n, 9)):
        words = t.split()
        if i % 4 == 0:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(BAD))
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


def test_held_out_and_edges(spark, tmp_path):
    rows = corpus(400)
    docs = table(spark, [(t, "en") for t, _ in rows] + [(t, None) for t in EDGE_TEXTS])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(3, 1, None), (405, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    save(labels, tmp_path, "labels")
    got = {r.doc_id: r for r in op2_toxicity(spark, save(docs, tmp_path, "documents")).collect()}
    assert len(got) == len(rows) + len(EDGE_TEXTS)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(got[i].predicted, y) for i, (_, y) in enumerate(rows) if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_one_class_empty_table_and_clashing_columns(spark):
    df = table(spark, [("a b c", "en")] * 3).withColumn("label", F.lit(0)).withColumn("score", F.lit("x")).withColumn("predicted", F.lit("x"))
    model = toxicity.fit(df, df.select("doc_id", "label"))
    assert [r.predicted for r in toxicity.score(df, model).collect()] == [0, 0, 0]
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), df.limit(0))).count() == 0


def brute_features(text):
    """The hashes of a text's distinct n-grams, symbol by symbol."""
    low = (text or "").lower()
    codes = [0, *(ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in low), 0]
    out = set()
    for width in toxicity.WIDTHS:
        for at in range(len(codes) - width + 1):
            own = codes[at : at + width]
            if all(own[1:-1]):
                h = width * 0x9E3779B1 & 0xFFFFFFFF
                for c in own:
                    h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                out.add((h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_counts_ratios_vectors_and_scores_are_those_of_plain_python(spark):
    rows = corpus(120)
    docs = table(spark, [(t, "en") for t, _ in rows] + [(None, "en"), (rows[0][0], "en")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(len(rows) + 1, rows[0][1])], "doc_id long, label int")
    rows = [*rows, rows[0]]
    counts, sizes, sample = toxicity._counted(docs, labels, "text", "label", "doc_id", 1000)
    held = [[Counter(h for t, y in rows if y == k for h in brute_features(t))][0] for k in (0, 1)]
    assert sizes == {k: sum(y == k for _, y in rows) for k in (0, 1)}
    assert {r.bucket: (r.n0, r.n1) for r in counts.collect()} == {h: (held[0][h], held[1][h]) for h in {*held[0], *held[1]}}
    share = lambda k, h: (held[k][h] + 1) / (sum(held[k].values()) + 2**toxicity.BITS)
    ratio = {h: math.log(share(1, h) / share(0, h)) for h in {*held[0], *held[1]}}
    strong = toxicity._strong(counts, 3, 0.8)
    want = {h: r for h, r in ratio.items() if max(held[0][h], held[1][h]) >= 3 and abs(r) >= 0.8}
    assert dict(zip(strong["bucket"], strong["ratio"].round(9), strict=True)) == {h: round(r, 9) for h, r in want.items()}
    buckets = sorted(want)
    made = toxicity._vectors(spark, sample, sizes, np.array(buckets), np.array([want[h] for h in buckets])).collect()
    got = Counter((r.label, tuple((buckets[i], round(float(v), 9)) for i, v in zip(r.features.indices, r.features.values, strict=True))) for r in made)
    assert got == Counter((y, tuple((h, round(want[h], 9)) for h in sorted(brute_features(t) & set(buckets)))) for t, y in rows)
    r = random.Random(2)
    model = toxicity.Model(np.array(buckets), np.array([r.uniform(-1, 1) for _ in buckets], np.float32), -0.25)
    weight = dict(zip(buckets, model.weights.tolist(), strict=True))
    texts = [t for t, _ in rows] + EDGE_TEXTS + ["gralpok " * 150_000]
    for x in toxicity.score(table(spark, [(t, None) for t in texts]), model).collect():
        z = -0.25 + sum(weight[h] for h in brute_features(texts[x.doc_id]) if h in weight)
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-6 and x.predicted == int(x.score >= 0.7)


def test_the_fit_is_the_least_of_its_loss(spark):
    """The gradient of the weighted, penalised loss is 0 at the weights found."""
    rows = corpus(200)
    docs, labels = table(spark, [(t, "en") for t, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, label int")
    counts, sizes, sample = toxicity._counted(docs, labels, "text", "label", "doc_id", 1000)
    strong = toxicity._strong(counts, 4, 1.0)
    vectors = toxicity._vectors(spark, sample, sizes, strong["bucket"].to_numpy(np.int64), strong["ratio"].to_numpy())
    w, b = toxicity._logistic(vectors, len(rows))
    held = vectors.collect()
    x, y, own = np.stack([r.features.toArray() for r in held]), np.array([r.label for r in held]), np.array([r.weight for r in held])
    miss = own * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(x.T @ miss + toxicity.PENALTY * w).max() < 0.05 and abs(miss.sum()) < 0.05


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "a b")], "doc_id long, text string")
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.5)
    assert toxicity.score(df, model).count() == 4


def test_texts_of_over_a_megabyte(spark):
    """Only the end of the long text is toxic, and it is enough of it to tell."""
    rows = corpus(200)
    docs = table(spark, [(t, "en") for t, _ in rows])
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, label int"))
    fair = " ".join(t for t, y in rows if not y)
    fair = " ".join([fair] * (1_100_000 // len(fair) + 1))
    df = table(spark, [(fair, "en"), (fair + " " + " ".join(BAD * 20), "en"), ("x" * 1_200_000, "en")])
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 3 and got[0] < 0.7 and got[1] > got[0] and 0 <= got[2] <= 1
