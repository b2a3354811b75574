import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import repeats
from flowlark.llm.queries import op6_substring_dedup

from .helpers import EDGE_TEXTS, WORD, documents, save, sha, twins


def brute(texts, width=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone.update(range(k, k + width))
            seen.add(window)
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [" ".join(r.choices(vocabulary, k=k)) for k in (19, 20, 21, 45, 90)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif kind < 0.6:
            parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(3)]
            for _ in range(r.randint(1, 3)):
                parts.insert(r.randint(0, 3), r.choice(passages))
            texts.append("\n".join(parts))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.randint(0, 90))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_contract_query(spark, tmp_path, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(repeats, "SAMPLED", 1)
    texts = [*EDGE_TEXTS, *corpus(seed), "again " * 70, "again and " * 40, *["a b c d e " + " ".join(f"v{i}{j}" for j in range(30)) for i in range(60)]]
    df = documents(spark, texts).withColumn("runs", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in op6_substring_dedup(spark, save(df, tmp_path, "documents")).collect()}
    assert got == brute(texts)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (7, None)], "doc_id long, text string")
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in repeats.repeated_runs(df).collect()}
    assert runs == {9: [(0, 30)]}
    assert repeats.repeated_runs(df.limit(0)).count() == 0


def test_sliding_min_and_runs():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for n in (1, 2, 5, 16, 50, 51):
        assert repeats._sliding_min(x, n).tolist() == [x[k : k + n].min() for k in range(50 - n + 1)]
    doc, at, n = repeats._runs_of(np.array([1, 1, 1, 2, 2]), np.array([0, 5, 30, 0, 2]), np.array([20, 20, 20, 20, 1]))
    assert (doc.tolist(), at.tolist(), n.tolist()) == ([1, 1, 2], [0, 30, 0], [25, 20, 20])


def test_words_that_a_polynomial_hash_takes_for_equal(spark, tmp_path):
    s, t = twins()
    tail = " ".join(f"w{k}" for k in range(19))
    texts = [f"{s} {tail}", f"{t} {tail}", f"{s} {tail}"]
    got = {r.doc_id: tuple(r)[1:] for r in op6_substring_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts) and got[1][1] == 0 and got[2][1] == 20


def test_texts_of_over_a_megabyte(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(180_000)]
    texts = [" ".join(words), "one two " + " ".join(words[5000:150_000]) + " three", "y" * 1_500_000]
    got = {r.doc_id: tuple(r)[1:] for r in op6_substring_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts) and got[1][1] == 145_000


def test_a_window_of_a_third_of_all_documents_is_many_tasks_work(spark, tmp_path, monkeypatch):
    """Its suffixes are dealt by their documents, and no partition finds most of the copies."""
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # so that few copies meet in a chunk
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    kept = {}
    monkeypatch.setattr(repeats, "stored", lambda df, name, f=repeats.stored: kept.setdefault(name, f(df, name)))
    r = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(20))
    plain = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(20, 40)))
    texts = [plain() + (f" {passage} " if i % 3 == 0 else " ") + plain() for i in range(600)]
    try:
        got = {x.doc_id: tuple(x)[1:] for x in op6_substring_dedup(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
        assert got == brute(texts) and sum(v[1] for v in got.values()) >= 199 * 20
        open_ = kept["repeated-windows"].where("s1 is not null")
        assert open_.select("s1", "s2", "s3").distinct().count() == 1 and open_.count() >= 4
        done = kept["repeated-windows"].where("s1 is null").groupBy(F.input_file_name()).count().toPandas()["count"]
        assert len(done) >= 4 and done.max() <= done.sum() / 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
