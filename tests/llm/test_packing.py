import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlark.llm import packing, tokens
from flowlark.llm.queries import op4_packing

from .helpers import EDGE_TEXTS, documents, save

public = pytest.importorskip("public_tokenizers")
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def well_packed(rows, texts):
    """Every id of every document in exactly one piece, sequences gapless, and the share of padding."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, pieces in by.items():
        ids = np.array([*tokens.library_tokenizer(JSON).encode(texts[i] or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / sum(r.length for r in rows)


@pytest.mark.parametrize("shard", [1 << 19, 3000])
def test_contract_query(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    r = random.Random(1)
    texts = [*EDGE_TEXTS, "<|endoftext|> here", *["the same text " * 40] * 30, *[" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randint(1, 900))) for _ in range(60)]]
    df = documents(spark, texts).withColumn("start", F.lit("clash"))
    rows = op4_packing(spark, save(df, tmp_path, "documents")).collect()
    assert well_packed(rows, dict(enumerate(texts))) == 0


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d e")], "doc_id long, text string")
    got = packing.pack(df, RANKS, JSON).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == [(0, 3), (1, 2), (1, 3)]
    assert packing.pack(df.limit(0), RANKS, JSON).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=1, max_size=30), min_size=1, max_size=40))
def test_shards_cover_everything(tails):
    lengths = np.array([len(t) for t in tails])
    got = packing.pack_shard(lengths, [np.array(t, np.uint64) for t in tails], 16)
    seen = {(k, a + i) for k, a, n, _, _ in got for i in range(n)}
    assert len(seen) == lengths.sum() == sum(n for _, _, n, _, _ in got)


def test_a_seed_is_followed_by_its_neighbour():
    words = {name: np.arange(10, dtype=np.uint64) + 100 * k for k, name in enumerate("abcdefghijkl")}
    tails = [words[x] for x in "abcdefghijkl"] + [words["a"]]
    got = packing.pack_shard(np.full(13, 10), tails, 20)
    assert [k for k, _, _, s, _ in got if s == 0] == [0, 12]


def test_bm25_scores_match_the_formula():
    tails = [np.array(t, np.uint64) for t in ([1, 2, 2, 3], [2, 3, 9], [7, 7], [3, 8], [1])] + [np.array([k], np.uint64) for k in range(50, 80)]
    index, n = packing.Index(tails), 35
    mean = np.mean([len(t) for t in tails])
    for j, t in enumerate(tails):
        want = 0.0
        for w in (1, 2, 3):
            held = sum(w in x for x in tails)
            tf = (t == w).sum()
            want += np.log1p((n - held + 0.5) / (held + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        assert abs(index.scores(0)[j] - want) < 1e-5


def test_common_words_score_by_the_same_formula():
    """Words that most tails hold are kept in rows of weights; others in lists. Scores don't tell."""
    r = random.Random(3)
    tails = [np.array([1, 2, 2, *r.choices(range(10, 40), k=r.randint(1, 9))] + ([3] if k % 2 else []), np.uint64) for k in range(120)]
    index, n, mean = packing.Index(tails), 120, np.mean([len(t) for t in tails])
    assert len(index.rows) >= 3
    for seed in (0, 1, 77):
        got = index.scores(seed)
        for j, t in enumerate(tails):
            want = 0.0
            for w in set(tails[seed].tolist()):
                held = sum(w in x for x in tails)
                tf = (t == w).sum()
                if held > 1 and tf:
                    want += np.log1p((n - held + 0.5) / (held + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            assert abs(got[j] - want) < 1e-4


def test_texts_of_over_a_megabyte(spark):
    texts = ["many different words " * 60_000, "short"]
    assert well_packed(packing.pack(documents(spark, texts), RANKS, JSON).collect(), dict(enumerate(texts))) == 0
