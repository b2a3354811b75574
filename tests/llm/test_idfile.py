import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlark.llm import idfile, tokens
from flowlark.llm.queries import op9_token_id_files

from .helpers import EDGE_TEXTS, documents, save

public = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 2**32 - 1), max_size=50)), max_size=8), st.sampled_from([1, 8]), st.sampled_from([1, 7, 64]))
def test_chunks_round_trip(rows, bits, block):
    docs, ids = [d for d, _ in rows], [np.array(x, np.uint32) for _, x in rows]
    names, starts, flat = idfile.read_chunk(idfile.write_chunk(docs, ids, bits, block))
    assert names == docs and flat.tolist() == [k for _, x in rows for k in x]
    assert np.diff(starts).tolist() == [len(x) for _, x in rows]


def test_planes_of_like_ids_shrink():
    ids = np.random.default_rng(1).integers(0, 40000, 1 << 16).astype(np.uint32)
    assert len(idfile.write_chunk([1], [ids])) < 0.55 * ids.nbytes


@pytest.mark.parametrize("chunk_ids", [1 << 18, 20])
def test_contract_query(spark, tmp_path, monkeypatch, chunk_ids):
    monkeypatch.setattr(idfile, "CHUNK_IDS", chunk_ids)
    texts = [*EDGE_TEXTS, "\x1c odd", "İstanbul <|endoftext|>", *[f"text number {k} é" for k in range(40)]]
    df = documents(spark, texts).withColumn("start", F.lit("clash"))
    got = op9_token_id_files(spark, save(df, tmp_path, "documents")).orderBy("doc_id").collect()
    path, start = public.path("word_bpe_49k.json"), 0
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = np.array([*tokens.library_tokenizer(path).encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    path = public.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "b"), (5, "z"), (5, "a"), (-3, None)], "doc_id long, text string")
    idfile.write_ids(df, str(tmp_path / "x"), path, end_id=1)
    got = [(r.doc_id, r.start, r.n_tokens) for r in idfile.read_ids(spark, str(tmp_path / "x")).orderBy("start").collect()]
    assert got == [(None, 0, 2), (-3, 2, 1), (5, 3, 2), (5, 5, 2)]
    idfile.write_ids(df.limit(0), str(tmp_path / "y"), path)
    assert idfile.read_ids(spark, str(tmp_path / "y")).count() == 0


def test_texts_of_over_a_megabyte(spark, tmp_path):
    path, texts = public.path("word_bpe_49k.json"), ["many different words é " * 60_000, "ab" * 600_000, "short"]
    got = op9_token_id_files(spark, save(documents(spark, texts), tmp_path, "documents")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*tokens.library_tokenizer(path).encode(t, add_special_tokens=False).ids, 1], np.uint32)
        assert tuple(r)[2:] == (len(ids), zlib.crc32(ids.tobytes()))
