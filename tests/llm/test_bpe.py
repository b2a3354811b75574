import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlark.llm import bpe, tokens
from flowlark.llm.queries import op3_bpe

from .helpers import EDGE_TEXTS, documents, save, sha

public = pytest.importorskip("public_tokenizers")
PATH, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
MANY = "abc  \n\t\x1c\x85　  éßñÀĳİΣ😀́中文ⅷ²٣ the ing 's'll 12.,!_<|endoftext|>"


def library(path, text):
    return tokens.library_tokenizer(path).encode(text or "", add_special_tokens=False).ids


def same(text):
    got = np.frombuffer(bpe.tables(PATH).encode(text), np.uint32).tolist()
    assert got == library(PATH, text)
    assert tokens.rank_ids(public.path("byte_bpe_50k.tiktoken"), PATH, text).tolist() == got
    assert np.frombuffer(tokens.white_space_ids(WORDS, text), np.uint32).tolist() == library(WORDS, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(MANY), max_size=40))
def test_ids_are_the_librarys(text):
    same(text)


@pytest.mark.parametrize("text", ["a" * 20000, " " * 20000, "ab" * 9000, "\n" * 999, "😀" * 700, "<|endoftext|>x<|endoftext|>", "x <|endoftext|"])
def test_long_runs_and_specials(text):
    same(text)


def test_every_token_encodes_to_itself():
    t = bpe.tables(PATH)
    assert all(t.encode_piece(s) == [k] for k, s in enumerate(t.text))


LATIN = [chr(c) for c in range(256)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([*LATIN, *"''''sstmdrevell  aA1!", "’", "İ"]), max_size=30) | st.sampled_from([" ", "<|endoftext|> a", "it's", "'ll'd!'s"]), max_size=6))
def test_ids_of_several_texts_are_the_librarys(texts):
    assert [x.tolist() for x in tokens.white_space_ids_of(WORDS, texts)] == [library(WORDS, x) for x in texts]


def test_every_pair_of_latin_characters():
    plain = [c for c in LATIN if not "\x1c" <= c <= "\x1f"]
    texts = [a + "".join(b + a for b in plain if {a, b} != {"<", "|"}) for a in plain]
    assert all(tokens._plain(x) is not None for x in texts)
    assert [x.tolist() for x in tokens.white_space_ids_of(WORDS, texts)] == [library(WORDS, x) for x in texts]


def test_a_part_is_encoded_once_for_many_texts(monkeypatch):
    encode, seen = tokens._part_encoder(WORDS), []

    def counting(parts, starts):
        seen.extend(parts.tobytes().decode("latin-1").split(" "))
        return encode(parts, starts)

    monkeypatch.setattr(tokens, "_part_encoder", lambda path: counting)
    texts = [f"Words, wörds{mark} {word}'s words" for mark in ",.;:!?" for word in ("one", "two", "Words")] * 50
    assert [x.tolist() for x in tokens.white_space_ids_of(WORDS, texts)] == [library(WORDS, x) for x in texts]
    assert sorted(seen) == sorted({"words", "wörds", "one", "two", "'s", *",.;:!?"})


@pytest.mark.parametrize("change", ["no suffix", "other pattern"])
def test_files_of_another_kind_give_the_librarys_ids_too(tmp_path, change):
    spec = tokens.load(WORDS)
    if change == "no suffix":
        spec["model"]["end_of_word_suffix"] = None
    else:
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|[^\s\p{L}]+"
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["It's a text of 1999, isn't it?", "", "Écoute </w> ça"]
    assert [x.tolist() for x in tokens.white_space_ids_of(path, texts)] == [library(path, x) for x in texts]


def test_remembering_forgets_but_stays_right():
    r = tokens.Remembering(lambda new: {x: x.encode() for x in new}, most=3)
    for _ in range(3):
        for k in range(20):
            assert r([f"a{k}", f"a{k + 1}", "z"]) == f"a{k}a{k + 1}z".encode()
    assert len(r.young) <= 6


def test_contract_query(spark, tmp_path):
    texts = [*EDGE_TEXTS, "<|endoftext|> in a text", "same", "same"]
    got = {r.doc_id: r for r in op3_bpe(spark, save(documents(spark, texts).withColumn("ids", F.lit("clash")), tmp_path, "documents")).collect()}
    tok = tokens.library_tokenizer(PATH)
    for i, t in enumerate(texts):
        ids = library(PATH, t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_encode_decode_frames(spark):
    df = documents(spark, EDGE_TEXTS)
    ids = bpe.encode(df, PATH)
    back = {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(EDGE_TEXTS)}
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_texts_of_over_a_megabyte_and_repeated_ids(spark):
    texts = ["many different words é " * 60_000, "ab" * 600_000]
    df = documents(spark, [*texts, texts[0]]).withColumn("doc_id", F.least("doc_id", F.lit(1)))
    got = {(r.doc_id, sha(r.text)) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert got == {(0, sha(texts[0])), (1, sha(texts[1])), (1, sha(texts[0]))}
