import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from flowlark.llm import licences
from flowlark.llm.common import Vocabulary
from flowlark.llm.queries import op13_license_scan

from .helpers import EDGE_TEXTS, documents, save

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """Every passage at every relative position of every text, word by word."""
    split = [words(t) for t in texts]
    n_docs = sum(bool(w) for w in split)
    weight = lambda v: 1 + math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(v in w for w in split) + 1)))
    memo, out = {}, []
    for label, text, keys in licences.PASSAGES:
        p = words(text)
        for v in p:
            memo.setdefault(v, max(1, weight(v)))
    for w in split:
        base, hits = [], []
        for label, phrase in licences.PHRASES:
            p = words(phrase)
            base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        for label, text, keys in licences.PASSAGES:
            p, total = words(text), sum(memo[v] for v in words(text))
            for start in range(1 - len(p), len(w)):
                same = [0 <= start + j < len(w) and w[start + j] == v for j, v in enumerate(p)]
                if 100 * sum(memo[v] for v, s in zip(p, same) if s) < licences.LEAST * total:
                    continue
                spans = [next(i for i in range(len(p)) if p[i : i + len(k)] == k) for k in map(words, keys)]
                if all(all(same[i : i + len(words(k))]) for i, k in zip(spans, keys)):
                    hits.append((label, sum(memo[v] for v, s in zip(p, same) if s) / total))
        labels = sorted({x for _, x in base} | {x for x, _ in hits})
        first, last = (min(base)[0], max(base)[0]) if base else (None, None)
        score = 1.0 if base else max((s for _, s in hits), default=0.0)
        out.append((len(w), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(labels), score))
    return out


def some_texts():
    r = random.Random(2)
    pool = ["the", "of", "lorem", "and", "license", "software", "this", "cc", "by", "4", "0", "public", "general", "mit", "GNU"]
    noise = lambda n: " ".join(r.choices(pool, k=n))
    texts = list(EDGE_TEXTS)
    for label, text, _ in licences.PASSAGES:
        w = text.split()
        hurt = list(w)
        for k in r.sample(range(len(w)), max(1, len(w) // 5)):
            hurt[k] = "other"
        texts += [noise(5) + " " + text.upper() + ". " + noise(5), " ".join(hurt), text[len(text) // 2 :], " ".join(w[: len(w) // 2] + ["inserted"] + w[len(w) // 2 :]), noise(60)]
    return [*texts, "MIT license, mit-LICENSE", "general public", "mit", "license mit license mit license", "Apache License\nGeneral Public License"]


def against(spark, tmp_path, texts):
    got = {r.doc_id: tuple(r)[1:] for r in op13_license_scan(spark, save(documents(spark, texts), tmp_path, "documents")).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][:6] == w[:6] and math.isclose(got[i][6], w[6], abs_tol=1e-12), (i, texts[i], got[i], w)
    return got


def test_against_brute_force(spark, tmp_path):
    got = against(spark, tmp_path, some_texts())
    found = {x for v in got.values() for x in v[5].split(",")}
    assert {label for label, _, _ in licences.PASSAGES} <= found


def test_notices_of_the_usual_forms(spark, tmp_path):
    texts = ["plain words of no licence", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "a licence is a permission", "cc by hand 4 0", *["the of and to in under this is"] * 30]
    got = against(spark, tmp_path, texts)
    assert [got[i][5] for i in range(6)] == ["", "cc-by-nc", "mit", "gpl", "", ""]
    assert got[1][6] == 1.0 and got[1][1] == 0 and got[4][6] == 0.0


def test_all_words_in_all_texts_empty_tables_repeated_ids_and_clashing_columns(spark):
    texts = ["mit license"] * 3
    df = documents(spark, texts).withColumn("hits", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("doc_id", F.lit(7).cast("long"))
    found = licences.scan(df, licences.build_index(df)).collect()
    assert [(r.doc_id, r.n_words, len(r.hits) > 0) for r in found] == [(7, 2, True)] * 3
    none = licences.scan(df.limit(0), licences.build_index(df.limit(0)))
    assert none.count() == 0 and set(none.columns) == {"doc_id", "lang", "source", "n_chars", "n_words", "hits"}


def test_texts_of_over_a_megabyte(spark):
    notice = "Licensed under CC BY-NC 4.0."
    texts = ["license " * 150_000 + notice, "z" * 1_200_000 + " " + notice]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in licences.scan(df, licences.build_index(df)).collect()}
    assert [[(h.label, h.start) for h in got[i].hits] for i in range(2)] == [[("cc-by-nc", 150_000)], [("cc-by-nc", 1)]]


def test_vocabulary_takes_no_other_word():
    known = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnopq", "ü".encode(), b""]
    vocabulary = Vocabulary(known)
    asked = [b"a", b"b", b"ab\0", b"abcdefgh", b"abcdefghi", b"abcdefghj", b"abcdefghijklmnopq", b"abcdefghijklmnopr", b"abcdefghijklmnopqr" * 9, "ü".encode()]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(x) for x in asked])
    for own in (vocabulary, Vocabulary(known)):
        found = own.find(data, ends - [len(x) for x in asked], ends).tolist()
        assert [own.words[k] if k >= 0 else None for k in found] == [x if x in known else None for x in asked]
        own.hashes, own.tries = np.zeros_like(own.hashes), len(own.hashes)  # as if all hashes were the same
        Vocabulary._hashes, kept = staticmethod(lambda loads, sizes: np.zeros(len(sizes), np.uint64)), Vocabulary._hashes
        try:
            found = own.find(data, ends - [len(x) for x in asked], ends).tolist()
        finally:
            Vocabulary._hashes = staticmethod(kept)
        assert [own.words[k] if k >= 0 else None for k in found] == [x if x in known else None for x in asked]
    none = Vocabulary([])
    assert none.find(data, ends - 1, ends).tolist() == [-1] * len(asked)
