import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import langid
from flowlark.llm.queries import op1_language_id

from .helpers import EDGE_TEXTS, save

SYLLABLES = {"en": ["the", "ing", "ou", "er", "sh"], "de": ["sch", "ung", "ei", "ß", "ach"], "fr": ["eau", "é", "que", "oi", "è"], "es": ["ción", "ñ", "ll", "os", "ar"]}


def texts_of(lang, n, seed, longest=80):
    r = random.Random(f"{lang}{seed}")
    word = lambda: "".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3)))
    return [" ".join(word() for _ in range(r.randint(5, longest))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rows = [(t, lang) for lang in SYLLABLES for t in texts_of(lang, 60, 1)] + [(t, None) for t in EDGE_TEXTS] + [("12345 !!! 678", "en")]
    got = {r.doc_id: r for r in op1_language_id(spark, save(table(spark, rows), tmp_path, "documents")).collect()}
    assert len(got) == len(rows)
    for i, (text, lang) in enumerate(rows):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in SYLLABLES
    held = [(got[i].lang_pred, lang) for i, (t, lang) in enumerate(rows) if got[i].held_out and lang and i < 240]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_ambiguous_mixture_and_clashing_columns(spark):
    rows = [(t, lang) for lang in ("en", "de") for t in texts_of(lang, 40, 2)]
    model = langid.fit(table(spark, rows))
    both = texts_of("en", 1, 3, 6)[0] + " " + texts_of("de", 1, 3, 6)[0]
    df = table(spark, [(both, "x"), (rows[0][0], "x"), (rows[0][0], "x")]).withColumn("score", F.lit("clash"))
    got = langid.identify(df, model).collect()
    assert not got[1].ambiguous and got[1][1:] == got[2][1:]
    assert langid.identify(df.limit(0), model).count() == 0


def test_no_language_and_one_language(spark):
    df = table(spark, [("some words", None), (None, None)])
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()} == {"und"}
    one = langid.fit(table(spark, [("some words", "en")]))
    assert [(r.lang_pred, r.score) for r in langid.identify(df, one).orderBy("score").collect()] == [("und", 0.0), ("en", 1.0)]


def test_codewords_differ_and_columns_split():
    for n in (2, 3, 4, 6, 7, 12, 30):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_accuracies_count_every_training_row(spark):
    r = np.random.default_rng(4)
    texts = [(" ".join("".join(r.choice(list(letters), 4)) for _ in range(3)), lang) for letters, lang in (("abcdef", "x"), ("bcdefg", "y"), ("cdefgh", "z")) for _ in range(60)]
    copies = [4000 if k == 0 else 45 for k in range(len(texts))]
    model = langid.fit(table(spark, [t for t, n in zip(texts, copies) for _ in range(n)]))
    margins, known = langid._margins([t for t, _ in texts], model)
    rate = np.empty(model.code.shape)
    for k, lang in enumerate(model.langs):
        mine = np.array([x == lang for _, x in texts])
        n = np.array(copies)[mine][:, None]
        rate[k] = ((margins[mine] * model.code[k] > 0) * n).sum(axis=0) + 1
        rate[k] /= n.sum() + 2
    assert known.all() and np.allclose(model.trust, rate / rate.sum(axis=1, keepdims=True))


def brute_trigrams(text):
    """The hashes of a text's trigrams around a letter, symbol by symbol."""
    codes = [0, *(ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in (text or "").lower()), 0]
    out = []
    for at in range(1, len(codes) - 1):
        if codes[at]:
            h = langid.WIDTH * 0x9E3779B1 & 0xFFFFFFFF
            for c in codes[at - 1 : at + 2]:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
            out.append((h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - langid.BITS))
    return out


def brute_margins(text, weights):
    found = brute_trigrams(text)
    return [sum(w.get(h, w[None]) for h in found) / math.sqrt(len(found)) if found else 0.0 for w in weights]


def brute_fit(rows, code):
    """Each bit's weights by bucket (None: a bucket seen nowhere), and each language's trust in the bits, from plain counts."""
    langs = sorted({lang for _, lang in rows})
    counts = {lang: Counter(h for t, own in rows if own == lang for h in brute_trigrams(t)) for lang in langs}
    sizes = {lang: sum(c.values()) + 0.5 * 2**langid.BITS for lang, c in counts.items()}
    seen = {h for c in counts.values() for h in c}

    def side(h, bit, sign):
        own = [(counts[lang][h] + 0.5) / sizes[lang] for lang, word in zip(langs, code, strict=True) if word[bit] == sign]
        return sum(own) / len(own)

    weights = [{h: math.log(side(h, bit, 1)) - math.log(side(h, bit, -1)) for h in [*seen, None]} for bit in range(len(code[0]))]
    trust = []
    for lang, word in zip(langs, code, strict=True):
        margins = [brute_margins(t, weights) for t, own in rows if own == lang and brute_trigrams(t)]
        rate = [(sum(m[bit] * word[bit] > 0 for m in margins) + 1) / (len(margins) + 2) for bit in range(len(word))]
        trust.append([x / sum(rate) for x in rate])
    return langs, weights, trust


def brute_shares(text, code, weights, trust):
    z = [min(30.0, max(-30.0, m)) for m in brute_margins(text, weights)]
    loss = [sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(z, word, own, strict=True)) for word, own in zip(code, trust, strict=True)]
    total = sum(math.exp(-x) for x in loss)
    return [math.exp(-x) / total for x in loss]


@pytest.mark.parametrize("n", [4, 9])
def test_predictions_are_those_of_plain_python(spark, n):
    """Counts, weights, trust, margins and decoding of every row, with few languages (all splits) and with many (a dense code)."""
    r = random.Random(n)
    speech = {f"l{k}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäéß", k=3)) for _ in range(12)] for k in range(n)}
    say = lambda lang, words: " ".join("".join(r.choices(speech[lang], k=2)) for _ in range(words))
    rows = [(say(lang, r.randint(3, 25)), lang) for lang in speech for _ in range(20)]
    rows += [(rows[0][0], "l1")] * 2 + [("12 !", "l2"), ("", "l0")]
    code = langid.codewords(n).tolist()
    model = langid.fit(table(spark, [*rows, (None, "l3"), ("no language", None)]))
    langs, weights, trust = brute_fit(rows, code)
    assert model.langs == langs and model.code.tolist() == code and np.allclose(model.trust, trust)
    for bit, w in enumerate(weights):
        assert np.allclose(model.weights[[h for h in w if h is not None], bit], [v for h, v in w.items() if h is not None], atol=1e-5)
    texts = [t for t, _ in rows] + EDGE_TEXTS + [say("l1", 3) + " " + say("l2", 3), "unseen ЖЖЖ", say("l0", 1) * 200_000]
    got = {x.doc_id: x for x in langid.identify(table(spark, [(t, None) for t in texts]), model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        x = got[i]
        if not brute_trigrams(text):
            assert (x.lang_pred, x.score, x.ambiguous) == ("und", 0.0, False)
            continue
        shares = dict(zip(langs, brute_shares(text, code, weights, trust), strict=True))
        top, second = sorted(shares.values(), reverse=True)[:2]
        assert abs(x.score - top) < 1e-4 and abs(shares[x.lang_pred] - top) < 1e-4 and abs(shares[x.runner_up] - second) < 1e-4
        assert x.ambiguous == (top - second < langid.AMBIGUOUS) or abs(top - second - langid.AMBIGUOUS) < 1e-4


def test_texts_of_over_a_megabyte_and_repeated_ids(spark):
    rows = [(t, lang) for lang in ("en", "de") for t in texts_of(lang, 40, 2)]
    model = langid.fit(table(spark, rows))
    whole = " ".join(texts_of("en", 200, 5)) + " " + " ".join(texts_of("de", 5000, 6))
    assert len(whole) > 1_000_000
    df = table(spark, [(whole, None), ("9" * 1_200_000, None), (rows[0][0], None)]).withColumn("doc_id", F.lit(7).cast("long"))
    got = sorted((r.lang_pred, r.doc_id) for r in langid.identify(df, model).collect())
    assert got == [("de", 7), ("en", 7), ("und", 7)]
