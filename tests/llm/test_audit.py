import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlark.llm import audit
from flowlark.llm.common import utf8, words
from flowlark.llm.queries import op11_filter_audit

from .helpers import EDGE_TEXTS, WORD, save

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: doc_id -> (quality = 1, toxic = 1)."""
    masks = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        failed["E"] = i is not None and any(j is not None and j < i and (other or "") == t for j, other, _ in rows)
        masks.append((source or "", failed, *labels.get(i, (False, False))))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                kept = [m for m in mine if not any(m[1][y] for y in order[: k + 1])]
                here = [m for m in mine if m[1][x] and not any(m[1][y] for y in order[:k])]
                late = [m for m in mine if m[1][x] and any(m[1][y] for y in order[:k])]
                alone = [m for m in mine if m[1][x] and sum(m[1].values()) == 1]
                out[part, "".join(order), k + 1] = [len(kept), len(here), len(late), len(alone), sum(m[2] for m in here), sum(m[3] for m in here)]
        for x in "ABCDE":
            total = sum(v[1] for (p, order, k), v in out.items() if p == part and order[k - 1] == x)
            for (p, order, k), v in out.items():
                if p == part and order[k - 1] == x:
                    v.append(total)
    return out


def same(got, want):
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in got}
    assert got == want


def some_rows():
    r = random.Random(3)
    prose = lambda n, few=10**6: " ".join(f"w{r.randint(0, few)}" for _ in range(n))
    texts = [*EDGE_TEXTS, prose(250), prose(250, 40), prose(300) + " $", "AB " * 210, prose(220) + " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRST", "x " * 3000, prose(250), "ä " * 201]
    texts += [r.choice(texts) for _ in range(30)]
    rows = [(i, t, r.choice(["s1", "s2", None, "", "s'3"])) for i, t in enumerate(texts)]
    return [*rows, rows[14], (3, "same id, other text", "s1"), (None, texts[13], "s1"), (None, None, None)]


def test_against_brute_force(spark, tmp_path):
    rows = some_rows()
    folder = save(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS), tmp_path, "documents")
    labels = [(i, i % 3 if i % 7 else None, int(i % 4 == 0)) for i in range(0, 40)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (999, 1, 1)]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    known = {}
    for i, q, t in labels:
        if i is not None:
            a, b = known.get(i, (False, False))
            known[i] = a or q == 1, b or t == 1
    same(op11_filter_audit(spark, folder).collect(), brute(rows, known))


def test_empty_tables_other_filters_and_clashing_columns(spark):
    rows = some_rows()
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("n_words", "mask", "digest", "part", "id", "good", "earliest")})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(audit.audit(df, none).collect(), brute(rows, {}))
    assert audit.audit(df.limit(0), none).count() == 0
    two = audit.audit(df, none, {"X": "n_chars = 0", "Y": audit.COPY}).where("part = 's1'").collect()
    assert {(r.filter_order, r.step) for r in two} == {("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2)}


def distinct(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, first = words(data, offsets)
    return audit.distinct_words(data, starts, ends, first).tolist()


def test_distinct_words_are_confirmed_on_the_bytes(monkeypatch):
    long = "a" * 100
    texts = ["a b a", "", "a", f"{long}x {long}y {long}x", "abcdefgh abcdefgi abcdefgh1 abcdefgh", "b a b", *EDGE_TEXTS]
    want = [len(set(WORD.findall(t or ""))) for t in texts]
    assert distinct(texts) == want
    monkeypatch.setattr(audit, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert distinct(texts) == want


def test_texts_of_over_a_megabyte(spark):
    texts = ["word " * 300_000, " ".join(f"w{k}" for k in range(250_000)), "Z" * 1_200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in audit.statistics(df, ["doc_id"]).collect()}
    assert [got[i].n_words for i in range(3)] == [300_000, 250_000, 1] and [got[i].n_distinct for i in range(3)] == [1, 250_000, 1]
    assert [got[i].n_capitals for i in range(3)] == [0, 0, 1_200_000] and [got[i].n_chars for i in range(3)] == [len(t) for t in texts]
