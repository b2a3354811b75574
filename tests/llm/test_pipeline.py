import pytest
from pyspark.sql import functions as F

from flowlark.llm import langid, toxicity
from flowlark.llm.common import read

from .helpers import EDGE_TEXTS, save
from .test_langid import SYLLABLES, table, texts_of
from .test_minhash import brute as near
from .test_packing import well_packed
from .test_toxicity import corpus

cp = pytest.importorskip("corpus_pipeline")
WORDS = cp.REPEAT_WORDS


def without_repeats(texts):
    from .helpers import WORD

    seen, out = set(), []
    for t in texts:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - WORDS + 1):
            window = tuple(w[k : k + WORDS])
            if window in seen:
                gone.update(range(k, k + WORDS))
            seen.add(window)
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone) if gone else t)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    passage = texts_of("en", 1, 77, 80)[0] + " " + " ".join(texts_of("en", 3, 78, 60))
    labelled = corpus(240)
    clean = [t for t, y in labelled if not y]
    rows = [(t, "en") for t, _ in labelled] + [(t, lang) for lang in SYLLABLES for t in texts_of(lang, 40, 6)]
    rows += [(t, "en") for t in (clean[5], clean[7] + " the the", clean[9] + " " + passage, passage + " " + clean[11], "123 456 !!!")] + [(t, None) for t in EDGE_TEXTS]
    docs = table(spark, rows)
    folder = save(docs, tmp_path, "documents")
    save(spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(labelled)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    frames, at = [docs], docs
    for name, stage in cp.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        frames.append(at)
    kept = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    assert all(f.columns == docs.columns for f in frames[:-1])
    tox = {r.doc_id: r.predicted for r in toxicity.score(docs, cp.toxicity_model(docs, read(spark, folder, "labels"))).collect()}
    assert kept[1] == {i: t for i, (t, _) in enumerate(rows) if not tox[i]}
    assert sum(y == tox[i] for i, (_, y) in enumerate(labelled)) >= 0.97 * len(labelled)
    langs = {r.doc_id: r for r in langid.identify(frames[1], langid.fit(frames[1].where(cp.crc_mod("doc_id", 4) != 2))).collect()}
    assert kept[2] == {i: t for i, t in kept[1].items() if langs[i].lang_pred != "und" and langs[i].score >= 0.5}
    order = sorted(kept[2])
    groups = near([kept[2][i] for i in order], size=5)
    assert kept[3] == {i: kept[2][i] for k, i in enumerate(order) if groups[k][2]}
    assert len(kept[3]) < len(kept[2])
    order = sorted(kept[3])
    assert kept[4] == dict(zip(order, without_repeats([kept[3][i] for i in order]), strict=True))
    assert kept[4] != kept[3]
    assert well_packed(frames[-1].collect(), kept[4]) == 0
    whole = cp.run(spark, folder)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in frames[-1].collect()}


def test_empty_tables(spark, tmp_path):
    folder = save(table(spark, [("x", "en")]).limit(0), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert cp.run(spark, folder).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = table(spark, [("a b c d e f g", "en"), ("other words than those", "en")])
    odd = df.union(df).union(df.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").where("lang = 'en'").limit(1))
    got = cp.drop_near_duplicates(spark, odd, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "1", "None"]


def test_extra_columns_long_texts_and_repeated_rows(spark, tmp_path):
    """Columns of the operators' own names take no part; copies of a row are one document after the third stage."""
    labelled = corpus(120)
    long = " ".join(texts_of("en", 5000, 55))
    assert len(long) > 1_000_000
    docs = table(spark, [(t, "en") for t, _ in labelled] + [(long, "en")])
    docs = docs.union(docs.where("doc_id >= 110"))
    for c in ("score", "kept", "n_words", "start", "runs", "component_id", "lang_pred"):
        docs = docs.withColumn(c, F.lit("clash"))
    folder = save(docs, tmp_path, "documents")
    save(spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(labelled)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    at, counts = docs, []
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, folder)
        at.write.parquet(f"{tmp_path}/{name}.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert at.columns == cp.COLUMNS
        counts.append({r.doc_id: r["count"] for r in at.groupBy("doc_id").count().collect()})
    fair = {i for i, (_, y) in enumerate(labelled) if not y}
    assert len(fair - counts[0].keys()) <= 1 and all(counts[0][i] == 1 + (i >= 110) for i in counts[0])
    assert counts[1][120] == 2 and set(counts[2].values()) == {1} and counts[3].keys() == counts[2].keys()
    kept = {r.doc_id: r.text for r in at.collect()}
    assert kept[120] == long
    assert well_packed(cp.STAGES[-1][1](spark, at, folder).collect(), kept) == 0
