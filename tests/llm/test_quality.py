from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlark.llm import quality
from flowlark.llm.queries import op10_quality_rules

from .helpers import EDGE_TEXTS, WORD, documents, save


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    out = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


def rows_of(spark, tmp_path, texts):
    folder = save(documents(spark, texts), tmp_path, "documents")
    got = {r.doc_id: r for r in op10_quality_rules(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:7] == brute(t), repr(t)[:80]
        assert not (got[i].kept and got[i].base_failed)
    return got


def test_statistics_match_brute_force(spark, tmp_path):
    repeated = "a b c d e f a b c d e g a b c d e"
    rows_of(spark, tmp_path, [*EDGE_TEXTS[:6], "x " * 40, *EDGE_TEXTS[7:], repeated, "a a a a a a a", "p q r s t p q r s t"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n#"), max_size=60), min_size=1, max_size=30))
def test_random_texts(spark, tmp_path_factory, texts):
    rows_of(spark, tmp_path_factory.mktemp("q"), texts)


def test_ordinary_prose_is_kept_and_symbol_noise_is_not(spark, tmp_path):
    prose = "the cat sat on the mat and it was a very good day for all of us in the house"
    got = rows_of(spark, tmp_path, [prose, "#### $$$$ |||| <<<< >>>> **** #### &&&& %%%% $#$# ||<> the"])
    assert got[0].kept and not got[1].kept


def test_empty_table_and_clashing_columns(spark, tmp_path):
    df = documents(spark, ["the a of in to"]).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(3))
    row = quality.quality_rules(df).first()
    assert row.n_words == 5 and row.kept is False
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_texts_of_over_a_megabyte_and_repeated_ids(spark, tmp_path):
    lines = "\n".join(f"w{k} x{k} y{k} the {k}" for k in range(60_000))
    texts = [lines, "z" * 1_200_000]
    df = documents(spark, texts)
    got = op10_quality_rules(spark, save(df.union(df.where("doc_id = 1")), tmp_path, "documents")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 1]
    for r in got:
        w, lines_of = WORD.findall(texts[r.doc_id]), texts[r.doc_id].split("\n")
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), 0, len(lines_of) - len(set(lines_of)), 0)
