"""A corpus pipeline: toxicity, language ID, near-duplicates, repeated passages, packing.

Each stage gets all documents that its predecessor kept, and all but the last return the columns of ``documents``.
Filters test rows where they are; texts are shuffled only where they may have to meet something.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlark.llm import langid, minhash, packing, repeats, toxicity
from flowlark.llm.common import crc_mod, distinct_ids_filter, fresh_path, light_workers, read, scratch, stored, without_ids
from flowlark.llm.queries import toxicity_model
from flowlark.llm.tokens import public

#: A document stays if its language's share is at least this.
LEAST_SHARE = 0.5
#: Words in a row that must not occur twice in the corpus, as in the operator's own query.
REPEAT_WORDS = 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more. Null and empty texts get the bias' score, long ones are scored whole;
    rows that repeat an id or a text are judged each by its text; an empty table stays empty."""
    light_workers(spark)
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return docs.select(COLUMNS).where(toxicity.score_column(spark, model, F.col("text")) < toxicity.THRESHOLD)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter (null and empty ones too), and those that are no learnt language's more than all
    others'. Long texts are read whole, repeated rows are judged each by its text; an empty table stays empty."""
    light_workers(spark)
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return docs.select(COLUMNS).where(langid.share_column(spark, model, F.col("text")) >= LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, and one row of those that repeat an id and its text.
    Wordless texts and rows without an id stay, long texts are compared whole; an empty table stays empty."""
    light_workers(spark)
    docs = docs.select(COLUMNS)
    found = stored(minhash.near_duplicates(docs, size=5, percent=80), "near-duplicates")
    kept = without_ids(docs, found.where("not kept").select("doc_id").distinct())
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    may = F.coalesce(distinct_ids_filter(again, "doc_id")(F.col("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull()
    copy = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars"))
    return kept.where(~may).unionByName(kept.where(may).withColumn("copy", copy).where("copy = 1").drop("copy"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier in the corpus; texts without such passages stay as they are, null and
    empty ones too, and so do rows without an id. Long texts are searched whole. Rows that repeat an id are one document
    where their texts agree; an empty table stays empty."""
    light_workers(spark)

    def rewritten(rows, kept, n_words, n_removed):
        texts = [x.decode() if gone else text for x, gone, text in zip(kept, n_removed.tolist(), rows.column("text").to_pylist(), strict=True)]
        sizes = [len(x) if gone else n for x, gone, n in zip(texts, n_removed.tolist(), rows.column("n_chars").to_pylist(), strict=True)]
        return [rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("lang"), rows.column("source"), pa.array(sizes, pa.int64())]

    docs = docs.select(COLUMNS)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return repeats.without_runs(docs, repeats.repeated_runs(docs, REPEAT_WORDS), rewritten, schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in windows of 2048 tokens. Null and empty texts are an end id alone, long texts fill
    windows of their own, rows that repeat an id are packed each; an empty table gives no pieces."""
    light_workers(spark)
    return packing.pack(docs, public("byte_bpe_50k.tiktoken"), public("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's result is a table in the shared folder that the next one reads, and what
    a stage stored on its way is deleted when its result is there.

    Null, empty and very long texts, rows that repeat an id, and an empty table are each stage's matter, see there; an
    empty table of documents gives no pieces. Columns of ``documents`` beyond its own are not read.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first two stages are learnt models, which SQL doesn't express; the tests hold the others against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
