"""The contract queries of the corpus operators: each derives its digest columns from its operator's own output."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, idfile, langid, lexical, licences, minhash, oracles, packing, quality, repeats, toxicity
from .common import crc_mod, fresh_path, light_workers, read
from .tokens import public


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from the labelled rows outside the held-out third; a document labelled twice counts as toxic if any label is."""
    known = labels.where((crc_mod("doc_id", 3) != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return toxicity.fit(docs.where(crc_mod("doc_id", 3) != 1), known)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def _digests(t: bpe.Tables, ids: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """n_tokens, the digest of the decimal ids, and the digest of what decoding gives back."""
    decimals, at = bpe.gather(t.decimals, t.decimal_offsets, ids)
    data, cut = bpe.decode_bytes(t, ids)
    at, cut, n = at[starts], cut[starts], len(starts) - 1
    coded = [hashlib.sha256(decimals[at[k] : max(at[k], at[k + 1] - 1)]).hexdigest() for k in range(n)]
    texts = (data[cut[k] : cut[k + 1]].tobytes().decode("utf-8", "replace") for k in range(n))
    back = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    return [pa.array(np.diff(starts)), pa.array(coded, pa.string()), pa.array(back, pa.string())]


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.map_encoded(docs, public("byte_bpe_50k.json"), _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"), public("byte_bpe_50k.json"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def _kept_digests(rows: pa.RecordBatch, kept: list[bytes], n_words: np.ndarray, n_removed: np.ndarray) -> list[pa.Array]:
    return [rows.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_runs(docs, repeats.repeated_runs(docs, 20), _kept_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(planted).alias("text"),
    )
    done = chat.format_reply_trees(chat.linear_tree(turns.unionByName(extra)))
    back = done.withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    idfile.write_ids(read(spark, sf_dir, "documents"), path, public("word_bpe_49k.json"), end_id=1)
    return idfile.read_ids(spark, path, idfile.crc32s, "ids_crc32 long")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.build_index(docs))
    base = F.filter("hits", lambda x: x["phrase"])
    starts = F.transform(base, lambda x: x["start"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def _light(query):
    """The query, in a session whose Python workers are kept small."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        light_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _light(f)
    for f in (
        op1_language_id, op2_toxicity, op3_bpe, op4_packing, op5_minhash_dedup, op6_substring_dedup, op7_chat_formatting,
        op8_nearest_neighbours, op9_token_id_files, op10_quality_rules, op11_filter_audit, op12_lexical_search, op13_license_scan,
    )
}
ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
