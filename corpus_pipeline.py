"""A training corpus from `documents`: language ID, near-dedup, decontamination, PII and tokens.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the
columns of documents; the last returns tokens. A stage's result must be written before the next stage is called, which
deletes the tables that the result was read from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.llm import bpe, decontam, langid, minhash, pii
from tracemill.llm.shared import release, stage, unstage

#: Least share of a document's letters in its language; documents below, and those without a letter, go.
LANGUAGE_SHARE = 0.5
SHINGLE_WORDS = 5


def whole(docs):
    """docs as a struct of each row beside its text."""
    return docs.select(F.struct("*").alias("row"), "text")


def language_id(spark, docs, sf_dir):
    """Drop documents of no dominant language; a null lang is filled by the prediction.

    Null texts and texts without a letter are of no language and go. Repeated rows are judged alike; an empty table stays empty.
    """
    release()
    found = langid.identify(whole(docs), langid.learn_languages(docs), id_col="row")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*(F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def near_dedup(spark, docs, sf_dir):
    """Keep one document, that of the smallest id, of each group of near copies.

    Null texts and texts without a word have no copies and stay. Of equal rows, or of groups without an id, one row stays.
    """
    release()
    return minhash.unique_rows(docs, shingle=SHINGLE_WORDS)


def decontamination(spark, docs, sf_dir):
    """Drop documents that hold a benchmark window. Null and empty texts hold none and stay, as does every row beside an empty benchmark; repeated rows are judged alike."""
    release()
    found = decontam.find_benchmark(whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return found.where(F.size("spans") == 0).select("id.*")


def personal_data(spark, docs, sf_dir):
    """Replace personal data by its kind in angle brackets; n_chars follows. A null text stays null, with its n_chars null; repeated rows stay, an empty table stays empty."""
    release()
    found = pii.find_pii(docs, keep_rows=True).withColumn("clean", F.when(F.size("spans") > 0, F.expr(pii.redact("row.text", "spans"))).otherwise(F.col("row.text")))
    new = {"text": F.col("clean").alias("text"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def tokens(spark, docs, sf_dir):
    """Token ids of each document, with hashes of the ids and of what they decode to. A null or empty text has no ids, and the hash of nothing; repeated rows stay, an empty table stays empty."""
    release()
    decoded = bpe.encode(docs, decoded=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("byte_bpe", tokens)]

#: Language model, minima and tokens have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        before, docs = docs, stage(f(spark, docs, sf_dir), name)
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
