"""A training corpus from raw documents, in stages that each read what the one before wrote.

Documents scored toxic go, one document of each near-duplicate group stays, passages
that other documents repeat are cut, secrets are masked, and what is left is packed
into training sequences. Only stages that decide on documents drop any: clean ones stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import jaccard, packing, secrets, substrings, toxicity
from stockweave.llm.batches import read, saved, tokenizer_path
from stockweave.llm.queries import training_rows

#: Neither the model nor the hash partitions can be stated in SQL.
ORACLE_SQL: str | None = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below toxicity.TOXIC (the decision of op8), by a model fitted on the labelled rows that aren't held out.

    Null and empty texts score as one without words. Repeated rows and rows with a null id are scored each; an empty table gives no rows.
    """
    model = toxicity.fit(training_rows(docs, read(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model, keep=True).where(F.col("toxicity") < toxicity.TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets: that of the least doc_id.

    Of repeated rows of an id the least by text, then by the other columns, stays (null first). Rows with a
    null id all stay, as do null and empty texts, which are linked with nothing.
    """
    groups = jaccard.jaccard_groups(docs, k=5, percent=80).select("doc_id", "component_id").distinct()
    kept = groups.where("doc_id = component_id").select("doc_id")
    rows = docs.where("doc_id is not null").join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("first")).select("doc_id", "first.*")
    return first.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the paragraphs and runs of words that a document of a lower id keeps.

    Rows with a null id or text stay as they are; a text that is cut whole becomes empty.
    """
    repeats = substrings.repeated_paragraphs(docs)
    cut = substrings.without_repeats(docs, repeats)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask; a null text becomes empty."""
    found = secrets.scan_secrets(docs, keep=COLUMNS)
    masked = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; an empty text is its end token alone."""
    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written to the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
