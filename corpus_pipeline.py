"""A pipeline for training text: five stages, each over all documents that the stage before it kept.

run(spark, sf_dir) applies STAGES to `documents`; each stage's result is written as Parquet in the shared folder and read
as the next stage's input. The first four stages return the columns of `documents`, whatever further columns it has; the last
adds the token ids. Every stage gives an empty table for an empty table.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import bpe, decontaminate, jaccard_join, secret_scan, toxicity
from opsloom.llm.common import Tables, scratch, table

TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity is TOXIC or more. Null and empty texts aren't toxic and stay, and so do rows without
    an id; rows are judged one by one, so repeated rows share their fate. A text of any length is scored whole."""
    score = scratch(docs, "_toxicity")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar, out_col=score).where(F.col(score) < TOXIC).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays. Null and empty texts are copies of nothing
    and stay. Rows that repeat an id share its fate: they stay if one of them is the document that stays. Rows without an id
    can't be told apart by one and stay."""
    named = jaccard_join.classes(docs.select("doc_id", "text"))
    stays = named.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of the benchmark. Null and empty texts hold none and stay. Rows that repeat an id
    share its fate: they go if one of them holds an item. Rows without an id are told apart by their text."""
    items = table(spark, sf_dir, "benchmark")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    kept = named.join(decontaminate.contaminated(named, items), "doc_id", "left_anti").select(docs.columns)
    return kept.unionByName(nameless.join(decontaminate.contaminated(nameless, items, id_col="text"), "text", "left_anti").select(docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row and masks the secrets in its text; n_chars, where there is one, follows the text. Null and empty texts
    stay as they are; rows are masked one by one, repeated ones alike."""
    secrets = scratch(docs, "_secrets")
    masked = secret_scan.scan(docs, out_col=secrets)
    spans = F.col(secrets)["spans"]
    masked = masked.withColumn("text", secret_scan.redact(F.col("text"), spans))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; the result has the ids as little-endian 32-bit integers and their number, and whether they
    decode to the text. Null and empty texts have no ids and decode to the empty text. Rows are encoded one by one. Where
    `docs` has a column of one of the three names, the new one is named with an underscore before it."""
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = scratch(docs, "_coded")
    found = bpe.encode_and_decode(docs, vocabulary, out_col=coded)
    ids = F.col(coded)["ids"]
    new = {"token_ids": ids, "n_tokens": (F.octet_length(ids) / 4).cast("long"), "round_trip": F.col(coded)["decoded"] == F.coalesce("text", F.lit(""))}
    return found.select(*docs.columns, *[c.alias(scratch(docs, name)) for name, c in new.items()])


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe", tokens),
]
ORACLE_SQL = None  # the learned scores of the first stage have no SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(*tables.held[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
