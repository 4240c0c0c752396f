"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that the one before it left and returns documents, the
last one what it read back from the token files. Stages are written as Parquet and read
again in between, so none repeats another's work and a lost executor costs one stage's
tasks at most.

1. language_id: texts without any letter to tell a language by go.
2. near_duplicates: of each group of SimHash near-duplicates the smallest doc_id stays.
3. decontamination: documents with a passage of a benchmark item go.
4. mixing: documents are repeated, or left out, as the sources' target weights ask;
   the one at the end of a source's share is cut after the words taken.
5. token_ids: wavelet matrix files of the token ids; returned as doc_id, start,
   n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlens.llm import decontam, langid, mixing, simhash, tokens
from idlens.llm.common import PLAIN_WORD, words
from idlens.llm.queries import tokenizer_path
from idlens.session import scratch_path

#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*" + PLAIN_WORD
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; repeated rows and null ids stay; without any
    labelled row, and from an empty table, nothing is left."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group its smallest document by id, then by hash of the text; of equal rows one.
    Rows without an id can't be named and stay. All null and empty texts are one group."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of an item go; null texts hold none. Decided row by row,
    whatever the ids."""
    return decontam.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken whole, and one with its first words, spaced as
    they were, for the rest. Documents without words are never taken; null sources are a
    source; repeated rows are documents each."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    left = F.when(size > 0, taken % size).otherwise(0).cast("int")
    takes = F.concat(F.array_repeat(F.lit(0), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("_cut", F.explode(takes))
    cut = F.array_join(F.slice(words(F.col("text"), SPACED_WORD), 1, F.col("_cut")), "")
    rows = rows.withColumn("_text", F.when(F.col("_cut") > 0, cut).otherwise(F.col("text")))
    n_chars = F.when(F.col("_cut") > 0, F.char_length("_text")).otherwise(F.col("n_chars")).cast("bigint")
    return rows.select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By ascending id, null first, then by text; a null or empty text is its end id alone."""
    return tokens.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]

#: Trained classifiers, XXH64 and the tokenizer have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
