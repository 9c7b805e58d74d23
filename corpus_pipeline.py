"""From raw documents to packed sequences, in five stages of the corpus operators.

Each stage takes what the one before it kept, all of it, and returns the columns of documents; the
last returns the pieces of packed sequences.

In every stage null texts count as empty and null ids keep their row; an empty table gives an empty
table; texts of any length are read whole; other columns of documents, whatever their names, come out
as they went in. Repeated rows each get their row, but where one of a group stays. A text that isn't
changed stays null or empty as it was.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spantail.llm import credentials, decontaminate, native, nearcopies, packing, toxicity
from spantail.llm.common import table, written


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, and the other columns in one: no name of theirs can meet one of an operator's."""
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("boxed"))


def _unboxed(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs again; with another text, n_chars follows it where it changed."""
    if text is None:
        return found.select(*[F.col("text") if c == "text" else F.col(f"boxed.`{c}`") for c in docs.columns])
    both = found.select("boxed", F.col("text").alias("old"), text.alias("text"))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("old").eqNullSafe(F.col("text")), F.col("boxed.n_chars")).otherwise(size)
    return both.select(*[F.col("text") if c == "text" else changed.alias(c) if c == "n_chars" else F.col(f"boxed.`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels scores 0.5 or more go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _unboxed(toxicity.toxicity(_boxed(docs), model, keep=["text", "boxed"]).where("score < 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of their five-word shingles the document of the smallest id stays."""
    return _unboxed(nearcopies.one_of_each(_boxed(docs)), docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document goes if no word is left of it."""
    found = decontaminate.contamination(_boxed(docs), table(spark, sf_dir, "benchmark"), keep=["text", "boxed"])
    left = native.cut(F.col("text"), F.col("char_spans"), "\n")
    some = left.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return _unboxed(found.where((F.size("char_spans") == 0) | some), docs, left)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced; widely copied examples stay."""
    found = credentials.secrets(_boxed(docs), keep=["text", "boxed"])
    return _unboxed(found, docs, credentials.without_live_text("text", "spans"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmarks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned scores, XXH64 and a tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
