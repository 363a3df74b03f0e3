"""A corpus pipeline of five stages over the operators of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as a table in the
shared folder and reads again as the next stage's docs. All but the last return the columns of documents;
the last returns token ids. Null and empty texts, repeated rows and empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, minhash_join, mixing, sentencepiece_codec
from tidemark.llm.common import documents, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SHARE = 0.5  # of a text's letters that must be in spans of one learned language


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or without one prevailing language go; lang becomes the language found."""
    model = langid.fit(docs)
    found = langid.label(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SHARE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which no line is left."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return recounted(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (rows of it that are equal in text once). Those without an id stay."""
    kept = minhash_join.near_duplicates(docs, row="_text").where("kept and id is not null").select(F.col("id").alias("_id"), "_text").distinct()
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("_row", F.xxhash64("text")).dropDuplicates(["doc_id", "_row"])
    left = named.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_row") == F.col("_text"))).select(*COLUMNS)
    return left.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for each epoch in which it takes some of its words."""
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("_row"), mixing.word_count(F.col("text")).alias("size"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    times = mixing.mix(sized, keep=("_row",)).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_row").alias("_text")).agg(F.sum(copies).cast("int").alias("_n"))
    # Equal rows count once here, as times has the sum of their copies.
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "_row"])
    mixed = rows.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_row") == F.col("_text")))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked to decode to it."""
    model = sentencepiece_codec.Pieces.load(sentencepiece_codec.default_path())
    return sentencepiece_codec.encode(docs, model, keep=("doc_id", "lang", "source"), check=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Language models, minwise trees and piece lattices are beyond SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
