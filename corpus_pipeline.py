"""A training corpus from documents: drop toxic ones, near copies and repeated passages, mix, pack.

Every stage but the last returns the columns of its documents, whatever their names. A null
text counts as empty, repeated rows are judged each, rows without an id are kept by the
filters, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from patronlens.llm.common import read, stash
from patronlens.llm.tokens import standard_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones among them, doesn't call toxic."""
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by word-shingle similarity."""
    found = jaccard_join.similar_sets(docs)
    gone = stash(found.filter("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; texts without such stay as they are."""
    cut = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = cut.withColumn("new", text)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("new")}
    columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("new").cast("long")).otherwise(F.col("rest.n_chars"))
    return rows.select([columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies, _ = mixing.mix(docs)
    taken = copies.filter("whole > 0").select("doc_id", "source", "mark", "whole")
    # a document travels as one column, so no name of its columns meets one of the mix
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("of_doc"),
        F.col("source").cast("string").alias("of_source"),
        F.xxhash64("text").alias("of_mark"),
    )
    match = (
        F.col("doc_id").eqNullSafe(F.col("of_doc"))
        & F.col("source").eqNullSafe(F.col("of_source"))
        & (F.col("mark") == F.col("of_mark"))
    )
    repeated = rows.join(taken, match).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    return repeated.select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(packing.pieces(docs, standard_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Learned weights, seeded draws and a tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is stored and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
