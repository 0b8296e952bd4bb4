"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Rows without a doc_id pass the filtering stages; each other row is judged by itself, also where rows share a
doc_id. An empty table gives an empty one at every stage. A null text is an empty one: it is scored as such, equal to other
empty texts, near to none, and packed as one token.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from geoloom.llm.common import Scratch, load, owning

#: Row numbers that may be broadcast; beyond, the join shuffles.
BROADCAST = 1_000_000
#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with __row, a number of each row in the order of doc_id, null where that is null: doc_id itself if no two rows
    share one. Else the numbers are written first, so that they stay."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if ids.where("count > 1").isEmpty():
        return docs.withColumn("__row", F.col("doc_id"))
    placed = docs.withColumn("__row", F.monotonically_increasing_id()).orderBy("doc_id", F.xxhash64("text"), "__row")
    placed = scratch.write(placed.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    return placed.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.col("__row")))


def _without(docs: DataFrame, decisions: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (__row, ...) less the rows that decisions (doc_id: the row's number, kept) does not keep."""
    dropped = decisions.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__row"))
    dropped = scratch.write(dropped, "dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST else dropped
    return docs.join(side, "__row", "left_anti").drop("__row")


@owning
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is below TOXIC; without any labels all of them."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, to="__score").where(F.col("__score") < TOXIC).select(*docs.columns)


@owning
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    scratch = Scratch(spark, "stage")
    rows = _numbered(docs, scratch)
    return _without(rows, exact_dedup.deduplicate(rows, "__row"), scratch)


@owning
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id."""
    scratch = Scratch(spark, "stage")
    rows = _numbered(docs, scratch)
    return _without(rows, near_dedup.near_duplicates(rows, "__row"), scratch)


@owning
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which nothing is removed keeps its text as it is."""
    cut = substring_dedup.remove_repeats(_numbered(docs, Scratch(spark, "stage")), id_col="__row")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


@owning
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of docs with its place in a sequence of at most 2048 tokens."""
    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    own = Scratch(spark, "pieces").write(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack_pieces(own).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: SQL cannot express a learned score or best-fit packing.
ORACLE_SQL = None


@owning
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
