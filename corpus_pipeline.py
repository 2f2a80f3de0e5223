"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a
stage returns to the shared folder and rereads it as the next one's docs. All but
the last return the columns of documents.

Nulls, empty texts, repeated rows and empty tables: every stage keeps rows with a
null doc_id or text (unless it finds them toxic, near copies or contaminated by
their text), and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradmill.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from gradmill.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose toxicity is at least one half. Trained on labels;
    where no labelled row is left, nothing is left out."""
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), machine).filter("toxicity < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned common blocks from later documents. A document that loses
    all of its lines keeps its row with an empty text."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of texts whose
    sets of five-word shingles have a similarity of 0.8 or more, and of rows that
    repeat it, one. Rows with a null doc_id stay. Pairs are found by BK-trees of
    SimHash fingerprints and verified."""
    return near_copies.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that lie in windows of benchmark items; other text stays as it
    is."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_hits(docs.select(*COLUMNS), items).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL: the toxicity machine, SimHash and the tokenizer are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
