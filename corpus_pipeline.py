"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, sequences.

Each stage takes the documents that the stage before it kept, and all but the last return
documents with the same columns.  ``run`` writes each stage's result to the shared folder
and reads it back, so that a lost executor costs one stage at most.

What odd rows come to, at any stage: a null or empty text is linked with nothing, hit by nothing
and masked nowhere, and ends as one piece of one id; texts of any length are read whole.  Without
labels of both kinds the classifier rejects nothing.  Rows equal in id and text become one; of rows that
share an id (nulls count as one id) but not their text, those stay in the second stage whose id any linked
group keeps.  A tie at a threshold counts as linked, hit or kept.  Empty tables give empty results, and
columns of other names, clashing ones included, are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import cotrain, decontam, jaccard, packing, secretscan
from loomspan.llm.queries import read, tokenizer_files
from loomspan.llm.shared import Workspace, small_enough

SHINGLE = 5  # of the stage; op4 has its own
PERCENT = 80
MOST_BROADCAST_IDS = 500_000  # 4 MB of ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotrain.kept(docs, cotrain.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the one with the least id.

    Links are at a similarity of 0.8 or more over shingles of five words.
    """
    stay = jaccard.linked(docs, size=SHINGLE, percent=PERCENT).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.col("doc_id").alias("stays")).distinct().hint("merge")
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["stays"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if jaccard.repeats_ids(docs) else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    A document is known by a hash of its id and text, so that others with its id stay.
    """
    key = F.xxhash64("doc_id", "text")
    found = decontam.contamination(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    hit = Workspace(spark, "contaminated").table(found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("hit")).distinct(), "ids")
    if small_enough(hit, MOST_BROADCAST_IDS):
        hit = F.broadcast(hit)
    return docs.join(hit, key == hit["hit"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secretscan.redacted(docs, secretscan.train(secretscan.labelled_samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs, tokenizer_files())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer stand in the chain: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
