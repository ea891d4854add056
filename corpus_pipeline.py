"""A corpus pipeline: toxicity, quality, near-duplicates, benchmark passages, packing.

Every stage takes all documents that the one before it kept and returns documents with the same
columns, the last one the packed pieces.  Rows are told apart by id and text together, so rows without
an id and rows that share one are judged each by its own text; null texts count as empty, and very long
ones are judged whole.  Columns beyond those of documents are carried along whatever their names; an
empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm import decontam, minhash, packing, quality, queries, toxicity
from basinflow.sources.shared import few_files, materialise, small_arrow_batches


def key(docs: DataFrame) -> Column:
    """Orders by id, rows without one last."""
    return F.struct(docs["doc_id"].isNull().alias("missing"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("hash"))


def matching(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["id"]) & (F.xxhash64(docs["text"]) == keys["hash"])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones among them, does not reject."""
    chain = toxicity.train_on_labels(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejected(docs["text"], chain))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, trained on the labelled ones among them, predicts as good."""
    labels = queries.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("label"))
    model = quality.train(materialise(quality.document_statistics(docs), "statistics"), labels)
    return docs.where(quality.accepted(docs["text"], model))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows equal in id and text one."""
    small_arrow_batches(spark)
    groups = minhash.near_duplicate_groups(docs.select(key(docs).alias("key"), docs["text"]), id_col="key")
    kept = groups.where("kept").select("key.id", "key.hash")
    return few_files(docs.join(kept, matching(docs, kept), "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    pairs = decontam.contaminated(docs.select(key(docs).alias("key"), docs["text"]), queries.table(spark, sf_dir, "benchmark"), id_col="key")
    found = pairs.select("key.id", "key.hash").distinct()
    return few_files(docs.join(found, matching(docs, found), "left_anti"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences that hold every remaining document."""
    small_arrow_batches(spark)
    return queries.digest_pieces(packing.pack(docs))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Trained models and retrieval cannot be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
