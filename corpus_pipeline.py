"""A corpus pipeline of four stages over ``documents``.

Quality rules drop rejected documents; SimHash near-dedup keeps the first of
each group of near copies; temperature mixing repeats the smaller sources and
lays all documents out in mixed order; and best-fit packing lays the token ids of
what is left into sequences. What a stage cuts on the way is deleted once its
output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.lineage import cut, new_folder, scope
from weftline.llm import mixing, packing, quality, simhash
from weftline.llm.queries import vocabulary
from weftline.tables import load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language reference."""
    return quality.quality_filter(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more. Of repeated rows of an id all stay; rows with a null id stay."""
    groups = simhash.simhash_near_duplicates(docs, width=5, similarity=0.8)
    lost = cut(groups.where("component_id <> id").select(F.col("id").alias("lost_id")))
    return docs.join(lost, docs["doc_id"].cast("long") == lost["lost_id"], "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, once or more, in mixed order."""
    return mixing.mix_rows(docs, max_repetition=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, 4096)


STAGES = [("quality rules", quality_stage), ("SimHash near-dedup", dedup_stage), ("temperature mixing", mixing_stage), ("best-fit packing", packing_stage)]

#: SimHash and tokenizers are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet and read again for the next."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark)
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
