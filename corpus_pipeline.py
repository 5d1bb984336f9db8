"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillspark.llm import latent, packing, pii, quality, simhash
from spillspark.llm.common import importable, release, shared_dir, table, whole_row


#: Rows that a Python worker gets at a time: a few MB of texts, where Spark's 10,000 are 30 MB and more a task, twice.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get ``BATCH_ROWS`` at a time, unless the user has set another number."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and empty texts go (too few words), very long ones are judged whole;
    null languages and sources are values of their own; rows that repeat, in whole
    or by id, share a verdict; other columns, whatever their names, stay.
    An empty table stays empty.
    """
    importable(spark)
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id.

    A null id is smaller than any other; of one id's texts the smaller hash stays,
    of equal rows one. Null, empty and wordless texts are one group; very long
    texts count whole; other columns, whatever their names, stay. An empty
    table stays empty.
    """
    _small_batches(spark)
    importable(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts are clean and stay; very long texts are searched
    whole; each row is judged on its own, repeated rows and ids alike, null ids
    too; other columns, whatever their names, stay. An empty table, or an empty
    benchmark, changes nothing.
    """
    _small_batches(spark)
    rows = docs.select("doc_id", "text", whole_row(docs).alias("whole_row"))
    found = latent.decontaminate(rows, table(spark, sf_dir, "benchmark"), "whole_row")
    return found.where(~F.col("contaminated")).select("whole_row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; all documents stay.

    A null text stays null (its n_chars too), an empty one empty; very long texts are masked
    whole; each row on its own, repeated rows and ids alike; other columns,
    whatever their names, stay as they are. An empty table stays empty.
    """
    _small_batches(spark)
    importable(spark)
    rows = docs.select(whole_row(docs).alias("row"), "text")
    found = pii.detect(rows, "row").select("row", "masked")
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("bigint")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents along the curve, with their ids.

    Null and empty texts are a document of one id, very long ones many pieces;
    ties on the curve go by id; rows that repeat an id are documents of
    their own; other columns are left out. An empty table gives none.
    """
    _small_batches(spark)
    importable(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SimHash, the SVD and the tokenizer have no SQL form; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they write stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        release(spark)
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
