"""The corpus pipeline: toxicity, line dedup, near-dedup, secret scans, packing.

Every stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but
the last return the columns of ``documents``, whatever their names.  ``run`` writes each
stage's result to the shared checkpoint folder as Parquet and reads it again for the next;
a stage's table is deleted once its successor's is written.

In every stage a null or empty text is a document without words, lines, shingles or spans: it
is kept by the first, second and fourth, links with other empty ones in the third and is one
end token in the last.  Very long texts are read whole.  Repeated rows are documents of their
own: near-dedup keeps the first of them, and of rows with one doc_id the one read first.
Ties of keys go by the place in the stage's table, which is written before it is numbered.
Null keys carry no label and come last among copies.  Empty tables give empty tables, and
columns of any name stay until packing, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import line_dedup, packing, secrets, simhash, toxicity
from tarn.llm.common import drop_table, fresh, shared_folder, table
from tarn.llm.queries import byte_bpe, toxicity_folds
from tarn.session import ship


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go."""
    ship(spark)
    counted, fitted, _ = toxicity_folds()
    found = toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), counted, fitted)
    row = fresh(docs, "row_number")
    bad = found.where("predicted = 1").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(bad, row, "left_anti").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from later documents; a document of which no line is left goes."""
    ship(spark)
    counts = fresh(docs, "lines_held"), fresh(docs, "lines_removed")
    found = line_dedup.dedup_lines(docs, counts=counts)
    return _sized(found.where((F.col(counts[1]) == 0) | (F.col(counts[1]) < F.col(counts[0]))).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (of equal ids the first)."""
    ship(spark)
    row = fresh(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    gone = simhash.near_duplicates(numbered, row=row).where("not kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are masked in the texts."""
    ship(spark)
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return packing.pack_documents(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: A trained model and alignment are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_table(spark, last)
        last = path
    return docs
