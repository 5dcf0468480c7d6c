"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's result
as Parquet in the shared folder and reads it again. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, shared_dir, table
from gridloom.llm.decontaminate import find_benchmark
from gridloom.llm.kneser_ney import classify
from gridloom.llm.line_dedup import dedup_line_windows
from gridloom.llm.ngram_jaccard import classes
from gridloom.llm.packing import pack


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are those of a row of gone (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias("__gone_doc_id"), F.col("text_hash").alias("__gone_text_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_doc_id")) & F.xxhash64("text").eqNullSafe(F.col("__gone_text_hash")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their end mark alone, so they go where hardly a trusted text is empty; repeated rows
    go or stay together, extra columns stay as they are, and an empty table stays empty.
    """
    return without(docs, classify(docs, table(spark, sf_dir, "labels")).where("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those left with no word go.

    n_chars, where there is one, follows the text. Null texts and texts in which nothing repeats stay as they are, empty ones
    too; of repeated rows one is the document, the others, of three lines or more, have nothing left and go; all other
    columns stay, whatever their names; an empty table stays empty.
    """
    cleaned = dedup_line_windows(docs.select(F.struct("*").alias("__whole"), "doc_id", "text"))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    now = {c: F.col(f"__whole.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in now:
        now["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(now["n_chars"])
    return cleaned.where(left).select(*[c.alias(name) for name, c in now.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts: the first by id, then text hash; of repeated rows one.

    Of rows that repeat an id and text and differ elsewhere the first by their other columns stays. Null texts and texts
    without a word are linked with nothing and stay; extra columns stay; an empty table stays empty.
    """
    found = cut(classes(docs))
    kept = without(docs, found.where("not keep"))
    repeated = found.where("keep and class_docs > 1").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if repeated.isEmpty():
        return kept
    # rows that repeat a kept one's id and text: one of each, pre-aggregated
    again = repeated.select(F.col("doc_id").alias("__again_doc_id"), F.col("text_hash").alias("__again_text_hash"))
    marked = kept.join(again, F.col("doc_id").eqNullSafe(F.col("__again_doc_id")) & (F.xxhash64("text") == F.col("__again_text_hash")), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = marked.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return without(kept, repeated).unionByName(one)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark segment is found.

    Null and empty texts hold none and stay; repeated rows go or stay together; extra columns stay; an empty table, of
    either kind, takes nothing away.
    """
    return without(docs, find_benchmark(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of the permitted lengths.

    Null and empty texts are a piece of the end mark alone; repeated rows are packed each; of the columns only the id
    goes on; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

#: SQL can express neither the language model nor the alignments; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
