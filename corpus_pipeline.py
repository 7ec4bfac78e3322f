"""The corpus pipeline: quality rules, line dedup, near-dedup, personal data and packing, in this order.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import lines, near, packing, personal, quality
from loomspark.llm.common import P, checkpointed, few, forget_saved, saved, saved_so_far, small_batches, table


def _measured(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars``, where they have it, brought up to date."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged by references fitted on the labelled clean ones among them.

    Null and empty texts fail the base rules and go, as do texts of fewer than 20 words; very long texts are judged whole.
    Repeated rows are judged alike, and all stay or go. An empty table, or one without labels, is no error. All columns
    stay as they are, whatever their names, and nulls in them do not matter.
    """
    small_batches(spark)
    names = docs.columns
    reference = saved(quality.references(docs, table(spark, sf_dir, "labels")))
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c in ("text", "lang") else f"{P}c{i}") for i, c in enumerate(names)])
    kept = quality.judge(inner, reference).where("kept")
    return kept.select(*[F.col(c if c in ("text", "lang") else f"{P}c{i}").alias(c) for i, c in enumerate(names)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document that loses its last word goes.

    Null texts stay, and so do texts without a word; repeated rows (id and text) keep the same lines; an empty table gives
    an empty result. Ties of place are broken by id, nulls first, then text hash and line number. Columns keep their names.
    """
    done = lines.dedup(docs.withColumn(f"{P}had", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))))
    left = done.where(~F.col(f"{P}had") | F.col("text").rlike(r"\S"))
    return _measured(left.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; of rows that repeat an id and a text, one.

    Where ids are missing or stand for several rows, a row is named by its id and its text's hash, null ids last. Null
    texts and texts without a word are linked with nothing and stay, one row for each id; an empty table gives an empty
    result; other columns play no part, and which of equal rows stays does not matter.
    """
    small_batches(spark)
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if counts.where("doc_id is null or n > 1").limit(1).count():
        name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
        named = docs.withColumn(f"{P}name", name)
        gone = near.near_duplicates(named, doc_id=f"{P}name").where("not kept").select(F.col("doc_id").alias(f"{P}name")).distinct()
        left = named.join(few(saved(gone)), f"{P}name", "left_anti")
        # Texts of rows that are alone with their name are not shuffled.
        again = few(saved(named.groupBy(f"{P}name").agg(F.count("*").alias(f"{P}n")).where(f"{P}n > 1").select(f"{P}name")))
        once = left.join(again, f"{P}name", "left_anti")
        return once.unionByName(left.join(again, f"{P}name", "left_semi").dropDuplicates([f"{P}name"])).select(*docs.columns)
    gone = near.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(f"{P}d"), F.col("text_hash").alias(f"{P}t")).distinct()
    return docs.join(few(saved(gone)), (docs["doc_id"] == F.col(f"{P}d")) & (F.xxhash64(docs["text"]) == F.col(f"{P}t")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked. Null and empty texts stay as they are, very long ones are read whole, repeated
    rows are masked alike, of spans that tie the first kind is named, and other columns stay, whatever their names."""
    small_batches(spark)
    return _measured(personal.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets. A null or empty text is one piece with the end id alone; a very
    long one is cut into pieces; repeated rows are packed each; equal lengths are dealt by hash order; an empty table gives
    an empty result; of the columns only the id and the text are read."""
    small_batches(spark)
    return packing.pack(checkpointed(packing.pieces(docs)))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: Line and near-dedup, tokens and packing are beyond SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next. The
    tables that a stage made on its way, and the one it read, are deleted once its own is written."""
    docs = table(spark, sf_dir, "documents")
    mark = saved_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
            forget_saved(spark, mark, but=1)
    return docs
