"""The operators' queries by name, with production parameters over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import alignment, archives, chats, lines, media, near, packing, periods, personal, quality, sentencepieces, substrings, urls
from .common import checkpointed, saved, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, saved(quality.references(docs, table(spark, sf_dir, "labels"))), keep=["doc_id"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are tokenised once; the small table of pieces is written, as ranks and sizes are both taken from it.
    return packing.pack(checkpointed(packing.pieces(table(spark, sf_dir, "documents"))))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.detect(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"), keep=["doc_id"], with_media=False)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.link(table(spark, sf_dir, "conversations"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.converted(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_table(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find_runs(table(spark, sf_dir, "documents"), keep=["doc_id"], prepare=periods.planted, with_runs=False)


def _small(query: Query) -> Query:
    """The query in a session whose Arrow batches are small: documents are long."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _small(f)
    for f in (op1_quality, op2_sentencepiece, op3_packing, op4_substrings, op5_pii, op6_media, op7_urls, op8_chats, op9_near, op10_lines, op11_warc, op12_alignment, op13_periods)
}

ORACLE_SQL: dict[str, str] = {"op7_urls": urls.oracle_sql(), "op8_chats": chats.ORACLE_SQL, "op11_warc": archives.ORACLE_SQL}
