"""Duplicates over an inventory, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def mark_content_duplicates(inventory: DataFrame) -> DataFrame:
    """WIN-02: the first readable row of a fingerprint, in path order, is the canonical one.

    Failed rows and empty fingerprints are never duplicates. The canonical row comes from one aggregation that
    combines before its shuffle, so a fingerprint that many files share is no burden.
    """
    usable = (F.col("read_status") == "ok") & (F.coalesce(F.col("content_sha256"), F.lit("")) != "")
    first = inventory.where(usable).groupBy("content_sha256").agg(F.min_by("novel_id", F.struct("relative_path", "novel_id")).alias("canonical"))
    joined = inventory.join(first, "content_sha256", "left")
    is_dup = usable & (F.col("novel_id") != F.col("canonical"))
    return joined.select(*inventory.columns, F.coalesce(is_dup, F.lit(False)).alias("is_duplicate"), F.when(is_dup, F.col("canonical")).alias("duplicate_of"))


def near_duplicates(marked: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """WIN-03: rows of one title and author whose lengths differ little from the longest: ``(novel_id, near_duplicate_of)``."""
    named = marked.withColumns({"title_guess": X.strip("title_guess"), "author_guess": X.strip("author_guess")})
    ok = named.where((F.col("read_status") == "ok") & ~F.col("is_duplicate") & (F.coalesce("author_guess", F.lit("")) != "") & (F.coalesce("title_guess", F.lit("")) != ""))
    key = ["title_guess", "author_guess"]
    best = ok.groupBy(*key).agg(F.min_by(F.struct("novel_id", "char_count"), F.struct((-F.col("char_count")).alias("n"), "relative_path", "novel_id")).alias("best"))
    near = ok.join(best, key).where((F.col("novel_id") != F.col("best.novel_id")) & (F.col("best.char_count") > 0) & ((F.col("best.char_count") - F.col("char_count")) / F.col("best.char_count") <= tolerance))
    return near.select("novel_id", F.col("best.novel_id").alias("near_duplicate_of"))


def duplicate_report(marked: DataFrame, near: DataFrame) -> DataFrame:
    """AGG-17: exact and near duplicates, the rows they repeat, and by how many kept rows outnumber their titles."""
    joined = marked.join(near, "novel_id", "left")
    free = joined.where((F.col("read_status") == "ok") & ~F.col("is_duplicate") & F.col("near_duplicate_of").isNull())
    shared = free.groupBy("title_guess").count().agg(F.coalesce(F.sum("count") - F.count("*"), F.lit(0)).alias("title_collisions"))
    counts = joined.agg(
        F.count("*").alias("rows"), F.count_if("is_duplicate").alias("exact"), F.count_if(F.col("near_duplicate_of").isNotNull()).alias("near"), F.count_distinct(F.coalesce("near_duplicate_of", "duplicate_of")).alias("groups")
    )
    return counts.crossJoin(shared)  # one row by one row


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """AGG-28: one row per status."""
    return inventory.groupBy("read_status").agg(F.count("*").alias("files"), F.sum("char_count").alias("chars"), F.round(F.avg("char_count"), 4).alias("mean_chars"))


def title_index(books: DataFrame, key: str, novel_id: str = "novel_id") -> DataFrame:
    """WIN-06: keys of at least two characters that one book alone has."""
    return books.where(F.char_length(key) >= 2).groupBy(key).agg(F.min(novel_id).alias(novel_id), F.count("*").alias("n")).where("n = 1").drop("n")


def last_turns(turns: DataFrame, conversation: str, order: str, keep: int = 8) -> DataFrame:
    """WIN-08: the last turns of each conversation, and how many came before them."""
    w = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    total = turns.groupBy(conversation).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("dropped"))
    return turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep).drop("__rn").join(total, conversation)


def compact_messages(turns: DataFrame, conversation: str, order: str, role: str, text: str, tool_role: str = "tool", keep: int = 6, short: int = 40) -> DataFrame:
    """WIN-09, TOOL-16: all but the last tool messages of a conversation give way to their beginnings."""
    is_tool = F.col(role) == tool_role
    w = Window.partitionBy(conversation, role).orderBy(F.col(order).desc())
    old = is_tool & (F.row_number().over(w) > keep)
    return turns.withColumn(text, F.when(old, F.concat(F.substring(text, 1, short), F.lit("..."))).otherwise(F.col(text)))
