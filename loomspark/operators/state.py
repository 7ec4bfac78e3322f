"""Append-only logs and what they add up to: labels, caches, memory, sessions. The same folds serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """STR-01, STR-03, STR-05: the last record of each key. One aggregation that combines before its shuffle, so a key
    that was written often is no burden. Records without a key are skipped."""
    rest = [c for c in log.columns if c not in keys]
    ok = log
    for k in keys:
        ok = ok.where(F.col(k).isNotNull())
    best = ok.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_latest(current: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """STR-11, STR-12: the state after a batch of records."""
    return latest(batch if current is None else current.unionByName(batch), keys, order)


def memory_latest(log: DataFrame) -> DataFrame:
    """STR-12, STR-13: memory after all writes: the last write of (owner, kind, value) counts, and says whether the entry
    persists; ``forget`` deletes."""
    key = ["owner", "kind", "value"]
    gone = log.where("action = 'forget'").groupBy(*key).agg(F.max("seq").alias("gone"))
    alive = log.where("action = 'write'").join(gone, key, "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return alive.groupBy(*key).agg(F.max("seq").alias("seq"), F.max_by("persistent", "seq").alias("persistent"))


def persistent_only(memory: DataFrame, kinds: list[str]) -> DataFrame:
    """STR-14, STR-15: what is saved, and loaded again: persistent entries of known kinds."""
    return memory.where(F.col("persistent") & F.col("kind").isin(*kinds))


def memory_summary(memory: DataFrame, limit: int = 500) -> DataFrame:
    """STR-16: by owner and kind, values in the order of writing, joined; the last characters stay."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return memory.groupBy("owner", "kind").agg(F.right(F.array_join(ordered, ", "), F.lit(limit)).alias("summary"))


def session_avoid(shown: DataFrame, excluded: DataFrame) -> DataFrame:
    """SET-02: what a session must not show again."""
    return shown.select("session", "item").union(excluded.select("session", "item")).distinct()


def newly_excluded(request: DataFrame, excluded: DataFrame) -> DataFrame:
    """SET-03, TOOL-07: what a request adds."""
    return request.select("session", "item").distinct().join(excluded.select("session", "item"), ["session", "item"], "left_anti")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """STR-17, WIN-07: the first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def session_summary(shown: DataFrame, most: int = 12) -> DataFrame:
    """STR-18: a session's last items, numbered anew."""
    w = Window.partitionBy("session").orderBy(F.col("seq").desc(), F.col("item").desc())
    last = shown.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    listed = F.array_sort(F.collect_list(F.struct("seq", "item")))
    return last.groupBy("session").agg(F.array_join(F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x["item"].cast("string"))), " ").alias("summary"))


def cache_key(*parts: str | Column) -> Column:
    """STR-09, STR-10."""
    return F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])


def content_key(*parts: str | Column) -> Column:
    """STR-07, STR-08: a checksum over sorted parts; keys are this engine's own."""
    return F.sha2(F.to_json(F.struct(*[(F.col(p) if isinstance(p, str) else p).alias(f"p{i:02d}") for i, p in enumerate(parts)])), 256)


def memory_labels(expected: DataFrame, memory: DataFrame) -> DataFrame:
    """EVL-04: for each owner, the first expectation that the memory misses, or the first taboo that it holds."""
    held = memory.where("persistent").groupBy("owner").agg(F.array_join(F.collect_list("value"), "\n").alias("held"))
    j = expected.join(held, "owner", "left").withColumn("has", F.contains(F.coalesce("held", F.lit("")), F.col("text")))
    wrong = j.where(F.col("has") != F.col("must"))
    return wrong.groupBy("owner").agg(F.min_by(F.struct(F.when(F.col("must"), "missing").otherwise("must_not_persist").alias("label"), "text"), "ordinal").alias("w")).select("owner", "w.label", "w.text")


def sessions_of(turns: DataFrame, owner: str) -> DataFrame:
    """SVC-03: an owner's sessions, newest first."""
    return turns.where(F.col("owner") == owner).groupBy("session").agg(F.min("ts").alias("created"), F.max("ts").alias("updated"), F.count("*").alias("turns")).orderBy(F.desc("updated"), "session")
