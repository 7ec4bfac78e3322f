"""Deterministic pseudo-random functions: identifiers, buckets, folds, stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import col, squash, strip


def novel_id(path: str | Column) -> Column:
    """HSH-01."""
    return F.sha1(col(path))


def content_fingerprint(text: str | Column) -> Column:
    """HSH-02: checksum of the text without white space."""
    return F.sha2(squash(text), 256)


def _unit(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def split_bucket(content: str | Column, salt: str) -> Column:
    """HSH-03: a number in [0, 1) from the first eight bytes of a salted checksum."""
    return _unit(F.sha2(F.concat(F.lit(salt + ":"), col(content)), 256))


def assign_fold(content: str | Column, fraction: float, salt: str) -> Column:
    """HSH-04."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return F.when(split_bucket(content, salt) < fraction, "eval").otherwise("train")


def stable_unit_float(seed: str | Column) -> Column:
    """HSH-07."""
    return _unit(F.sha1(col(seed)))


def build_splits(inventory: DataFrame, fraction: float, salt: str) -> DataFrame:
    """HSH-05, HSH-06: readable rows that are no duplicates, with their folds."""
    missing = {"novel_id", "content_sha256", "read_status", "is_duplicate"} - set(inventory.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    ok = inventory.where((F.col("read_status") == "ok") & ~F.col("is_duplicate"))
    return ok.withColumn("fold", assign_fold("content_sha256", fraction, salt))


def split_report(inventory: DataFrame) -> DataFrame:
    """HSH-05: counts of what was kept and skipped, in one pass."""
    return inventory.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("read_status") != "ok").alias("unreadable"),
        F.count_if((F.col("read_status") == "ok") & F.col("is_duplicate")).alias("duplicates"),
        F.count_if((F.col("read_status") == "ok") & ~F.col("is_duplicate")).alias("kept"),
    )


def fractions(count: int, skip: float = 0.05) -> list[float]:
    """ARR-10: evenly spread fractions that stop short of the end."""
    return [round(i * max(1 - skip, 0.0) / max(count - 1, 1), 6) for i in range(count)]


def judge_fractions(windows: int = 6, samples: int = 10, skip: float = 0.05) -> list[float]:
    """HSH-09: midpoints between the fractions that a profile samples, all of them or as many as asked for, spread evenly;
    the middle of the text where a profile samples one place at most."""
    f = fractions(samples, skip)
    middle = [(a + b) / 2 for a, b in zip(f, f[1:])] or [0.5]
    step = max(1.0, len(middle) / max(windows, 1))
    return [middle[int(i * step)] for i in range(max(0, min(windows, len(middle))))]


def window_at(text: str | Column, fraction: Column, size: int) -> Column:
    """HSH-11: a window at a fraction of the text, moved inside it, stripped."""
    t = col(text)
    n = F.char_length(t)
    at = F.least(F.floor(n * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))).cast("int"), F.greatest(n - size, F.lit(0)))
    return strip(F.substring(t, at + 1, F.lit(max(size, 0))))


def jittered(key: str | Column, windows: int = 6, fixed: tuple[float, ...] = (0.0, 0.5, 1.0), gap: float = 0.08) -> Column:
    """HSH-10: a hashed fraction in each of equal bands; one that falls too near a fixed point moves past it."""
    if windows < 1:
        raise ValueError("at least one window")
    out = []
    for i in range(windows):
        f = F.least((F.lit(i + 0.15) + stable_unit_float(F.concat(col(key), F.lit(f":{i}"))) * 0.7) / (windows + 1), F.lit(1.0))
        for p in fixed:
            f = F.when(F.abs(f - p) < gap, F.lit(min(p + 1.5 * gap, 0.97))).otherwise(f)
        out.append(F.round(f, 4))
    return F.array(*out)


def rank_band(rank: str | Column) -> Column:
    """HSH-16."""
    r = col(rank)
    return F.when(r.between(1, 3), "1-3").when(r.between(4, 10), "4-10").otherwise("other")


def book_half(key: str | Column) -> Column:
    """HSH-14: halves by the parity of a checksum."""
    return F.when(F.conv(F.substring(F.md5(col(key)), 32, 1), 16, 10).cast("int") % 2 == 0, "validate").otherwise("heldout")


def stratified_sample(rows: DataFrame, query: str, item: str, rank: str, size: int, seed: str) -> DataFrame:
    """HSH-15: pairs once each, an equal quota for each query and rank band, topped up in hash order.

    Hash order replaces a generator's order, which no distributed engine can reproduce; it is the same on every run.
    """
    once = rows.groupBy(query, item).agg(F.min(rank).alias(rank)).withColumn("band", rank_band(rank))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(query).cast("string"), F.col(item).cast("string")))
    keyed = once.withColumn("h", order)
    strata = max(1, keyed.select(query, "band").distinct().count())
    numbered = keyed.withColumn("n", F.row_number().over(Window.partitionBy(query, "band").orderBy("h", item)))
    first = F.when(F.col("n") <= max(1, size // strata), 0).otherwise(1)
    return numbered.orderBy(first, "h", query, item).limit(size).select(query, item, rank, "band")


def calibration_sample(pairs: DataFrame, strata: list[str], keys: list[str], n: int, seed: str) -> DataFrame:
    """HSH-17: round robin over strata of pairs in hash order, until there are ``n``."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    numbered = pairs.withColumn("h", h).withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy("h", *keys)))
    # No stratum gives more than n, so ranks beyond it end where they are counted.
    return numbered.where(F.col("turn") <= n).orderBy("turn", *strata, "h").limit(n).drop("h")


def sample_order(rows: DataFrame, key: str, n: int) -> DataFrame:
    """HSH-18: the first ``n`` in the order of their checksums."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def assign_splits(tasks: DataFrame, key: str, n_test: int, n_dev: int, seed: str = "0") -> DataFrame:
    """HSH-13: the first tasks in hash order test, the next develop, the rest go."""
    ranked = tasks.withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))).orderBy("h", key).limit(n_test + n_dev)
    numbered = ranked.withColumn("n", F.row_number().over(Window.orderBy("h", key)))
    return numbered.withColumn("split", F.when(F.col("n") <= n_test, "test").otherwise("dev")).drop("h", "n")


def leakage_report(train: DataFrame, held: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """HSH-19: ids on both sides, and ids that stand on the wrong side of the folds."""
    a, b = train.select(key).distinct(), held.select(key).distinct()
    wrong = lambda side, fold: side.join(folds.where(F.col("fold") == fold), key, "left_semi").agg(F.count("*").alias("n"))
    both = a.join(b, key, "left_semi").agg(F.count("*").alias("n"))
    return both.select(F.lit("overlap").alias("what"), "n").union(wrong(a, "eval").select(F.lit("train_in_eval"), "n")).union(wrong(b, "train").select(F.lit("eval_in_train"), "n"))
