"""Evaluation of candidate pools: joins to verdicts, shares by configuration, agreement of raters, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def share(condition: Column, digits: int = 4) -> Column:
    """AGG-05, AGG-10: the mean of a condition, rounded; null over no rows, or none that is decided."""
    return F.round(F.avg(condition.cast("int")), digits)


def mean(value: str | Column, digits: int = 4) -> Column:
    return F.round(F.avg(value), digits)


def is_strong(label: str | Column) -> Column:
    """FLT-18: a label that reads as the number two."""
    v = F.col(label) if isinstance(label, str) else label
    return F.coalesce(v.cast("string").try_cast("double") == 2, F.lit(False))


def title_matches_anchor(title: str | Column, anchor: str | Column) -> Column:
    """FLT-17: a normalised title begins with the normalised anchor; empty ones match nothing."""
    t, a = X.normalize_title(title), X.normalize_title(anchor)
    return F.coalesce((a != "") & (t != "") & t.startswith(a), F.lit(False))


def candidate_ok(positive: str | Column, violated: str | Column, strict: bool) -> Column:
    """FLT-19: usable, null where there is no verdict."""
    p = F.col(positive) if isinstance(positive, str) else positive
    v = F.coalesce(F.col(violated) if isinstance(violated, str) else violated, F.lit(False))
    return F.when(p.isNotNull(), (p >= (2 if strict else 1)) & ~v)


def spread(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` into ``parts``, if those are more than the session's own number of parts."""
    more = parts is not None and parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if more else rows


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """WIN-01."""
    return rows.where(F.col("rank") <= k)


def pool_pairs(rows: DataFrame, depth: int) -> DataFrame:
    """SET-01: distinct pairs of request and book over every configuration, with the first title."""
    return top_k(rows, depth).groupBy("request_id", "novel_id").agg(F.min_by("title", F.struct("rank", "config", "title")).alias("title"))


def judged(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """JON-08: rows with their verdicts; without one, the labels are null, never nought."""
    return rows.join(verdicts, keys, "left")


def judged_metrics(rows: DataFrame, verdicts: DataFrame, k: int, needed: int = 3, parts: int | None = None) -> DataFrame:
    """JON-08, AGG-27: by configuration, means over its judged queries: the share of wanted rows among judged ones, whether
    enough of them are usable, that is wanted and without a violation; and how many rows were judged. A configuration
    without a judged query is absent."""
    p = F.col("positive")
    j = spread(judged(top_k(rows, k), verdicts, ["query_id", "novel_id"]), parts, "query_id")
    per = j.groupBy("config", "query_id").agg(
        F.count("*").alias("n"), F.count(p).alias("judged"), F.avg((p == 2).cast("int")).alias("s"), F.avg((p >= 1).cast("int")).alias("l"),
        F.count_if(candidate_ok("positive", "violated", True)).alias("usable"), F.count_if(candidate_ok("positive", "violated", False)).alias("usable_lenient"),
    )
    enough = lambda c: share(F.when(F.col("judged") > 0, F.col(c) >= needed))
    done = per.groupBy("config").agg(
        F.count_if(F.col("judged") > 0).alias("queries"), mean("s").alias("precision_strict"), mean("l").alias("precision_lenient"), F.round(F.sum("judged") / F.sum("n"), 4).alias("coverage"),
        enough("usable").alias("feasible_strict"), enough("usable_lenient").alias("feasible_lenient"),
    )
    return done.where("queries > 0")


def recommendation_metrics(rows: DataFrame, verdicts: DataFrame, parts: int | None = None) -> DataFrame:
    """JON-09: shares of judged recommendations, overall and by kind, in one pass over grouping sets: wanted strictly and
    leniently, with a violation, and usable, that is wanted without one; then sessions all of whose judged books are usable."""
    p, bad = F.col("positive"), F.coalesce(F.col("violated"), F.lit(False))
    j = spread(judged(rows, verdicts, ["query_id", "novel_id"]), parts, "query_id")
    per = j.groupBy("kind", "query_id").agg(
        F.count("*").alias("n"), F.count(p).alias("j"), F.count_if(p == 2).alias("s"), F.count_if(p >= 1).alias("l"),
        F.count_if(p.isNotNull() & bad).alias("v"), F.count_if(candidate_ok("positive", "violated", False)).alias("u"),
    )
    part = lambda c: F.round(F.sum(c) / F.sum("j"), 4)
    return per.groupingSets([[], ["kind"]], "kind").agg(
        F.count_if(F.col("j") > 0).alias("sessions"), F.sum("n").alias("recommended"), F.round(F.sum("j") / F.sum("n"), 4).alias("coverage"), part("s").alias("strict"), part("l").alias("lenient"),
        part("v").alias("violation"), part("u").alias("usable"), share(F.when(F.col("j") > 0, F.col("u") == F.col("j"))).alias("all_usable"),
    ).select(F.coalesce("kind", F.lit("all")).alias("kind"), "sessions", "recommended", "coverage", "strict", "lenient", "violation", "usable", "all_usable")


def request_feasibility(rows: DataFrame, verdicts: DataFrame, k: int, needed: int, strict: bool) -> DataFrame:
    """AGG-09: requests with enough distinct usable books; a task is feasible if all its judged requests are."""
    j = judged(top_k(rows, k), verdicts, ["query_id", "novel_id"])
    ok = candidate_ok("positive", "violated", strict)
    per = j.where(F.col("positive").isNotNull()).groupBy("task_id", "query_id").agg(F.count_distinct(F.when(ok, F.col("novel_id"))).alias("usable"))
    return per.groupBy("task_id").agg(F.bool_and(F.col("usable") >= needed).alias("feasible"), F.count("*").alias("requests"))


def strong_recall(rows: DataFrame, strong: DataFrame, k: int) -> DataFrame:
    """JON-02: by query, the share of its strong books among its first ``k`` rows."""
    hit = top_k(rows, k).select("query_id", "novel_id").distinct().withColumn("hit", F.lit(1))
    return strong.join(hit, ["query_id", "novel_id"], "left").groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))


def anchor_ranks(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """AGG-03, AGG-07: the first rank at which a title begins with the anchor, by configuration, query and anchor."""
    each = anchors.groupBy("query_id", "anchor").agg(F.count("*").cast("int").alias("times"))
    hit = F.when(F.col("config").isNotNull() & title_matches_anchor("title", "anchor"), F.col("rank"))
    best = each.join(rows, "query_id").groupBy("config", "query_id", "anchor").agg(F.min(hit).alias("rank"), F.max("times").alias("times"))
    return best.select("config", "query_id", "anchor", "rank", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("t")).drop("t")


def anchor_metrics(ranks: DataFrame, ks: list[int], depth: int) -> DataFrame:
    """AGG-02, AGG-04: hit shares, the median rank with unfound anchors set beyond the depth, and their number."""
    hits = [share(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"hit_{k}") for k in ks]
    return ranks.groupBy("config").agg(F.count("*").alias("anchors"), *hits, F.percentile(F.coalesce("rank", F.lit(depth + 1)), 0.5).alias("median_rank"), F.count_if(F.col("rank").isNull()).alias("unfound"))


def anchor_summary(ranks: DataFrame, ks: list[int], folds: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """AGG-02: by configuration, the share of queries with an anchor among their first ``k``, the share of anchors found
    there, and the mean first rank within the largest ``k``; with ``folds`` ``(anchor, fold)`` by fold as well, where
    ``*`` stands for all and ``unknown`` for anchors that no fold has."""
    within = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    all_ = F.lit("*")
    told = ranks.withColumn("fold", all_)
    if folds is not None:
        own = ranks.join(folds.select("anchor", "fold").distinct(), "anchor", "left").fillna("unknown", ["fold"])
        # A row stands under its fold and under all; an anchor of two folds still counts once under all.
        n_folds = folds.groupBy("anchor").agg(F.count_distinct("fold").alias("n")).where("n > 1")
        told = own.withColumn("fold", F.explode(F.array(all_, "fold"))) if n_folds.isEmpty() else told.unionByName(own)
    told = spread(told, parts, "query_id")
    per = told.groupBy("config", "fold", "query_id").agg(F.count("*").alias("n"), F.min(F.when(within(max(ks)), F.col("rank"))).alias("first"), *[F.count_if(within(k)).alias(f"f{k}") for k in ks])
    shares = [c for k in ks for c in (share(F.col(f"f{k}") > 0).alias(f"hit_{k}"), F.round(F.sum(f"f{k}") / F.sum("n"), 4).alias(f"recall_{k}"))]
    return per.groupBy("config", "fold").agg(F.count("*").alias("queries"), F.sum("n").alias("anchors"), *shares, mean("first").alias("mean_first_rank"))


def judge_free_metrics(rows: DataFrame, cards: DataFrame, violations: DataFrame, wanted: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """AGG-08: by configuration, means over queries of shares of their first ``k``: among carded rows those of a wanted
    genre or sub-genre and those with a wanted element, among decided rows the clean ones. Each share counts only the
    queries that want such a thing and have such rows.

    ``cards`` are ``(novel_id, genre, subgenre, elements)``, ``wanted`` are ``(query_id, genres, subgenres, elements)``.
    """
    want = wanted.withColumnRenamed("elements", "wanted_elements")
    j = top_k(rows, k).join(want, "query_id", "left").join(cards, "novel_id", "left").join(violations, "novel_id", "left")
    carded = F.col("genre").isNotNull()
    fits = F.array_contains("subgenres", F.col("subgenre")) | F.array_contains("genres", F.col("genre"))
    per = spread(j, parts, "query_id").groupBy("config", "query_id").agg(
        F.avg(F.when(carded & (F.size("genres") + F.size("subgenres") > 0), F.coalesce(fits, F.lit(False)).cast("int"))).alias("g"),
        F.avg(F.when(carded & (F.size("wanted_elements") > 0), F.arrays_overlap("elements", "wanted_elements").cast("int"))).alias("e"),
        F.avg((~F.col("violation")).cast("int")).alias("c"),
    )
    return per.groupBy("config").agg(
        F.count("*").alias("queries"), mean("g").alias("genre_consistency"), F.count("g").alias("genre_queries"), mean("e").alias("element_consistency"), F.count("e").alias("element_queries"),
        mean("c").alias("density_clean"), F.count("c").alias("clean_queries"),
    )


def pairwise_jaccard(rows: DataFrame, k: int, group: str = "task_id") -> DataFrame:
    """AGG-08: the mean overlap of the result sets of two queries of one task, by configuration.

    Pairs are those of one task's rephrased queries, which are few; two empty sets overlap wholly.
    """
    sets = top_k(rows, k).groupBy("config", group, "query_id").agg(F.collect_set("novel_id").alias("s"))
    other = sets.select("config", group, F.col("query_id").alias("q2"), F.col("s").alias("s2"))
    pairs = sets.join(other, ["config", group]).where(F.col("query_id") < F.col("q2"))
    union = F.size(F.array_union("s", "s2"))
    return pairs.groupBy("config").agg(F.count("*").alias("pairs"), mean(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s", "s2")) / union)).alias("overlap"))


def manual_metrics(rows: DataFrame, k: int, variant: str = "config") -> DataFrame:
    """AGG-01: over all rows of the first ``k``, not by query."""
    j = top_k(rows, k)
    return j.groupBy(variant).agg(F.count("*").alias("n"), share(F.col("label") >= 1).alias("precision"), share(F.col("label") == 2).alias("strong"), mean("label").alias("mean_label"), share(F.col("violated")).alias("violation"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-18."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, a: str, b: str, weighted: bool = False, categories: list[int] | None = None, degenerate: str = "agreement") -> DataFrame:
    """AGG-19 to AGG-21: Cohen's kappa, with linear weights on demand.

    Where chance alone explains everything: by ``agreement``, one if the raters always agree and else nought; by ``null``, null.
    Marginals are as many as there are categories, so all but the first aggregation work on a handful of rows.
    """
    c = confusion(rows, a, b)
    total = c.agg(F.sum("n").alias("t"))
    pa, pb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    cats = F.lit(max(len(categories) - 1, 1)) if categories else None
    grid = pa.crossJoin(pb).join(c, ["a", "b"], "left").crossJoin(total)  # categories by categories
    gap = F.abs(F.col("a") - F.col("b"))
    weight = gap / cats if weighted and categories else gap.cast("double") if weighted else (gap > 0).cast("double")
    parts = grid.agg(F.sum(weight * F.coalesce("n", F.lit(0)) / F.col("t")).alias("seen"), F.sum(weight * F.col("na") * F.col("nb") / (F.col("t") * F.col("t"))).alias("chance"), F.sum(F.when(gap == 0, F.coalesce("n", F.lit(0)))).alias("same"), F.max("t").alias("n"))
    edge = F.when(F.col("seen") == 0, 1.0).otherwise(0.0) if degenerate == "agreement" else F.lit(None).cast("double")
    k = F.round(F.when(F.col("chance") == 0, edge).otherwise(1 - F.col("seen") / F.col("chance")), 4)
    return parts.select("n", F.round(F.col("same") / F.col("n"), 4).alias("exact"), k.alias("kappa"), kappa_band(k).alias("band"))


def kappa_band(k: Column) -> Column:
    """AGG-23."""
    return F.when(k.isNull(), "undefined").when(k < 0, "worse than chance").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """AGG-12: ``struct<low, high>``, clamped; null without trials."""
    p = successes / n
    mid, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    d = 1 + z * z / n
    low, high = F.greatest((mid - spread) / d, F.lit(0.0)), F.least((mid + spread) / d, F.lit(1.0))
    return F.when(n > 0, F.struct(F.round(low, 4).alias("low"), F.round(high, 4).alias("high")))


def task_summary(rows: DataFrame) -> DataFrame:
    """AGG-11: passes overall, by kind and by variant, with intervals."""
    g = rows.groupingSets([[], ["kind"], ["variant"]], "kind", "variant").agg(F.count("*").alias("tasks"), F.sum(F.col("passed").cast("long")).alias("passes"), mean("steps").alias("mean_steps"))
    w = wilson(F.col("passes"), F.col("tasks"))
    return g.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("variant", F.lit("*")).alias("variant"), "tasks", "passes", F.round(F.col("passes") / F.col("tasks"), 4).alias("rate"), w["low"].alias("low"), w["high"].alias("high"), "mean_steps")


def rule_vs_judge(rows: DataFrame, term: str, rule: str, judge: str) -> DataFrame:
    """AGG-24: by term, the rule against the judge over decided rows; abstentions apart."""
    r, j = F.col(rule), F.col(judge)
    return rows.where(j.isNotNull()).groupBy(term).agg(
        F.count("*").alias("pairs"), F.count(r).alias("decided"), F.count_if(r.isNull()).alias("abstained"), share(F.when(r.isNotNull(), r == j)).alias("agreement"),
        F.count_if(j & ~r).alias("missed"), F.count_if(~j & r).alias("overfired"),
    )


def answer_support(answer: str | Column, sources: str | Column, question: str | Column, keep: str = r"[^\x{4e00}-\x{9fff}]", least: int = 8) -> Column:
    """AGG-30: the share of an answer's bigrams, those of the question left out, that the sources have; null if too few."""
    own = F.array_except(X.bigrams(answer, keep), X.bigrams(question, keep))
    share_of = lambda o: F.when(F.size(o) >= least, F.round(F.size(F.array_intersect(o, X.bigrams(sources, keep))) / F.size(o), 4))
    return F.transform(F.array(own), share_of)[0]


def disagreements(rows: DataFrame, a: str, b: str, gap: int = 2) -> DataFrame:
    """JON-11."""
    d = F.abs(F.col(a) - F.col(b))
    return rows.where(d >= gap).withColumn("gap", d)


def first_anchor(anchors: DataFrame, titles: DataFrame) -> DataFrame:
    """JON-03: the first title, in table order, that an anchor begins.

    Both sides meet on the beginning of the anchor and on its length, one join key for each length that an anchor has
    (a few dozen), so neither side is broadcast and titles that no anchor begins leave nothing. Titles with one key are
    brought down to their first before the join.
    """
    key = anchors.select("query_id", "anchor", X.normalize_title("anchor").alias("k")).where("k <> ''")
    lengths = key.agg(F.array_sort(F.collect_set(F.char_length("k"))).alias("sizes"))  # one row
    t = titles.select("novel_id", "ordinal", X.normalize_title("title").alias("t")).crossJoin(F.broadcast(lengths))
    begun = t.select("novel_id", "ordinal", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.char_length("t")), lambda n: F.substring(F.col("t"), F.lit(1), n))).alias("k"))
    first = begun.groupBy("k").agg(F.min_by("novel_id", F.struct("ordinal", "novel_id")).alias("novel_id"))
    return key.join(first, "k").select("query_id", "anchor", "novel_id")


#: So many characters of a title are looked up in a query.
TITLE_HEAD = 12


def find_titles(queries: DataFrame, titles: DataFrame, limit: int = 3) -> DataFrame:
    """FLT-25, TOOL-01: the exact title, or else titles of three characters and more that the query holds, longest
    first, ties by id from the largest. Candidates are titles whose first ``TITLE_HEAD`` characters stand in the query,
    shorter ones whole, so titles that only begin alike don't meet under one key."""
    q = queries.withColumn("k", X.title_key("query"))
    exact = q.join(titles, F.col("k") == F.col("key")).select("query_id", "novel_id", "key", F.lit(0).alias("tier"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("k") - 2, F.lit(1)))
    sizes = F.sequence(F.lit(3), F.lit(TITLE_HEAD))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.char_length("k")), lambda n: F.substring(F.col("k"), i, n))))
    asked = q.select("query_id", "k", F.explode(F.array_distinct(grams)).alias("g"))
    begins = titles.where(F.char_length("key") >= 3).select("novel_id", "key", F.substring("key", 1, TITLE_HEAD).alias("g"))
    held = asked.join(begins, "g").where(F.contains("k", F.col("key"))).select("query_id", "novel_id", "key", F.lit(1).alias("tier"))
    held = held.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    w = Window.partitionBy("query_id").orderBy("tier", F.desc(F.char_length("key")), F.desc("novel_id"))
    return exact.unionByName(held).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "novel_id", "place")


def promote(ranked: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """TOOL-01: exact titles come first, with a score of one; the rest follow in their order."""
    rest = ranked.join(exact.select("query_id", "novel_id"), ["query_id", "novel_id"], "left_anti").select("query_id", "novel_id", "score", F.lit(1).alias("tier"), F.col("rank").alias("pos"))
    rows = exact.select("query_id", "novel_id", F.lit(1.0).alias("score"), F.lit(0).alias("tier"), F.col("place").alias("pos")).unionByName(rest)
    w = Window.partitionBy("query_id").orderBy("tier", "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "novel_id", "score", "rank")


def covers(checked: str | Column, term: str | Column) -> Column:
    """FLT-23, FLT-24: one holds the other, for any checked term."""
    t = F.col(term) if isinstance(term, str) else term
    return F.exists(checked, lambda x: F.contains(x, t) | F.contains(t, x))


def budget_cut(rows: DataFrame, order: list[str], cost: str | Column, cap: float, group: str) -> DataFrame:
    """MTH-03: rows with their running cost by group, and whether they stay within the cap."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum(cost).over(w), 6)
    return rows.withColumn("spent", spent).withColumn("within", F.col("spent") <= cap)


def prompt_tokens(evidence: str | Column, query: str | Column) -> Column:
    """MTH-01."""
    n = lambda c: F.char_length(F.col(c) if isinstance(c, str) else c)
    return (F.lit(450) + n(evidence) / 1.4 + n(query) / 1.4).cast("long")


def cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    """MTH-02."""
    return (prompt * per_million_in + completion * per_million_out) / 1e6
