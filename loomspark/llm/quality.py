"""Quality rules: distribution divergence from language references (Jensen-Shannon distance).

A document's histogram over character classes, and over the common words of its language, is compared with the
reference of that language. References are fitted apart from the documents that are judged, on a bounded number of
documents that people have labelled clean: the mean of their normalised histograms, so one long document weighs no more
than another. They are a small table that can be stored and used for other corpora.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, map_rows

# Common words by language (fixed values: frequent function words).
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be at this by from or an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une est que pour qui dans a par plus pas au sur ne avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como es son".split(),
}

#: Character classes by the bytes of UTF-8; continuation bytes count nowhere.
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "pause", "quote", "symbol", "control", "latin", "wide", "astral"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), dtype=np.uint8)
    at = {c: i for i, c in enumerate(CLASSES)}
    for b in range(128):
        c = chr(b)
        kind = (
            "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "line" if c == "\n" else "space" if c.isspace()
            else "control" if not c.isprintable() else "stop" if c in ".!?" else "pause" if c in ",;:-" else "quote" if c in "'\"()" else "symbol"
        )
        table[b] = at[kind]
    table[0xC0:0xE0], table[0xE0:0xF0], table[0xF0:0xF8] = at["latin"], at["wide"], at["astral"]
    return table


_TABLE = _class_table()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x100000001B3) + x[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    edge[:n] += hit
    edge[width : width + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class QualityRules:
    """Parameters. Distances are judged only where the document is long enough. A reference that rests on few documents
    is trusted in proportion ``n / (n + trust_docs)``: distances from it count for that share of themselves.
    ``max_labelled`` bounds the labelled documents that references are fitted on."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_chars_for_classes: int = 200
    min_words_for_common: int = 100
    max_class_distance: float = 0.32
    max_common_distance: float = 0.31
    trust_docs: int = 10
    max_labelled: int = 5_000
    window: int = 8
    words: dict = field(default_factory=lambda: COMMON_WORDS)


STAT_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_stats(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """Base counts of one text; a null text counts as having no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    ids: dict = {}
    arr = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode().strip():
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, "#*$%&|<>")),
        dup,
        repeated_words(arr, window),
    )


#: What is taken off both ends of a word before it is looked up among the common ones: the punctuation of ASCII.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _histograms(text: str | None, lang: str | None, words: dict) -> tuple[list[int], list[int] | None]:
    """Counts over character classes, and over the language's common words and one more class for all other words. Words
    are the base rules' words in lower case, punctuation off both ends."""
    raw = (text or "").encode()
    classes = np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)].tolist()
    common = words.get(lang) if lang else None
    if common is None:
        return classes, None
    at = {w.encode(): i for i, w in enumerate(common)}
    hist = [0] * (len(common) + 1)
    for w, n in Counter(raw.lower().split()).items():
        hist[at.get(w if w in at else w.strip(_PUNCTUATION), len(common))] += n
    return classes, hist


def features(docs: DataFrame, rules: QualityRules, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, the base verdict and both histograms for each document (one Arrow pass)."""
    window, words, least, most = rules.window, rules.words, rules.min_words, rules.max_repeat_percent
    width = max(map(len, words.values())) + 1

    def fn(columns):
        for t, g in zip(*columns):
            stats = document_stats(t, window)
            classes, common = _histograms(t, g, words)
            yield (*stats, stats[0] < least or 100 * stats[4] > most * stats[0], classes, common and common + [0] * (width - len(common)))

    source = docs if lang in docs.columns else docs.withColumn(lang, F.lit(None).cast("string"))
    out = f"{STAT_FIELDS}, base_failed boolean, {P}classes array<long>, {P}common array<long>"
    return map_rows(source, [text, lang], fn, out, keep=list(dict.fromkeys([*keep, lang])))


def references(docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row per language of ``rules.words`` that has labelled documents: its mean histograms, and their number.

    Labelled clean are documents with ``quality`` 1 that also pass the base rules; of more than ``max_labelled``, those with
    the least hashes of their ids are taken. Rows without an id or a label, and labels without a document, count nowhere;
    repeated rows count as often as they stand there. Without labels the result is empty.
    """
    rules = rules or QualityRules()
    width = max(map(len, rules.words.values())) + 1
    clean = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias(f"{P}id")).where(f"{P}id is not null").distinct()
    clean = clean.orderBy(F.xxhash64(f"{P}id"), f"{P}id").limit(rules.max_labelled)
    chosen = docs.select(F.col(doc_id).alias(f"{P}id"), text, *[c for c in (lang,) if c in docs.columns]).join(F.broadcast(clean), f"{P}id", "left_semi")  # bounded by the parameter
    ok = features(chosen, rules, [], text, lang).where(~F.col("base_failed") & F.col(lang).isin(*rules.words))

    def share(name: str, i: int, total: Column) -> Column:
        return F.avg(F.when(total > 0, F.col(name)[i] / total))

    sums = {n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) for n in (f"{P}classes", f"{P}common")}
    return ok.groupBy(F.col(lang).alias("lang")).agg(
        F.count("*").alias("docs"),
        F.array(*[share(f"{P}classes", i, sums[f"{P}classes"]) for i in range(len(CLASSES))]).alias("classes"),
        F.array(*[share(f"{P}common", i, sums[f"{P}common"]) for i in range(width)]).alias("common"),
    )


def js_distance(hist: str, ref: str) -> Column:
    """Jensen-Shannon distance (base 2) between a count array and a reference of shares; null where either is empty."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    p = F.transform(hist, lambda x: x / total)

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, F.col(ref), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    half = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(half, F.lit(0.0))))


def judge(docs: DataFrame, reference: DataFrame, rules: QualityRules | None = None, keep: list[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, distances and the verdict ``kept`` beside the ``keep`` columns (all by default), in one pass.

    ``reference`` is what :func:`references` returns: at most one row per language of ``rules.words``.
    Null or empty texts have no words and fail the base rules. A language without a reference (unknown, null, or not
    labelled) and a document under the minimum length get null distances and are judged by the base alone. Very long texts
    are judged whole, and repeated rows alike; nothing is compared between rows, so there are no ties. An empty table
    gives an empty result. Input columns named like a result give way.
    """
    rules = rules or QualityRules()
    keep = docs.columns if keep is None else keep
    feats = features(docs, rules, keep, text, lang)
    ref = reference.select(F.col("lang").alias(f"{P}lang"), F.col("docs").alias(f"{P}docs"), F.col("classes").alias(f"{P}ref_classes"), F.col("common").alias(f"{P}ref_common"))
    joined = feats.join(F.broadcast(ref), F.col(lang) == F.col(f"{P}lang"), "left")  # as many rows as there are languages
    trust = F.col(f"{P}docs") / (F.col(f"{P}docs") + rules.trust_docs)
    n_chars = F.aggregate(f"{P}classes", F.lit(0).cast("long"), lambda a, x: a + x)
    class_d = F.when(n_chars >= rules.min_chars_for_classes, js_distance(f"{P}classes", f"{P}ref_classes") * trust)
    common_d = F.when(F.col("n_words") >= rules.min_words_for_common, js_distance(f"{P}common", f"{P}ref_common") * trust)
    kept_columns = [c for c in keep if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept"}]
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("common_distance", F.lit(0.0)) > rules.max_common_distance)
    return joined.select(
        *kept_columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        class_d.alias("class_distance"), common_d.alias("common_distance"),
    ).withColumn("kept", ~F.col("base_failed") & ~far)
