"""Evaluation tasks as tables: every draw is an expression of a seed, the task's number and the draw's name.

A checksum of those three is a random number that any machine computes alike, so tasks need no generator that is passed on, and
more tasks never change earlier ones. Choosing several without replacement is ordering the options by their checksums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon
from .evaluation import EXPECT, TASKS

_STRINGS = "array<string>"


@dataclass(frozen=True)
class TaskWords:
    """What tasks are made of. Themes are wishes by genre; a genre's own terms are never excluded from it. Templates name their
    parts in braces."""

    themes: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"仙侠": ("慢热", "宗门", "谨慎"), "都市": ("职场", "轻松", "节奏快"), "科幻": ("太空", "硬核", "文明"), "历史": ("权谋", "考据", "朝堂")})
    own_terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"仙侠": ("修仙", "修真"), "科幻": ("机甲",)})
    requests: tuple[str, ...] = ("请找{genre}书：{feats}；{negs}。", "我要{genre}，{feats}，{negs}。")
    exclusions: tuple[str, ...] = ("不要{neg}", "排除{neg}")
    plain: tuple[str, ...] = ("请找{genre}书，{feats}。", "我要{feats}的{genre}。")
    remember: str = "请一直记住：不要{neg}。"
    remember_and: str = "请一直记住：不要{neg}。现在找{genre}。"
    once: str = "只是今天不要{neg}。现在找{genre}。"
    again: str = "现在找{genre}。"
    more: tuple[str, ...] = ("请换一批。", "还要别的。")
    refer: tuple[str, ...] = ("说说第二本。", "第二本写什么？")
    exclude: tuple[str, ...] = ("第一本看过，请换。", "不要第一本。")
    vague: tuple[str, ...] = ("找书。", "有书吗？", "看什么？", "请推荐。", "没书看了。")
    chapter_question: tuple[str, ...] = ("《{title}》的「{chapter}」写了什么？", "「{chapter}」（《{title}》）里有什么事？")
    quote_question: tuple[str, ...] = ("《{title}》哪一章有「{quote}」？", "「{quote}」在《{title}》的哪里？")
    opening_question: tuple[str, ...] = ("《{title}》怎样开始？",)
    ending_question: tuple[str, ...] = ("《{title}》怎样结束？",)


class Draws:
    """Numbers and choices of one row, by name."""

    def __init__(self, seed: int, row: Column):
        self.seed, self.row = F.lit(str(seed)), row.cast("string")

    def _sum(self, name: str | Column, *more: Column) -> Column:
        return F.md5(F.concat_ws("|", self.seed, self.row, F.lit(name), *more))

    def below(self, n: int | Column, name: str | Column) -> Column:
        """A number from 0 up to ``n``, which is left out; null for none."""
        count = F.lit(n).cast("long")
        return F.when(count > 0, F.conv(F.substring(self._sum(name), 1, 12), 16, 10).cast("long") % count)

    def one(self, options: Column | tuple[str, ...], name: str | Column) -> Column:
        options = F.array(*map(F.lit, options)) if isinstance(options, tuple) else options
        return F.get(options, self.below(F.size(options), name).cast("int"))

    def several(self, options: Column | tuple[str, ...], k: int | Column, name: str) -> Column:
        """``k`` different options in random order, or all of them if they are fewer."""
        options = F.array(*map(F.lit, options)).cast(_STRINGS) if isinstance(options, tuple) else options
        ordered = F.array_sort(F.transform(F.array_distinct(options), lambda o: F.struct(self._sum(name, o).alias("h"), o.alias("o"))))
        return F.slice(F.transform(ordered, lambda x: x["o"]), F.lit(1), F.lit(k).cast("int"))


def _filled(template: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def _expect(**given: Column | int | bool) -> Column:
    kinds = dict(x.split(":", 1) for x in EXPECT.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*[(F.lit(given[n]) if n in given else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def _session(message: Column, **expected) -> Column:
    return F.struct(message.alias("user_message"), _expect(**expected).alias("expect"))


def _task(rows: DataFrame, prefix: str, start: int, kind: str, variant: Column, sessions: Column, positives: Column, in_text: Column | None = None, meta: Column | None = None, **more: Column) -> DataFrame:
    none = F.array().cast(_STRINGS)
    name = F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("id") + start).cast("string"), 3, "0"))
    named = F.when(F.col("id") + start < 1000, name).otherwise(F.concat(F.lit(f"{prefix}-"), (F.col("id") + start).cast("string")))
    types = dict(rows.sparkSession.createDataFrame([], TASKS).dtypes)
    return rows.select(
        named.alias("task_id"), F.lit(kind).alias("kind"), variant.alias("variant"), F.lit("").alias("split"), (none if in_text is None else in_text).alias("negatives_in_text"),
        (none if meta is None else meta).alias("negatives_meta"), sessions.cast(types["sessions"]).alias("sessions"), positives.alias("positives"), *[c.alias(n) for n, c in more.items()],
    )


def _genre(d: Draws, words: TaskWords, name: str = "genre") -> Column:
    return d.one(tuple(sorted(words.themes)), name)


def _themes(words: TaskWords, genre: Column) -> Column:
    return F.element_at(F.create_map(*[x for g, t in words.themes.items() for x in (F.lit(g), F.array(*map(F.lit, t)))]), genre)


def _terms(lex: Lexicon, words: TaskWords, *genres: Column) -> Column:
    """In-text terms that none of the genres implies."""
    pool = F.array(*map(F.lit, sorted(lex.term_forms)))
    for g, own in words.own_terms.items():
        hit = F.array_contains(F.array(*genres), g)
        pool = F.when(hit, F.array_except(pool, F.array(*map(F.lit, own)))).otherwise(pool)
    return pool


def _variant(names: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int"))


def constrained(spark: SparkSession, n: int, seed: int = 0, prefix: str = "rec", start: int = 0, words: TaskWords = TaskWords(), lex: Lexicon = Lexicon()) -> DataFrame:
    """GEN-01: a third each with exclusions that texts show, with labels from outside, and with one of each."""
    rows, d = spark.range(n), Draws(seed, F.col("id") + start)
    variant = _variant(("in_text", "meta", "mixed"))
    genre = _genre(d, words)
    feats = d.several(_themes(words, genre), 1 + d.below(3, "n_feats"), "feats")
    many = lambda name: F.when(variant == "mixed", F.lit(1)).otherwise(1 + d.below(2, name)).cast("int")
    none = F.array().cast(_STRINGS)
    rows = rows.select("id", variant.alias("variant"), genre.alias("genre"), feats.alias("feats"))
    rows = rows.withColumns({
        "in_text": F.when(F.col("variant") != "meta", d.several(_terms(lex, words, F.col("genre")), many("n_text"), "text")).otherwise(none),
        "meta": F.when(F.col("variant") != "in_text", d.several(tuple(sorted(lex.meta_labels)), many("n_meta"), "meta")).otherwise(none),
    }).withColumn("negs", d.several(F.concat("in_text", "meta"), 9, "order"))
    phrases = F.transform("negs", lambda x, i: _filled(d.one(words.exclusions, F.concat(F.lit("phrase"), i.cast("string"))), neg=x))
    message = _filled(d.one(words.requests, "request"), genre=F.col("genre"), feats=F.array_join("feats", "、"), negs=F.array_join(phrases, "，"))
    sessions = F.array(_session(message, min_recommendations=3))
    return _task(rows, prefix, start, "constrained_rec", F.col("variant"), sessions, F.concat(F.array("genre"), "feats"), F.col("in_text"), F.col("meta"))


def memory(spark: SparkSession, n: int, seed: int = 0, prefix: str = "mem", start: int = 0, words: TaskWords = TaskWords(), lex: Lexicon = Lexicon()) -> DataFrame:
    """GEN-02: an exclusion that is to last, two of them told one after the other, and one for this time only."""
    d = Draws(seed, F.col("id") + start)
    rows = spark.range(n).select("id", _variant(("persist", "accumulate", "oneoff")).alias("variant"), d.several(tuple(sorted(words.themes)), 2, "genres").alias("g"))
    rows = rows.withColumn("t", d.several(_terms(lex, words, F.col("g")[0], F.col("g")[1]), 2, "terms"))
    g, t = F.col("g"), F.col("t")
    one, two = F.array(t[0]), F.array(t[1])
    fill = lambda template, **p: _filled(F.lit(template), **p)
    persist = F.array(_session(fill(words.remember_and, neg=t[0], genre=g[0]), persist=one, min_recommendations=1), _session(fill(words.again, genre=g[1]), must_pass=one, min_recommendations=1))
    accumulate = F.array(_session(fill(words.remember, neg=t[0]), persist=one), _session(fill(words.remember, neg=t[1]), persist=two), _session(fill(words.again, genre=g[0]), must_pass=t, min_recommendations=1))
    oneoff = F.array(_session(fill(words.once, neg=t[0], genre=g[0]), must_not_persist=one, must_pass=one, min_recommendations=1), _session(fill(words.again, genre=g[1]), must_not_persist=one, min_recommendations=1))
    v = F.col("variant")
    return _task(rows, prefix, start, "memory", v, F.when(v == "persist", persist).when(v == "accumulate", accumulate).otherwise(oneoff), g, F.when(v == "accumulate", t).otherwise(one))


def session_state(spark: SparkSession, n: int, seed: int = 0, prefix: str = "ses", start: int = 0, words: TaskWords = TaskWords()) -> DataFrame:
    """GEN-04: a plain request, then one that only its answer makes sense of: others, the second one, not the first one."""
    d = Draws(seed, F.col("id") + start)
    genre = _genre(d, words)
    rows = spark.range(n).select("id", _variant(("more", "refer", "exclude")).alias("variant"), genre.alias("genre"), d.several(_themes(words, genre), 1 + d.below(2, "n_feats"), "feats").alias("feats"))
    first = _session(_filled(d.one(words.plain, "first"), genre=F.col("genre"), feats=F.array_join("feats", "、")), min_recommendations=3)
    v = F.col("variant")
    follow = (
        F.when(v == "more", _session(d.one(words.more, "follow"), min_recommendations=3, disjoint_from=0))
        .when(v == "refer", _session(d.one(words.refer, "follow"), refers_to=2))
        .otherwise(_session(d.one(words.exclude, "follow"), min_recommendations=1, exclude_index=1))
    )
    return _task(rows, prefix, start, "session_state", v, F.array(first, follow), F.concat(F.array("genre"), "feats"))


def clarify(spark: SparkSession, n: int, seed: int = 0, prefix: str = "clr", start: int = 0, words: TaskWords = TaskWords()) -> DataFrame:
    """GEN-05: requests too vague to act on, each phrase once; more tasks than phrases are an error."""
    if n > len(set(words.vague)):
        raise ValueError(f"{n} tasks, and {len(set(words.vague))} phrases")
    phrases = Draws(seed, F.lit("all")).several(words.vague, len(words.vague), "vague")
    rows = spark.range(n).withColumn("phrase", F.get(phrases, F.col("id").cast("int")))
    return _task(rows, prefix, start, "clarify", F.lit("vague"), F.array(_session(F.col("phrase"), max_recommendations=0)), F.array().cast(_STRINGS))


def eligible_books(books: DataFrame, least: int = 12) -> DataFrame:
    """Books ``(novel_id, title, chapters array<struct<kind,heading,text>>, sampled_titles)`` of three letters or more in a title
    that no other book has, with ``least`` chapters or more, all of them numbered. Titles lose their brackets."""
    title = F.trim(F.regexp_replace(F.trim(F.coalesce("title", F.lit(""))), "^[《》〈〉<>]+|[《》〈〉<>]+$", ""))
    named = books.withColumn("title", title)
    unique = named.groupBy("title").agg(F.count("*").alias("n")).where("n = 1").select("title")
    good = (F.char_length("title") >= 3) & (F.size("chapters") >= least) & F.forall("chapters", lambda c: X.chapter_number(c["heading"]).isNotNull())
    return named.where(good).join(unique, "title", "left_semi")


def quotable(chapters: Column, place: Column, least: int = 16, most: int = 48) -> Column:
    """Lines of a chapter, its heading left out, that no other chapter holds: of a length that can be quoted, mostly Chinese
    characters, and no headings of chapters themselves."""
    own = F.get(chapters, place)["text"]
    lines = F.transform(F.slice(F.split(own, "\n"), F.lit(2), F.greatest(F.size(F.split(own, "\n")) - 1, F.lit(0))), lambda x: F.trim(x))
    others = F.filter(chapters, lambda c, i: i != place)
    han = lambda x: F.char_length(F.regexp_replace(x, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.filter(lines, lambda x: F.char_length(x).between(least, most) & ~(F.contains(x, F.lit("第")) & F.contains(x, F.lit("章"))) & (han(x) >= 0.7 * F.char_length(x)) & ~F.exists(others, lambda c: F.contains(c["text"], x)))


def book_qa(books: DataFrame, n: int, seed: int = 0, prefix: str = "qa", words: TaskWords = TaskWords(), least: int = 12) -> DataFrame:
    """GEN-03: a question on each of ``n`` books: on a chapter, on a line that one chapter alone has, on the opening, on the
    ending, and on a chapter of which only the title is known; the digest says where the answer lies.

    Books are drawn by the checksum of their id, so only ``n`` of them come together. A kind that a book cannot serve becomes
    a question on a chapter. Fewer eligible books than ``n`` are an error.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("novel_id").cast("string")))
    chosen = eligible_books(books, least).withColumn("__o", order).orderBy("__o", "novel_id").limit(n)
    rows = chosen.withColumn("id", (F.row_number().over(Window.orderBy("__o", "novel_id")) - 1).cast("long"))  # n rows
    found = rows.count()
    if found < n:
        raise ValueError(f"{found} eligible books for {n} tasks")
    d, chapters = Draws(seed, F.col("id")), F.col("chapters")
    held = F.transform(chapters, lambda c: X.chapter_number(c["heading"]))
    outside = F.filter(F.coalesce("sampled_titles", F.array().cast(_STRINGS)), lambda t: X.chapter_number(t).isNotNull() & ~F.array_contains(F.col("__held"), X.chapter_number(t)))
    places = F.transform(F.sequence(F.lit(0), F.size(chapters) - 1), lambda i: F.struct(F.md5(F.concat_ws("|", d.seed, d.row, F.lit("order"), i.cast("string"))).alias("h"), i.alias("i"), quotable(chapters, i).alias("q")))
    quoted = F.get(F.array_sort(F.filter(places, lambda p: F.size(p["q"]) > 0)), F.lit(0))
    rows = rows.withColumn("__held", held).withColumn("__wish", _variant(("chapter_event", "quote_locate", "opening", "ending", "out_of_coverage")))
    rows = rows.withColumns({"__q": F.when(F.col("__wish") == "quote_locate", quoted), "__outside": F.when(F.col("__wish") == "out_of_coverage", d.one(outside, "outside"))})
    missing = ((F.col("__wish") == "quote_locate") & F.col("__q").isNull()) | ((F.col("__wish") == "out_of_coverage") & F.col("__outside").isNull())
    rows = rows.withColumn("variant", F.when(missing, "chapter_event").otherwise(F.col("__wish"))).withColumn("__heading", d.one(F.transform(chapters, lambda c: c["heading"]), "chapter")).withColumn("__quote", d.one(F.col("__q")["q"], "quote"))
    v = F.col("variant")
    chapter = F.when(v == "chapter_event", F.col("__heading")).when(v == "quote_locate", F.get(chapters, F.col("__q")["i"])["heading"]).when(v == "out_of_coverage", F.col("__outside"))
    by_kind = F.transform(F.filter(chapters, lambda c: c["kind"] == v), lambda c: c["heading"])
    gold = F.when(v.isin("opening", "ending"), by_kind).when(v == "out_of_coverage", F.array().cast(_STRINGS)).otherwise(F.array(chapter))
    ask = (
        F.when(v == "quote_locate", d.one(words.quote_question, "ask")).when(v == "opening", d.one(words.opening_question, "ask"))
        .when(v == "ending", d.one(words.ending_question, "ask")).otherwise(d.one(words.chapter_question, "ask"))
    )
    message = _filled(ask, title=F.col("title"), chapter=F.coalesce(chapter, F.lit("")), quote=F.coalesce("__quote", F.lit("")))
    sessions = F.array(_session(message, novel_id=F.col("novel_id").cast("string"), answerable=v != "out_of_coverage", gold_chapters=gold))
    meta = F.struct(F.col("novel_id").cast("string").alias("novel_id"), F.col("title").alias("title"), chapter.alias("chapter"), F.col("__quote").alias("quote"))
    return _task(rows, prefix, 0, "book_qa", v, sessions, F.array("title"), meta_facts=meta)
