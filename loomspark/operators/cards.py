"""Cards of books: filters, rules over densities, re-ranking, vocabulary counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import ELEMENT_ALIASES, ELEMENT_GROUPS, ELEMENT_TO_STYLE, ELEMENTS, GENRE_TREE, STYLE_NOTES, STYLES, SUBGENRE_ALIASES, SUBGENRE_NOTES, TROPE_RULES, Lexicon

VIOLATION_DENSITY = 3.0
CLEAN_DENSITY = 1.0


def violation(density: str | Column) -> Column:
    """FLT-01: true from the upper bound on, false up to the lower, null between: undecided is not false."""
    d = F.col(density) if isinstance(density, str) else density
    return F.when(d >= VIOLATION_DENSITY, True).when(d <= CLEAN_DENSITY, False)


def merged_from_map(densities: str, forms: tuple[str, ...]) -> Column:
    """FLT-04: the sum of a term's forms in a map; a missing form counts nothing."""
    return sum((F.coalesce(F.element_at(densities, f), F.lit(0.0)) for f in forms), F.lit(0.0))


def violation_by_terms(densities: str, terms: list[str], lex: Lexicon) -> Column:
    """FLT-02, FLT-03, FLT-07, AGG-13: the largest merged density over the decidable terms; null without any, or without a row."""
    known = [t for t in terms if t in lex.term_forms]
    if not known:
        return F.lit(None).cast("boolean")
    parts = [merged_from_map(densities, lex.term_forms[t]) for t in known]
    return F.when(F.col(densities).isNotNull(), violation(F.greatest(*parts) if len(parts) > 1 else parts[0]))


def is_checkable(term: str | Column, lex: Lexicon) -> Column:
    """FLT-05."""
    t = F.col(term) if isinstance(term, str) else term
    return F.trim(t).isin(*lex.term_forms)


def split_negatives(terms: str | Column, lex: Lexicon) -> Column:
    """FLT-06: ``struct<in_text, meta>``; blanks go."""
    t = F.filter(F.col(terms) if isinstance(terms, str) else terms, lambda x: F.trim(x) != "")
    return F.struct(F.filter(t, lambda x: is_checkable(x, lex)).alias("in_text"), F.filter(t, lambda x: ~is_checkable(x, lex)).alias("meta"))


def density_flags(densities: str, terms: list[str], lex: Lexicon) -> Column:
    """UDF-11: each term with the word for its verdict."""
    word = lambda t: F.coalesce(F.when(violation(merged_from_map(densities, lex.term_forms[t])), "violates").when(~violation(merged_from_map(densities, lex.term_forms[t])), "clean"), F.lit("unclear"))
    return F.array(*[F.concat(F.lit(f"{t}="), word(t)) for t in terms if t in lex.term_forms])


@dataclass(frozen=True)
class Vocabulary:
    """Genres with sub-genres, elements, styles, and other names for them."""

    genres: dict[str, tuple[str, ...]] = field(default_factory=lambda: GENRE_TREE)
    elements: tuple[str, ...] = ELEMENTS
    styles: dict[str, tuple[str, ...]] = field(default_factory=lambda: STYLES)
    subgenre_aliases: dict[str, str] = field(default_factory=lambda: SUBGENRE_ALIASES)
    element_aliases: dict[str, str] = field(default_factory=lambda: ELEMENT_ALIASES)
    element_styles: dict[str, tuple[str, str]] = field(default_factory=lambda: ELEMENT_TO_STYLE)
    element_groups: dict[str, dict[str, str]] = field(default_factory=lambda: ELEMENT_GROUPS)
    subgenre_notes: dict[str, str] = field(default_factory=lambda: SUBGENRE_NOTES)
    style_notes: dict[str, str] = field(default_factory=lambda: STYLE_NOTES)
    unknown: str = "其他"

    def text(self) -> str:
        """TXT-44: the vocabulary as a model is shown it (headings are fixed values)."""
        defined = lambda table: [f"- {k}：{v}" for k, v in table.items()]
        subs = [f"{g}：{'、'.join(s)}" for g, s in self.genres.items()]
        parts = [["【题材二级，只能选一个；每行冒号前是一级，不要填一级】", *subs, "容易混的二级怎么分：", *defined(self.subgenre_notes)]]
        parts.append(["【元素，多选，只列出有的；每条后面是算有的依据】", *[line for name, group in self.element_groups.items() for line in (f"{name}：", *defined(group))]])
        parts.append(["【风格，每项只能选一档】", *[f"- {dim}：{' / '.join(o)}（{self.style_notes.get(dim, '')}）" for dim, o in self.styles.items()]])
        return "\n\n".join("\n".join(p) for p in parts)

    def genre_of(self, subgenre: str) -> str | None:
        """JSN-19."""
        return next((g for g, subs in self.genres.items() if subgenre in subs), None)

    def resolve_genre(self, value: str) -> tuple[str | None, str | None]:
        """FLT-11: (genre, sub-genre) of a name; an element's name gets told where it belongs."""
        value = value.strip()
        if value in self.genres:
            return value, None
        sub = self.subgenre_aliases.get(value, value)
        if (genre := self.genre_of(sub)) is not None:
            return genre, sub
        if value in self.elements or value in self.element_aliases:
            raise ValueError(f"{value!r} is an element; pass it as one. Genres: {', '.join(self.genres)}")
        raise ValueError(f"unknown genre {value!r}. Genres: {', '.join(self.genres)}")

    def resolve_element(self, value: str) -> str:
        """FLT-12."""
        name = self.element_aliases.get(value.strip(), value.strip())
        if name not in self.elements:
            raise ValueError(f"unknown element {value!r}. Elements: {', '.join(self.elements)}")
        return name

    def resolve_style(self, value: str) -> tuple[str, str]:
        """FLT-13: ``dimension=option`` with any of four signs between, or an option that one dimension alone has."""
        for sign in "=：:/":
            if sign in value:
                dim, option = (p.strip() for p in value.split(sign, 1))
                if option in self.styles.get(dim, ()):
                    return dim, option
                raise ValueError(f"unknown style {value!r}. Styles: {self.styles}")
        found = [d for d, options in self.styles.items() if value.strip() in options]
        if len(found) != 1:
            raise ValueError(f"unknown or ambiguous style {value!r}. Styles: {self.styles}")
        return found[0], value.strip()


@dataclass(frozen=True)
class CardFilter:
    """FLT-10: resolved filter values; equal values once, in order."""

    genre: str | None = None
    subgenre: str | None = None
    elements: tuple[str, ...] = ()
    style: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, vocabulary: Vocabulary, genre: str | None = None, elements: list[str] | None = None, style: list[str] | None = None) -> CardFilter:
        g, s = vocabulary.resolve_genre(genre) if genre and genre.strip() else (None, None)
        return cls(g, s, tuple(dict.fromkeys(map(vocabulary.resolve_element, elements or ()))), tuple(dict.fromkeys(map(vocabulary.resolve_style, style or ()))))

    def matches(self) -> Column:
        """FLT-08: the predicate over card columns."""
        ok = F.lit(True)
        if self.subgenre:
            ok = ok & (F.col("subgenre") == self.subgenre)
        elif self.genre:
            ok = ok & (F.col("genre") == self.genre)
        if self.elements:
            ok = ok & (F.size(F.array_except(F.array(*map(F.lit, self.elements)), F.array_union("elements", "elements_unverified"))) == 0)
        for dim, option in self.style:
            ok = ok & (F.element_at("style", F.lit(dim)) == option)
        return F.coalesce(ok, F.lit(False))

    def describe(self) -> str:
        """FLT-10: the values, for people to read."""
        parts = {"genre": "/".join(x for x in (self.genre, self.subgenre) if x), "elements": "、".join(self.elements), "style": "、".join(f"{d}={o}" for d, o in self.style)}
        return "; ".join(f"{k} {v}" for k, v in parts.items() if v)

    def select(self, cards: DataFrame) -> DataFrame:
        """FLT-09: ids of matching cards."""
        return cards.where(self.matches()).select("novel_id")


def label(genre: str = "genre", subgenre: str = "subgenre") -> Column:
    """FLT-14."""
    return F.concat_ws("·", F.nullif(F.col(genre), F.lit("")), F.nullif(F.col(subgenre), F.lit("")))


def card_rerank(rows: DataFrame, cards: DataFrame, genres: list[str], subgenres: list[str], elements: list[str], k: int, query: str | None = None) -> DataFrame:
    """WIN-05: over-sampled rows in new order: sub-genre hits, genre hits, the rest; then elements, then the old rank.

    Without genre targets the order stays.
    """
    joined = rows.join(cards.select("novel_id", "genre", "subgenre", "elements"), "novel_id", "left")
    tier = F.when(F.col("subgenre").isin(*subgenres), 0).when(F.col("genre").isin(*genres), 1).otherwise(2) if genres or subgenres else F.lit(0)
    hits = F.coalesce(F.size(F.array_intersect("elements", F.array(*map(F.lit, elements)).cast("array<string>"))), F.lit(0)) if genres or subgenres else F.lit(0)
    keys = [query] if query else []
    w = Window.partitionBy(*keys).orderBy("tier", F.desc("hits"), "rank")
    new = joined.withColumns({"tier": tier, "hits": hits}).withColumn("new_rank", F.row_number().over(w))
    return new.where(F.col("new_rank") <= k).select(*keys, "novel_id", "rank", "tier", "hits", "new_rank")


def query_targets(terms: str | Column, vocabulary: Vocabulary) -> Column:
    """FLT-26, FLT-27: ``struct<genres, subgenres, elements>`` that positive terms name; a genre's own name beats an alias."""
    t = F.col(terms) if isinstance(terms, str) else terms
    subs = [s for group in vocabulary.genres.values() for s in group]
    named = lambda names: F.filter(t, lambda x: x.isin(*names))
    alias = lambda table: F.transform(F.filter(t, lambda x: x.isin(*table)), lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x))
    free = {a: s for a, s in vocabulary.subgenre_aliases.items() if a not in vocabulary.genres}
    sub = F.array_distinct(F.concat(named(subs), alias(free))) if free else F.array_distinct(named(subs))
    ele = F.array_distinct(F.concat(named(vocabulary.elements), alias(vocabulary.element_aliases))) if vocabulary.element_aliases else F.array_distinct(named(vocabulary.elements))
    return F.struct(F.array_distinct(named(vocabulary.genres)).alias("genres"), sub.alias("subgenres"), ele.alias("elements"))


def card_verdict(trope: str, rules: dict[str, dict] | None = None, unknown: str = "其他") -> Column:
    """FLT-28: what a card says of a trope: ``struct<verdict, source>``, null where it is silent.

    A rule may name elements, sub-genres, genres, options of a style scale, and a scale of which only the ends decide,
    in this order of weight; a single name may stand for a list of one. An absent element proves nothing; another genre
    proves the contrary unless a scale is named too, and so does another option of the scale.
    """
    rule = (TROPE_RULES if rules is None else rules).get(trope, {})
    many = lambda key: (lambda v: [v] if isinstance(v, str) else list(v))(rule.get(f"{key}s", rule.get(key, ())))
    say = lambda v, s: F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("source"))
    out = F.when(F.lit(False), say("", ""))
    if elements := many("element"):
        out = out.when(F.arrays_overlap("elements", F.array(*map(F.lit, elements))), say("yes", "element"))
    if subgenres := many("subgenre"):
        out = out.when(F.col("subgenre").isin(*subgenres), say("yes", "subgenre"))
    if genres := many("genre"):
        out = out.when(F.col("genre").isin(*genres), say("yes", "genre"))
        if "style" not in rule and "genres" in rule:
            out = out.when((F.col("genre") != "") & (F.col("genre") != unknown), say("no", "genre"))
    if "style" in rule:
        dim, options = rule["style"]
        at = F.element_at("style", F.lit(dim))
        out = out.when(at.isin(*([options] if isinstance(options, str) else options)), say("yes", "style")).when(at != "", say("no", "style"))
    if "scale" in rule:
        dim, yes, no = rule["scale"]
        at = F.element_at("style", F.lit(dim))
        out = out.when(at == yes, say("yes", "style")).when(at == no, say("no", "style"))
    return out


def vocabulary_report(cards: DataFrame, top: int = 50) -> DataFrame:
    """AGG-14: how often each value of each field occurs, the most frequent first."""
    style = cards.select(F.explode("style").alias("dim", "option")).where("option <> ''").select(F.lit("style").alias("field"), F.concat_ws("=", "dim", "option").alias("value"))
    rows = (
        cards.select(F.lit("genre").alias("field"), F.col("genre").alias("value"))
        .unionByName(cards.select(F.lit("subgenre").alias("field"), F.col("subgenre").alias("value")))
        .unionByName(cards.select(F.lit("element").alias("field"), F.explode("elements").alias("value")))
        .unionByName(style)
    )
    counted = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def card_text(columns: list[str]) -> Column:
    """JSN-16: one line for each field that is not blank."""
    return F.concat_ws("\n", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in columns])
