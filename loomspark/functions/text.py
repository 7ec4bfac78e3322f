"""Text scalars as Column expressions; each names the operators of the inventory that it covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon

_ZH = Lexicon()


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def any_of(words) -> str:
    return "|".join("".join(f"\\{x}" if not x.isalnum() and x.isascii() else x for x in w) for w in words)


def normalize_whitespace(c: str | Column) -> Column:
    """TXT-01: marks and NULs out, line ends unified, runs of blanks and of empty lines shortened, ends stripped."""
    t = F.replace(F.replace(col(c), F.lit("﻿"), F.lit("")), F.lit("\x00"), F.lit(""))
    for pattern, by in ((r"\r\n?", "\n"), (r"\t", " "), (r"[ \x{3000}]{2,}", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def compact_whitespace(c: str | Column) -> Column:
    """TXT-11: NULs out, line ends unified, runs of empty lines shortened."""
    t = F.replace(col(c), F.lit("\x00"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def lines_of(c: str | Column) -> Column:
    """Lines without their ends; an end at the end of the text begins no line."""
    parts = F.split(col(c), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]")
    return F.transform(F.array(parts), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))[0]


def remove_ad_lines(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-02: lines that advertise are dropped."""
    return F.array_join(F.filter(lines_of(c), lambda x: ~x.rlike(lex.ad_line)), "\n")


def is_boilerplate_line(c: str | Column, lex: Lexicon = _ZH, inner: bool = False) -> Column:
    """TXT-03: does a line carry the source's mark? Inside a text a narrower pattern holds."""
    return strip(c).rlike(lex.boilerplate_inner if inner else lex.boilerplate_edge)


def is_ruler(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-04."""
    return col(c).rlike(lex.ruler)


def remove_boilerplate(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-05: ``struct<text, detected, removed>``. Near the ends the wide pattern holds and takes neighbouring rulers along.
    A text of which nothing goes stays as it is."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        edge = lambda i: (i < lex.edge_lines) | (i >= n - lex.edge_lines)
        marked = F.transform(lines, lambda x, i: F.when(edge(i), is_boilerplate_line(x, lex)).otherwise(is_boilerplate_line(x, lex, True)))

        def choose(hit: Column) -> Column:
            def beside(i: Column) -> Column:
                one = lambda k: F.coalesce(F.get(hit, k) & edge(k), F.lit(False))
                return one(i - 1) | one(i + 1)

            kept = F.filter(lines, lambda x, i: ~(F.get(hit, i) | (is_ruler(x, lex) & beside(i))))
            whole = lambda k: F.when(F.size(k) == n, col(c)).otherwise(F.array_join(k, "\n"))
            return F.transform(F.array(kept), lambda k: F.struct(whole(k).alias("text"), F.exists(hit, lambda h: h).alias("detected"), (n - F.size(k)).alias("removed")))[0]

        return F.transform(F.array(marked), choose)[0]

    return F.transform(F.array(lines_of(c)), cut)[0]


def contains_boilerplate(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-06."""
    return F.exists(lines_of(c), lambda x: is_boilerplate_line(x, lex))


def clean_text(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-07: white space, boilerplate, advertisements, white space again; ``struct<text, detected, removed>``."""
    done = remove_boilerplate(normalize_whitespace(c), lex)
    return F.transform(F.array(done), lambda d: F.struct(normalize_whitespace(remove_ad_lines(d["text"], lex)).alias("text"), d["detected"].alias("detected"), d["removed"].alias("removed")))[0]


# What goes from a file's stem, in this order; then how an author is told in it.
STEM_NOISE = (
    r"(?iU)\s*作者[:：]\s*[^_()\[\]【】《》]+", r"(?iU)\s*by\s+[^_()\[\]【】《》]+", r"(?iU)\s*(校对版|精校版|实体版)?\s*(完本|全本|全文)(\+番外)?", r"(?iU)\s*txt$",
    r"(?U)\(\s*\)", r"(?U)（\s*）", r"[【\[]?(校对版|精校版|实体版)[】\]]?", r"(?U)[（(]\s*[)）]",
)
AUTHOR_MARKS = (r"(?U)作者[:：]\s*([^_()\[\]【】《》]+)", r"(?iU)\bby\s+([^_()\[\]【】《》]+)")


def title_from_stem(c: str | Column) -> Column:
    """TXT-08: author, edition and format notes off a file's stem, blanks shortened, ends stripped of blanks, dashes and
    underscores; the stem itself if nothing is left."""
    t = strip(c)
    for p in STEM_NOISE:
        t = F.regexp_replace(t, p, "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ _-]+|[ _-]+$", "")
    return F.when(t != "", t).otherwise(strip(c))


def author_of(c: str | Column) -> Column:
    """TXT-09: by the first of the marks that a stem has, without blanks, dashes and brackets around it; null if none is left."""
    peeled = lambda x: F.nullif(F.regexp_replace(x, r"^[ _（）()\[\]【】《》-]+|[ _（）()\[\]【】《》-]+$", ""), F.lit(""))
    out = F.lit(None).cast("string")
    for p in reversed(AUTHOR_MARKS):
        out = F.when(col(c).rlike(p), peeled(F.regexp_extract(col(c), p, 1))).otherwise(out)
    return out


def chapter_count(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-10: distinct heading strings over all heading patterns."""
    found = [F.transform(F.regexp_extract_all(col(c), F.lit(p), F.lit(0)), strip) for p in lex.chapter_counts]
    return F.size(F.array_distinct(F.concat(*found))).cast("long")


def sample_text(c: str | Column, total: int = 4500, marker: str = "\n\n[...]\n\n") -> Column:
    """TXT-12: beginning, middle and end of a long text, white space shortened first; blank parts go."""
    part = max(800, total // 3)

    def cut(t: Column) -> Column:
        n = F.char_length(t)
        middle = F.greatest(F.floor(n / 2).cast("int") - part // 2, F.lit(0))
        parts = [strip(F.substring(t, 1, part)), strip(F.substring(t, middle + 1, F.lit(part))), strip(F.right(t, F.lit(part)))]
        return F.when(n <= total, t).otherwise(F.concat_ws(marker, *[F.nullif(p, F.lit("")) for p in parts]))

    return F.transform(F.array(compact_whitespace(c)), cut)[0]


def chapter_titles(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-14: heading lines in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit("(?mdiU)" + lex.chapter_heading if lex is _ZH else "(?m)" + lex.chapter_heading), F.lit(0)), strip)


def trim_to_sentence(c: str | Column, limit: int | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-16: stripped, and cut at the last sentence end in the second half of the window, else hard."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    t = strip(c)
    window = F.substring(t, F.lit(1), n)
    ends = "".join(f"\\{x}" if x.isascii() else x for x in lex.sentence_ends)
    best = F.regexp_extract(window, f"(?s)^(.*[{ends}])", 1)
    return F.when(F.char_length(t) <= n, t).when(F.char_length(best) >= F.floor(n / 2) + 2, best).otherwise(strip(window))


def blurb(c: str | Column, limit: int = 800, window: int = 6000, lex: Lexicon = _ZH) -> Column:
    """TXT-17: the synopsis after its marker near the beginning, up to the first heading; empty without a marker."""
    head = F.substring(col(c), 1, window)
    body = F.regexp_extract(head, f"(?s)(?:{lex.blurb_marker})(.*)$", 1)
    heading = lex.chapter_heading
    body = F.regexp_replace(body, f"(?sm){heading}.*\\z" if lex is _ZH else f"(?m)\\n{heading}[\\s\\S]*\\z", "")
    return trim_to_sentence(strip(body), limit, lex)


def window_slice(c: str | Column, start: Column, size: int) -> Column:
    """TXT-18: a slice that begins inside the text, at its last character at the latest."""
    t = col(c)
    at = F.greatest(F.lit(0), F.least(start, F.char_length(t) - 1))
    return strip(F.substring(t, at.cast("int") + 1, F.lit(size)))


def ending_status(c: str | Column, tail: int = 3000, lex: Lexicon = _ZH) -> Column:
    """TXT-19: the vocabulary's word for a text that ends with a mark of its end, or for one that doesn't."""
    return F.when(F.right(col(c), F.lit(tail)).rlike(lex.finished), lex.endings[0]).otherwise(lex.endings[1])


def occurrences(c: str | Column, term: str | Column) -> Column:
    t, w = col(c), F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(w) > 0, (F.char_length(t) - F.char_length(F.replace(t, w, F.lit("")))) / F.char_length(w)).otherwise(0.0)


def term_density(c: str | Column, term: str | Column) -> Column:
    """TXT-20: occurrences for each 100,000 characters; zero for an empty text or term."""
    n = F.char_length(col(c))
    return F.when(n > 0, occurrences(c, term) / n * 100000.0).otherwise(0.0)


def merged_density(c: str | Column, forms: tuple[str, ...]) -> Column:
    """TXT-21: the sum over a term's forms."""
    return sum((term_density(c, f) for f in forms), F.lit(0.0))


def normalize_title(c: str | Column) -> Column:
    """TXT-22."""
    return F.lower(F.regexp_replace(col(c), r"(?U)[《》〈〉「」『』\[\]【】\s_\-]+", ""))


def title_key(c: str | Column) -> Column:
    """TXT-23."""
    return F.regexp_replace(col(c), r"(?U)[\s《》〈〉<>「」『』]", "")


def peel_title(c: str | Column) -> Column:
    """TXT-24."""
    return strip(F.regexp_replace(strip(c), r"^[《》〈〉<>]+|[《》〈〉<>]+$", ""))


def heading_of(c: str | Column) -> Column:
    """TXT-27: the first line, 60 characters at most."""
    return F.substring(strip(F.substring_index(strip(c), "\n", 1)), 1, 60)


# The lines under which a profile's synopsis and excerpts stand, and its author's line.
BLURB_MARK, EXCERPTS_MARK, AUTHOR_LINE = "\n内容简介：\n", "\n正文节选：\n", "作者："


def synopsis_preview(profile: str | Column, limit: int = 300, marker: str = BLURB_MARK, end: str = EXCERPTS_MARK, author: str = AUTHOR_LINE) -> Column:
    """TXT-28: author line and synopsis body, cut; the raw head without a marker."""
    t = strip(profile)
    at = F.instr(t, F.lit(marker))
    head = F.substring(t, F.lit(1), at - 1)
    line = F.get(F.filter(F.split(head, "\n"), lambda x: x.startswith(author)), F.lit(0))
    rest = F.substring(t, at + len(marker), F.char_length(t))
    body = strip(F.substring_index(rest, end, 1)) if end else strip(rest)
    return F.when(at == 0, F.substring(t, 1, limit)).otherwise(F.substring(F.concat_ws("\n", line, body), 1, limit))


def truncate(c: str | Column, limit: int, marker: str = "…[截断]") -> Column:
    """TXT-29: cut with a marker that counts; no limit if it is not positive."""
    t = col(c)
    return t if limit <= 0 else F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, max(limit - len(marker), 0)), F.lit(marker)))


def tokens(c: str | Column) -> Column:
    """TXT-30: words in lower case; runs of CJK characters become bigrams."""
    low = F.lower(col(c))
    words = F.regexp_extract_all(low, F.lit(r"[\p{IsHan}]+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"), F.lit(0))
    split = lambda w: F.when(w.rlike(r"^\p{IsHan}{2,}$"), F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    # Below U+2E80 there are no Han characters, so one plain pattern finds the same words there.
    plain = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(low.rlike(r"[\x{2e80}-\x{10ffff}]"), F.flatten(F.transform(words, split))).otherwise(plain)


def query_terms(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-31."""
    return F.filter(F.split(col(c), lex.separators), lambda x: x != "")


def negative_of(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-32: what follows a negation marker, markers in order; null without one. Short markers also fire on words that begin so."""
    t = col(c)
    out = F.lit(None).cast("string")
    for m in reversed(lex.negative_markers):
        out = F.when(t.startswith(m), strip(F.substring(t, F.lit(len(m) + 1), F.char_length(t)))).otherwise(out)
    return out


def expanded(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-33."""
    t, s = col(c), lex.protagonist
    head = F.substring(t, F.lit(1), F.char_length(t) - len(s))
    return F.when(t.endswith(s) & (F.char_length(t) > len(s)), F.array(head, F.lit(s))).otherwise(F.array(t))


def parse_query(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-34, SET-04: ``struct<positive, negative>``, by a left fold; a bare marker turns the next term."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("positive"), empty.alias("negative"), F.lit(False).alias("flag"))

    def step(s: Column, w: Column) -> Column:
        neg = negative_of(w, lex)
        add = lambda base, new: F.array_distinct(F.concat(base, new))
        return (
            F.when(neg == "", F.struct(s["positive"].alias("positive"), s["negative"].alias("negative"), F.lit(True).alias("flag")))
            .when(neg.isNotNull(), F.struct(s["positive"].alias("positive"), add(s["negative"], F.array(neg)).alias("negative"), F.lit(False).alias("flag")))
            .when(s["flag"], F.struct(s["positive"].alias("positive"), add(s["negative"], F.array(w)).alias("negative"), F.lit(False).alias("flag")))
            .otherwise(F.struct(add(s["positive"], F.filter(expanded(w, lex), lambda x: x != "")).alias("positive"), s["negative"].alias("negative"), F.lit(False).alias("flag")))
        )

    return F.aggregate(query_terms(c, lex), start, step, lambda s: F.struct(s["positive"].alias("positive"), s["negative"].alias("negative")))


def retrieval_query(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-35."""
    return F.coalesce(F.nullif(F.array_join(parse_query(c, lex)["positive"], " "), F.lit("")), strip(c))


def negative_clauses(c: str | Column, lex: Lexicon = _ZH) -> Column:
    """TXT-36."""
    return F.filter(F.split(col(c), lex.clause_ends), lambda x: x.rlike(any_of(lex.clause_markers)))


def required_negatives(message: str | Column, lex: Lexicon = _ZH, memory: str | Column | None = None) -> Column:
    """TXT-37: in-text terms named in negative clauses, among the query's negative terms, and in the remembered ones (an
    array); outside labels are blanked first, so a longer one hides a shorter."""
    labels = sorted(lex.meta_labels, key=len, reverse=True)
    sources = F.concat(parse_query(message, lex)["negative"], negative_clauses(message, lex), *([] if memory is None else [F.coalesce(col(memory), F.array().cast("array<string>"))]))
    text = F.regexp_replace(F.array_join(sources, "\n"), any_of(labels), " ")
    return F.filter(F.array(*map(F.lit, lex.term_forms)), lambda t: F.contains(text, t))


def bigrams(c: str | Column, keep: str = r"[^\x{4e00}-\x{9fff}]") -> Column:
    """TXT-38: distinct pairs of neighbouring characters, after all but the kept ones are dropped."""
    t = F.regexp_replace(col(c), keep, "")
    pairs = lambda x: F.when(F.size(x) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    )
    return F.transform(F.array(F.split(t, "")), pairs)[0]


def quoted_line(c: str | Column, marks: str = "「」") -> Column:
    """TXT-39: the first quote of six characters and more; null without one."""
    return F.nullif(strip(F.regexp_extract(col(c), f"{marks[0]}([^{marks[1]}]{{6,}}){marks[1]}", 1)), F.lit(""))


def squash(c: str | Column) -> Column:
    """TXT-41."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


# What is left out where a quote is compared with its source.
QUOTE_MARKS = r"""(?U)[\s，。！？、：；“”‘’"'（）()《》【】…—\-,.!?:;]+"""


def bare(c: str | Column, marks: str = QUOTE_MARKS) -> Column:
    """TXT-42: without white space and punctuation."""
    return F.regexp_replace(col(c), marks, "")


def quote_supported(quote: str | Column, source: str | Column, window: int = 6, marks: str = QUOTE_MARKS) -> Column:
    """TXT-43: a quote stands in the source; from 8 characters on, any window of it does; under 4, never."""

    def told(q: Column, s: Column) -> Column:
        n = F.char_length(q)
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.substring(q, i, F.lit(window)))
        return F.when(n < 4, False).when(F.contains(s, q), True).when(n >= 8, F.exists(pieces, lambda p: F.contains(s, p))).otherwise(False)

    # Both are bound once; inside the lambda a source would be made bare again for each window.
    both = F.array(F.struct(bare(quote, marks).alias("q"), bare(source, marks).alias("s")))
    return F.transform(both, lambda x: told(x["q"], x["s"]))[0]


def numeral(c: str | Column) -> Column:
    """TXT-25: a Chinese numeral below ten thousand as a number; a bare ten is ten; null for any other character."""
    values = [*enumerate("零一二三四五六七八九"), (0, "〇"), (2, "两"), (10, "十"), (100, "百"), (1000, "千")]
    worth = F.create_map(*[F.lit(x) for v, d in values for x in (d, v)])
    pack = lambda total, digit, ok: F.struct(total.alias("total"), digit.alias("digit"), ok.alias("ok"))
    zero = F.lit(0)

    def step(s: Column, v: Column) -> Column:
        grown = s["total"] + F.greatest(s["digit"], F.lit(1)) * v
        return F.when(v.isNull(), pack(s["total"], s["digit"], F.lit(False))).when(v < 10, pack(s["total"], v, s["ok"])).otherwise(pack(grown, zero, s["ok"]))

    known = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.element_at(worth, x))
    return F.aggregate(known, pack(zero, zero, F.lit(True)), step, lambda e: F.when(e["ok"], e["total"] + e["digit"]))


def chapter_number(c: str | Column) -> Column:
    """TXT-26: the number at the beginning of a heading, in digits of either width or as a numeral; null without one."""
    mark = F.regexp_extract(strip(c), r"^第([0-9０-９一二三四五六七八九十百千零〇两]+)[章回节]", 1)
    mark = F.translate(F.nullif(mark, F.lit("")), "０１２３４５６７８９", "0123456789")
    return F.coalesce(mark.try_cast("int"), numeral(mark))


def match_chapter(citation: str | Column, heading: str | Column) -> Column:
    """TXT-40: equal numbers if both have one, else equal without white space, else a citation of 4 characters inside the heading."""
    a, b = chapter_number(citation), chapter_number(heading)
    x, y = squash(citation), squash(heading)
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise((x == y) | ((F.char_length(col(citation)) >= 4) & F.contains(y, x)))


def fingerprint_redacted(c: str | Column) -> Column:
    """TXT-45: a text's checksum and length in its place."""
    return F.struct(F.sha2(col(c), 256).alias("sha256"), F.char_length(col(c)).cast("long").alias("length"))


def posix_path(c: str | Column) -> Column:
    """TXT-13."""
    return F.replace(col(c), F.lit("\\"), F.lit("/"))
