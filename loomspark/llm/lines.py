"""Line dedup: exact copies, and near copies by a segment-partition edit join. DataFrame functions only.

A line is cut into threshold-plus-one segments; two lines within the threshold share one of them, at nearly the same
place. Segments are indexed with the line's length; each line probes the lengths up to the threshold below its own
with the substrings that a match can use. Index entries and probes are shuffled once, as numbers and as rows of one
table; only rows whose key others have too go on, and only their lines are read again. Those meet if the counts of
characters in all their beginnings differ by no more than the threshold allows, and are then verified with a banded
bit-parallel edit distance. Lines that share a segment with many others meet by what is left of them without it, which
must be within the threshold too: what all of them begin and end with is taken off, and the rest is cut into segments
again, so lines of one template meet by where they differ. What is still shared by many after some rounds is split by
pieces of the counts, one of which near lines must share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, few, saved


@dataclass(frozen=True)
class LineRules:
    """Exact copies of every line that isn't blank go. Lines of ``near_chars`` code points or more that are within
    ``threshold`` edits of an earlier one are near copies. With ``min_chars``, shorter lines are left alone, and it is the
    edit join's minimum instead. A segment that over ``hot`` lines share is divided, ``rounds`` times at most."""

    threshold: int = 2
    min_chars: int | None = None
    hot: int = 64
    near_chars: int = 24
    rounds: int = 4

    def taken(self, line: Column) -> Column:
        """Is a line one that may go?"""
        return line.rlike(r"\S") if self.min_chars is None else F.char_length(line) >= self.min_chars

    def joined(self, size: Column) -> Column:
        """Does a line of this size take part in the edit join?"""
        return size >= (self.near_chars if self.min_chars is None else self.min_chars)


def occurrences(docs: DataFrame, doc_id: str, text: str, rules: LineRules) -> DataFrame:
    """A row for each line that may go: document key, line number and line, with 128 bits of hashes."""
    lines = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    sized = lines.select("d", "t", "n", "line", F.char_length("line").alias("size")).where(rules.taken(F.col("line")))
    return sized.select("d", "t", "n", "line", "size", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))


#: The lanes of the sketch: each counts one of these letters, and the characters that stand for it.
SKETCH = "etaoinsrldcu"
_LANES = len(SKETCH)
#: The rest of ASCII, and the last bytes of characters outside it (128 to 191), dealt out over the lanes.
_OTHERS = "".join(chr(c) for c in [*range(32, 127), *range(128, 192)] if chr(c) not in SKETCH)
_STAND_INS = "".join(SKETCH[(5 * i) % _LANES] for i in range(len(_OTHERS)))
#: A count modulo ten in five bits: neighbouring counts differ in one bit, so bits that differ bound how far two are apart.
_CODE = [(1 << c) - 1 if c <= 5 else 31 ^ ((1 << (c - 5)) - 1) for c in range(10)]
#: Counts are taken of the whole line and of its beginnings of so many characters, and multiples.
_STEP = 32


def spelled(line: str) -> Column:
    """A line in letters of the sketch, one for each of its code points: one outside ASCII counts by its last byte in UTF-8."""
    c = F.col(line)
    last = F.regexp_replace(F.decode(c.cast("binary"), "ISO-8859-1"), "[\u00c0-\u00ff][\u0080-\u00bf]*(?=[\u0080-\u00bf])", "")
    return F.translate(F.when(F.octet_length(c) == F.char_length(c), c).otherwise(last), _OTHERS, _STAND_INS)


def lanes(text: Column) -> Column:
    """Counts of twelve groups of characters, modulo ten, in lanes of five bits. An edit changes two lanes by one at most,
    and so two bits. It does so in every beginning of the line, too: there an edit that shifts the rest changes one count
    by itself and one at the end."""
    word = F.lit(0).cast("long")
    for k, c in enumerate(SKETCH):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        word = word.bitwiseOR(F.element_at(F.array(*[F.lit(x << (5 * k)).cast("long") for x in _CODE]), (count % 10 + 1).cast("int")))
    return word


def sketch(line: str) -> Column:
    """The counts of a line of any script, and of each of its beginnings: an array of words."""
    steps = lambda t: F.filter(F.sequence(F.lit(_STEP), F.greatest(F.char_length(t), F.lit(_STEP)), F.lit(_STEP)), lambda m: m < F.char_length(t))
    return _let(spelled(line), lambda t: F.concat(F.array(lanes(t)), F.transform(steps(t), lambda m: lanes(F.substring(t, F.lit(1), m)))))


def counts_near(a: Column, b: Column, tau: int) -> Column:
    """May two lines be within ``tau`` edits, by their sketches? Beginnings that one of them lacks don't count."""
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2 * tau
    return near(F.get(a, F.lit(0)), F.get(b, F.lit(0))) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(near(x, y), F.lit(True))), lambda v: v)


def piece(word: Column, j: Column, tau: int) -> Column:
    """Piece ``j`` of ``2 tau + 1`` of a line's counts; lines within ``tau`` edits have at least one piece in common. The first
    ones take the remaining lanes, so that none is empty: all lines would share that one."""
    k = 2 * tau + 1
    ends = [sum(len(SKETCH) // k + (i < len(SKETCH) % k) for i in range(n)) for n in range(k + 1)]
    masks = [(1 << (5 * b)) - (1 << (5 * a)) for a, b in zip(ends, ends[1:])]
    return word.bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), j + 1))


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of ``k`` of a line: the last ones take the remainder."""
    size = F.floor(length / k).cast("int")
    longer = length % k
    return F.lit(i) * size + F.greatest(F.lit(0), F.lit(i) - (F.lit(k) - longer)).cast("int"), size + F.when(F.lit(i) >= F.lit(k) - longer, 1).otherwise(0)


def _own_places(n: Column, tau: int) -> list[tuple[Column, int, Column, Column]]:
    """Length, number, start (from 0) and size of a line's own segments."""
    return [(n, i, *_segment(n, i, tau + 1)) for i in range(tau + 1)]


def _probe_places(n: Column, tau: int) -> list[tuple[Column, int, Column, Column]]:
    """The same of the substrings that can match segment ``i`` of a line ``delta`` shorter: the edits before a segment and
    those after it bound how far it may have moved, from either end. A line's own segments, which lines of its own
    length may hold, are left out.

    Lines of one length probe each other, so one of the two may look for segments that moved to the right alone: with
    up to three edits a line has no segments that moved to either side.
    """
    places = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            start, width = _segment(n - delta, i, tau + 1)
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                if delta or shift > 0 or shift < 0 and tau > 3:
                    places.append((n - delta, i, start + shift, width))
    return places


def index_keys(line: str, size: str, tau: int) -> list[Column]:
    """Keys of a line's own segments."""
    return [F.xxhash64(short, F.lit(i), F.substring(F.col(line), at + 1, width)) for short, i, at, width in _own_places(F.col(size), tau)]


def probe_keys(line: str, size: str, tau: int) -> list[Column]:
    """Keys of a line's other substrings that may be a segment of a near line; one that does not fit is null."""
    n = F.col(size)
    fits = lambda at, width: (at >= 0) & (at + width <= n)
    return [F.when(fits(at, width), F.xxhash64(short, F.lit(i), F.substring(F.col(line), at + 1, width))) for short, i, at, width in _probe_places(n, tau)]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def within(a: str, b: str, tau: int) -> Column:
    """Is the edit distance at most ``tau``? A banded bit-parallel computation: one machine word holds the vertical
    differences of the ``2 tau + 1`` diagonals around the main one, and a column of ``b`` moves it down by a row.

    Bit ``j`` stands for row ``column + j - tau`` of ``a``. Characters are code points.
    """
    width = 2 * tau + 1
    mask = (1 << width) - 1
    one = lambda v: F.lit(v).cast("long")
    both = lambda p, q: p.bitwiseAND(q)
    flip = lambda v: F.bitwise_not(v).bitwiseAND(one(mask))
    rows = sum(1 << j for j in range(tau + 1, width))  # under row 0 differences rise, above it they fall
    start = F.struct(one(rows).alias("vp"), one(mask & ~rows).alias("vn"), one(tau).alias("score"), F.lit(0).alias("i"))
    y = F.split(b, "")

    def distance(x: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            eq = one(0)
            for j in range(width):
                eq = eq.bitwiseOR(F.when(F.get(x, s["i"] + (j - tau)) == c, one(1 << j)).otherwise(one(0)))

            def first(v: Column) -> Column:
                d0 = (both(v["eq"], v["vp"]) + v["vp"]).bitwiseXOR(v["vp"]).bitwiseOR(v["eq"]).bitwiseOR(v["vn"])
                return F.struct(both(d0, one(mask)).alias("d0"), v["vp"].alias("vp"), v["vn"].alias("vn"))

            def second(v: Column) -> Column:
                hp = F.shiftleft(v["vn"].bitwiseOR(flip(v["d0"].bitwiseOR(v["vp"]))), 1)
                hn = F.shiftleft(both(v["d0"], v["vp"]), 1)
                return F.struct(
                    both(hn.bitwiseOR(flip(v["d0"].bitwiseOR(hp))), one(mask)).alias("vp"),
                    both(both(v["d0"], hp), one(mask)).alias("vn"),
                    # The score follows the lowest diagonal of the band: a step along it is free where its bit is set.
                    (s["score"] + 1 - F.shiftrightunsigned(v["d0"], width - 1)).alias("score"),
                    (s["i"] + 1).alias("i"),
                )

            down_p = F.shiftrightunsigned(s["vp"], 1).bitwiseOR(one(1 << (width - 1)))
            down_n = F.shiftrightunsigned(s["vn"], 1)
            return _let(_let(F.struct(eq.alias("eq"), down_p.alias("vp"), down_n.alias("vn")), first), second)

        def back(end: Column) -> Column:
            # From the band's lowest row, size(y) + tau, up to the last row of ``a``.
            up = F.size(y) + tau - F.size(x)
            bit = lambda w, j: both(F.shiftrightunsigned(w, j), one(1))
            score = end["score"]
            for k in range(2 * tau):
                score = score - F.when(up > k, bit(end["vp"], width - 1 - k) - bit(end["vn"], width - 1 - k)).otherwise(one(0))
            return score <= tau

        return _let(F.aggregate(y, start, step), back)

    return (F.abs(F.char_length(a) - F.char_length(b)) <= tau) & _let(F.split(a, ""), distance)


def keyed(occ: DataFrame, rules: LineRules) -> DataFrame:
    """Occurrences as numbers only: place, hashes, own segments' keys ``i0..`` and other probes ``p0..``; keys are null for
    lines that the edit join leaves out."""
    tau, joined = rules.threshold, rules.joined(F.col("size"))
    own = [F.when(joined, c).alias(f"i{k}") for k, c in enumerate(index_keys("line", "size", tau))]
    other = [F.when(joined, c).alias(f"p{k}") for k, c in enumerate(probe_keys("line", "size", tau))]
    return occ.select("d", "t", "n", "h", "g", *own, *other)


def line_id(h: Column) -> Column:
    """A line's number: its hash, but for the last bit, which tells index entries from probes."""
    return h.bitwiseAND(F.lit(-2))


#: One line in so many tells which segments are hot, and one in so many which substrings are. That only decides which way
#: rows take: they are the same either way.
_LOOK, _LOOK_FAR = 8, 64


def met_entries(rows: DataFrame, rules: LineRules) -> DataFrame:
    """Index entries and probes ``(key, v)`` of distinct lines, from :func:`keyed` rows, but for those whose key nobody
    else has; ``v`` is the line's number, odd for an index entry."""
    keys = [c for c in rows.columns if c[0] in "ip" and c[1:].isdigit()]
    own = [c for c in keys if c[0] == "i"]
    taken = rows.where("i0 is not null").select("h", "g", *keys)
    looked = taken.where(F.pmod("h", F.lit(_LOOK)) == 0).dropDuplicates(["h", "g"])
    far = F.when(F.pmod("h", F.lit(_LOOK_FAR)) == 0, F.array(*[F.struct(F.col(k).alias("key"), F.lit(0).alias("own")) for k in keys if k not in own]))
    near = F.array(*[F.struct(F.col(k).alias("key"), F.lit(1).alias("own")) for k in own])
    seen = looked.select(F.inline(F.concat(near, F.coalesce(far, F.array())))).where("key is not null")
    counts = seen.groupBy("key").agg(F.sum("own").alias("o"), F.sum(F.lit(1) - F.col("own")).alias("p"))
    hot = counts.where((F.col("o") > rules.hot // _LOOK) | (F.col("p") > 16 * rules.hot // _LOOK_FAR))
    hot = few(saved(hot.select("key", F.lit(True).alias("hot"))))
    # One row per distinct line; numbers only, so the aggregation combines before the shuffle.
    flat = taken.dropDuplicates(["h", "g"])
    v = lambda k: line_id(F.col("h")).bitwiseOR(F.lit(int(k in own)))
    table = flat.select(F.inline(F.array(*[F.struct(F.col(k).alias("key"), v(k).alias("v")) for k in keys]))).where("key is not null").join(hot, "key", "left")
    # Keys that one row alone has, or no index entry, are nearly all; they end here, after one sort. What many have is
    # not brought together.
    by_key = Window.partitionBy("key")
    cold = table.where("hot is null").select("key", "v").withColumns({"c": F.count("*").over(by_key), "o": F.max(F.col("v").bitwiseAND(F.lit(1))).over(by_key)})
    return cold.where("c > 1 and o = 1").select("key", "v").unionByName(table.where("hot").select("key", "v"))


def _segments(line: str, size: str, tau: int, group: str | None = None, sizes: str | None = None) -> Column:
    """All segments and probes of a line as ``(key, miss, at, width)``; ``miss`` is 0 for its own segments. Within a group the
    key is of it too, and only sizes that its lines have are looked for."""
    n = F.col(size)
    salt = [F.col(group)] if group else []

    def entry(miss: int, short: Column, i: int, at: Column, width: Column) -> Column:
        there = (at >= 0) & (at + width <= n) & (F.array_contains(F.col(sizes), short) if sizes else F.lit(True))
        key = F.xxhash64(*salt, short, F.lit(i), F.substring(F.col(line), at + 1, width))
        return F.struct(F.when(there, key).alias("key"), F.lit(miss).alias("miss"), at.alias("at"), width.alias("width"))

    return F.array(*[entry(0, *p) for p in _own_places(n, tau)], *[entry(1, *p) for p in _probe_places(n, tau)])


def _without(line: str) -> Column:
    """A line without ``width`` characters at ``at``. If two lines are within some edits, and these leave alone a segment
    of one, both without that segment are within as many."""
    rest = F.char_length(line)
    return F.concat(F.substring(F.col(line), F.lit(1), F.col("at")), F.substring(F.col(line), F.col("at") + F.col("width") + 1, rest))


def _common(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at their beginnings, by halving."""
    most = F.least(F.char_length(a), F.char_length(b))
    add = lambda n, k: n + F.when((n + k <= most) & (F.substring(a, n + 1, k) == F.substring(b, n + 1, k)), k).otherwise(0)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), add)


def stripped(rows: DataFrame) -> DataFrame:
    """Rows ``(key, v, miss, line)`` without what all lines of a key begin and end with, as ``(g, v, miss, line, size,
    sizes)``. It leaves distances as they are. The first and the last line in order tell the beginning; sizes of a key
    differ by the threshold at most, so ``sizes`` is short."""
    size, back = F.char_length("line"), F.reverse("line")
    ends = rows.groupBy("key").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.min(back).alias("y"), F.max(back).alias("z"), F.min(size).alias("least"), F.collect_set(size).alias("sizes")
    )
    cut = ends.withColumn("begin", _common(F.col("a"), F.col("b"))).withColumn("end", F.least(_common(F.col("y"), F.col("z")), F.col("least") - F.col("begin")))
    lean = saved(cut.select("key", "begin", (F.col("begin") + F.col("end")).alias("off"), "sizes"))
    core = F.substring(F.col("line"), F.col("begin") + 1, size - F.col("off"))
    return rows.join(few(lean), "key").select(
        F.col("key").alias("g"), "v", "miss", core.alias("line"), (size - F.col("off")).alias("size"), F.transform("sizes", lambda n: n - F.col("off")).alias("sizes")
    )


def divided(met: DataFrame, texts: DataFrame, rules: LineRules) -> DataFrame:
    """Entries ``(key, v, miss)``, from :func:`met_entries` and ``(id, line)``: those whose key many share are replaced by
    entries of what is left of their lines. Bit ``k`` of ``miss`` says that an entry was a probe in round ``k``: of two lines
    that meet, one was an index entry in each. A key is left as it is where that would make over a fifth more comparisons:
    lines that are all near each other share most segments, however they are cut."""
    tau = rules.threshold
    entries = met.select("key", "v", (F.lit(1) - F.col("v").bitwiseAND(F.lit(1))).cast("int").alias("miss"))
    bit, found = 0, []
    rest = None
    while bit <= rules.rounds:
        own = F.min(F.col("miss").bitwiseAND(F.lit(1 << bit))) == 0
        counts = entries.groupBy("key").agg(F.count("*").alias("c"), own.alias("o")).where("c > 1 and o")
        counts = saved(counts.select("key", "c", (F.col("c") > rules.hot).alias("hot")))
        hot = saved(counts.where("hot").select("key", "c"))
        if bit == rules.rounds or hot.isEmpty():
            found.append(entries.join(few(counts), "key", "left_semi"))
            break
        if rest is None:
            ids = saved(entries.join(few(hot), "key", "left_semi").select(line_id(F.col("v")).alias("id")).distinct())
            lines = texts.select("id", "line", F.char_length("line").alias("size")).join(few(ids), "id", "left_semi")
            all_ = lines.select(F.col("id").alias("v"), "line", F.inline(_segments("line", "size", tau)))
            rest = all_.where("key is not null").select("key", "v", "miss", _without("line").alias("line"))
        deeper = stripped(saved(rest.join(few(hot), "key", "left_semi")))
        bit += 1
        told = deeper.select("g", "v", F.col("miss").alias("m"), "line", F.inline(_segments("line", "size", tau, "g", "sizes"))).where("key is not null")
        parts = saved(told.select("g", "key", "v", F.col("m").bitwiseOR(F.col("miss") * (1 << bit)).alias("miss"), _without("line").alias("line")))
        own = F.min(F.col("miss").bitwiseAND(F.lit(1 << bit))) == 0
        work = parts.groupBy("g", "key").agg(F.count("*").alias("n"), own.alias("o")).where("n > 1 and o").groupBy(F.col("g").alias("key")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        worth = saved(hot.join(work, "key", "left").where("5 * coalesce(work, 0) <= 6 * double(c) * c").select("key"))
        found.append(entries.join(few(saved(counts.join(few(worth), "key", "left_anti").select("key"))), "key", "left_semi"))
        rest = saved(parts.join(few(worth.withColumnRenamed("key", "g")), "g", "left_semi").select("key", "v", "miss", "line"))
        entries = rest.select("key", "v", "miss")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_pairs(met: DataFrame, sketches: DataFrame, rules: LineRules) -> DataFrame:
    """Candidate pairs ``(a, b)`` of line numbers, from :func:`met_entries` or :func:`divided` and ``(id, s)``."""
    tau = rules.threshold
    miss = F.col("miss") if "miss" in met.columns else F.lit(1) - F.col("v").bitwiseAND(F.lit(1))
    known = met.select("key", miss.alias("miss"), line_id(F.col("v")).alias("id")).join(few(sketches), "id")
    hot = few(saved(met.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > rules.hot).select("key", F.lit(True).alias("hot"))))
    pieces = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(2 * tau))).otherwise(F.array(F.lit(-1)))
    spread = known.join(hot, "key", "left").select("id", "miss", "s", "key", F.explode(pieces).alias("j"))
    dealt = F.when(F.col("j") < 0, F.col("key")).otherwise(F.xxhash64("key", "j", piece(F.get("s", F.lit(0)), F.greatest("j", F.lit(0)), tau)))
    spread = spread.select(dealt.alias("key"), "id", "miss", "s")
    left, right = (spread.select("key", F.col("id").alias(x), F.col("miss").alias(f"m{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    near = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ma").bitwiseAND(F.col("mb")) == 0) & counts_near(F.col("sa"), F.col("sb"), tau))
    return near.select("a", "b").distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """All rows and columns, the text without repeated lines, and ``n_lines``, ``n_exact`` and ``n_near``.

    A line goes if it equals an earlier line of the corpus, or is within the threshold of one that differs; earlier is
    by id (null first), then text hash, then line number. Blank lines stay, and short ones go as
    exact copies only. Null and empty texts stay as they are. Rows that repeat an id and a text are one document and keep the same lines.
    """
    source = docs.select(F.col(doc_id).alias("d0"), F.col(text).alias("x"))
    occ = occurrences(source, "d0", "x", rules)
    place = F.struct("d", "t", "n")
    rows = saved(keyed(occ, rules))
    met = saved(met_entries(rows, rules))
    ids = saved(met.select(line_id(F.col("v")).alias("id")).distinct())
    read = occ.where(rules.joined(F.col("size"))).withColumn("id", line_id(F.col("h")))
    texts = saved(read.join(few(ids), "id", "left_semi").groupBy("id", "h", "g", "line").agg(F.min(place).alias("first")))
    pairs = saved(near_pairs(saved(divided(met, texts, rules)), saved(texts.select("id", sketch("line").alias("s")).distinct()), rules))
    side = lambda s: texts.select(F.col("id").alias(s), F.struct("h", "g", "line", "first").alias(f"{s}x"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("ax.line <> bx.line")
    near = both.where(within("ax.line", "bx.line", rules.threshold))
    near = saved(near.select(F.explode(F.when(F.col("ax.first") < F.col("bx.first"), F.array("bx")).otherwise(F.array("ax"))).alias("x")).select("x.h", "x.g").distinct())
    slim = rows.select("d", "t", "n", "h", "g")
    again = slim.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "g", "first")
    again = saved(again)
    copies = slim.join(few(again), ["h", "g"]).where(~place.eqNullSafe(F.col("first"))).select("d", "t", "n", F.lit(0).alias("near"))
    close = slim.join(few(near), ["h", "g"], "left_semi").select("d", "t", "n", F.lit(1).alias("near"))
    gone = copies.union(close).groupBy("d", "t", "n").agg(F.max("near").alias("near"), F.min("near").alias("exact"))
    words = gone.groupBy("d", "t", F.floor(F.col("n") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n") % 64)).alias("bits"), F.sum(F.when(F.col("exact") == 0, 1).otherwise(0)).alias("e"), F.count("*").alias("c")
    )
    by_doc = words.groupBy(F.col("d").alias(f"{P}e"), F.col("t").alias(f"{P}u")).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias(f"{P}b"), F.sum("e").alias(f"{P}x"), F.sum("c").alias(f"{P}c"), F.max("w").alias(f"{P}w")
    )
    by_doc = saved(by_doc)
    tagged = docs.withColumns({f"{P}d": F.col(doc_id), f"{P}t": F.xxhash64(F.col(text))})
    joined = tagged.join(few(by_doc), F.col(f"{P}d").eqNullSafe(F.col(f"{P}e")) & (F.col(f"{P}t") == F.col(f"{P}u")), "left")
    # A dense array of words, so that asking for a line takes constant time.
    dense = F.transform(F.sequence(F.lit(0), F.col(f"{P}w")), lambda k: F.coalesce(F.element_at(f"{P}b", k), F.lit(0).cast("long")))
    lines = F.split(F.col(text), "\n")
    rest = _let(dense, lambda m: F.filter(lines, lambda x, i: F.coalesce(F.get(m, F.floor(i / 64).cast("int")), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))) == 0))
    new = F.when(F.col(f"{P}w").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    extra = {
        "n_lines": F.coalesce(F.size(F.filter(lines, rules.taken)), F.lit(0)).cast("long"),
        "n_exact": F.coalesce(f"{P}x", F.lit(0)).cast("long"),
        "n_near": (F.coalesce(f"{P}c", F.lit(0)) - F.coalesce(f"{P}x", F.lit(0))).cast("long"),
    }
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns if c not in extra], *[v.alias(k) for k, v in extra.items()])
