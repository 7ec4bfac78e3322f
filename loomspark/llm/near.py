"""MinHash near-dedup on word shingles with b-bit signatures.

Exact copies of a shingle set are one node. Nodes meet in bands of their minima; the estimate from packed b-bit
signatures, corrected for chance collisions, drops far pairs; what stays is confirmed on the full sets. A bucket never
emits all its pairs. First, members are compared with the least member of each of their buckets. Then the other members
of a bucket that holds part of a large component look for blocks of that component by signatures, and only where a block
holds one that may be near are full sets compared, within a join's condition. At last, members of small components that
still differ meet in their buckets, by signature; a bucket of many nodes is met in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, few, map_rows, only, saved

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class NearRules:
    """``bands`` bands of ``rows`` minima: a pair at 0.75 meets in some band but for 5 cases in a million.

    ``margin`` is how far under the threshold an estimate may lie; it is five standard deviations at the threshold.
    """

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 2
    margin: float = 0.23
    large: int = 64
    block: int = 256
    seed: int = 17


class _Words(dict):
    """Hashes of words, made when missing; the memory starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_WORDS = _Words()


def _remember() -> None:
    only("near", _WORDS.clear)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), dtype=np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * _M1
        h ^= h >> np.uint64(31)
    h *= _M2
    return np.unique(h ^ (h >> np.uint64(29)))


@lru_cache(maxsize=4)
def _functions(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, k, dtype=np.uint64)


def minima(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    a, b = _functions(k, seed)
    out = np.full(k, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(values), 2048):
        np.minimum(out, (values[start : start + 2048, None] * a + b).min(axis=0), out=out)
    return out


def signature(values: np.ndarray, rules: NearRules) -> tuple[list[int], list[int]]:
    """Band keys, and the packed low bits of the minima, as signed 64-bit numbers."""
    m = minima(values, rules.bands * rules.rows, rules.seed)
    keys = np.arange(1, rules.bands + 1, dtype=np.uint64) * _M2
    for column in m.reshape(rules.bands, rules.rows).T:
        keys = (keys ^ column) * _M1
        keys ^= keys >> np.uint64(32)
    # The low bits are taken from the mixed minimum: those of a linear hash would hang together.
    low = (m * _M2) >> np.uint64(64 - rules.bits)
    lanes = 64 // rules.bits
    packed = np.bitwise_or.reduce(low.reshape(-1, lanes) << (np.arange(lanes, dtype=np.uint64) * np.uint64(rules.bits)), axis=1)
    return keys.view(np.int64).tolist(), packed.view(np.int64).tolist()


def estimate(a: str | Column, b: str | Column, rules: NearRules) -> Column:
    """Similarity by bit counts: the share of equal lanes, corrected for lanes that are equal by chance."""
    if rules.bits != 2:
        raise ValueError("lanes of two bits are compared")
    k = rules.bands * rules.rows
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    lane = F.lit(0x5555555555555555)
    unequal = F.aggregate(x, F.lit(0), lambda n, v: n + F.bit_count((v.bitwiseOR(F.shiftrightunsigned(v, 1))).bitwiseAND(lane)))
    chance = 2.0**-rules.bits
    return ((1 - unequal / F.lit(float(k))) - chance) / (1 - chance)


def described(docs: DataFrame, keep: list[str], text: str, rules: NearRules) -> DataFrame:
    """One row per document: the kept columns, the size and 128-bit name of its set, band keys and signature."""

    def fn(columns):
        _remember()
        for t in columns[0]:
            s = shingles(t, rules.width)
            if not len(s):
                yield 0, None, None, None, None
                continue
            name = xxhash.xxh3_128_digest(s.tobytes())
            keys, packed = signature(s, rules)
            yield len(s), int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), keys, packed

    return map_rows(docs, [text], fn, "n_shingles long, s1 long, s2 long, keys array<long>, sig array<long>", keep=keep)


def sets_of(ids: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """``(id, set)`` for the documents named in ``ids``; only their texts are read again."""
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(few(saved(ids.distinct())), "id", "left_semi")
    found = map_rows(own, ["t"], lambda c: ((s.view(np.int64).tolist(),) for s in (shingles(t, rules.width) for t in c[0])), "set array<long>", keep=["id"])
    return saved(found.where(F.size("set") > 0))


def similar(a: str, b: str, rules: NearRules) -> Column:
    """The link itself, on full sets."""
    n = F.size(F.array_intersect(a, b))
    return 100 * n >= rules.percent * (F.size(a) + F.size(b) - n)


def beside(pairs: DataFrame, values: DataFrame, rules: NearRules) -> DataFrame:
    """Saved pairs ``(a, b)`` with the values ``(id, v)`` of both, as ``va`` and ``vb``.

    A node that many pairs have as their ``b``, the centre of a star, is dealt out: its pairs go to as many places as they
    need, and a copy of its value to each.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / rules.block).cast("int").alias("ways")).where("ways > 1")
    hubs = few(saved(hubs))
    ways = F.coalesce("ways", F.lit(1))
    vb = values.select(F.col("id").alias("b"), F.col("v").alias("vb")).join(hubs, "b", "left").select("b", "vb", F.explode(F.sequence(F.lit(0), ways - 1)).alias("way"))
    dealt = pairs.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), ways).cast("int").alias("way"))
    return dealt.join(values.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vb, ["b", "way"]).drop("way")


def confirmed(pairs: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """Those of the saved pairs ``(a, b)`` whose full shingle sets are similar enough."""
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, rules)
    return beside(pairs, sets.withColumnRenamed("set", "v"), rules).where(similar("va", "vb", rules)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearRules | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row per input row, and ``text_hash`` to find the row by.

    Null and empty texts have no shingles and are linked with nothing; an empty table gives an empty result. Rows that repeat an id are judged each by its own
    text; where their sets are nodes of the graph under that id, a link of either holds for both. Equal rows get equal
    results. A row without an id is linked with nothing, has no component and is kept. Ties do not matter, as components
    and their least ids are unique. Extra columns are not read.
    """
    rules = rules or NearRules()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    base = saved(described(docs, ["doc_id", "text_hash"], "text", rules))
    known = base.where("doc_id is not null and s1 is not null")
    classes = saved(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    # A node's row is found by its id, which no group of copies makes hot.
    nodes = saved(
        known.join(classes.withColumnsRenamed({"s1": "c1", "s2": "c2"}), (F.col("doc_id") == F.col("node")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
        .select("node", "keys", "sig", "s1", "s2").dropDuplicates(["node", "s1", "s2"])
    )
    least = rules.percent / 100 - rules.margin
    sig = nodes.select("node", "sig")

    def close(pairs: DataFrame) -> DataFrame:
        given = beside(saved(pairs), sig.withColumnsRenamed({"node": "id", "sig": "v"}), rules)
        return saved(given.where(estimate("va", "vb", rules) >= least).select("a", "b").distinct())

    # Members against the least member of each of their buckets.
    bands = nodes.select("node", F.explode("keys").alias("key"))
    centres = bands.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = close(bands.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    first = saved(components(confirmed(star, docs, rules), "a", "b"))
    labelled = saved(nodes.join(first, "node", "left").select("node", "keys", "sig", F.coalesce("root", "node").alias("comp")))

    # Where a bucket holds part of a large component, its other members are compared with all of that component, block by
    # block; of two large components the smaller one looks for the larger. Signatures go to all blocks, sets only to
    # those that hold a node which is near by them: a row for each such block leaves the join, and not one for each pair.
    sizes = labelled.groupBy("comp").agg(F.count("*").alias("size"))
    large = few(saved(sizes.where(F.col("size") > rules.large)))
    ranked = labelled.join(large, "comp", "left").select("node", "comp", "size", F.explode("keys").alias("key"))
    crowds = ranked.where("size is not null").groupBy("key", F.col("comp").alias("crowd")).agg(F.max("size").alias("crowd_size"))
    smaller = F.expr("comp <> crowd and (size is null or (size, comp) < (crowd_size, crowd))")
    seek = saved(ranked.join(crowds, "key").where(smaller).select(F.col("node").alias("a"), "crowd", "crowd_size").distinct())
    crowd = labelled.join(few(saved(seek.select(F.col("crowd").alias("comp"), "crowd_size").distinct())), "comp")
    crowd = crowd.select(F.col("comp").alias("crowd"), F.col("node").alias("b"), F.col("sig").alias("gb"), F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd_size") / rules.block)).cast("int").alias("block"))
    crowd = saved(crowd)
    seeker = seek.join(sig.withColumnsRenamed({"node": "a", "sig": "ga"}), "a")
    seeker = seeker.select("a", "crowd", "ga", F.explode(F.sequence(F.lit(0), F.ceil(F.col("crowd_size") / rules.block).cast("int") - 1)).alias("block"))
    there = crowd.select(F.col("crowd").alias("c"), F.col("block").alias("k"), "gb")
    seeker = saved(seeker.join(there, (F.col("crowd") == F.col("c")) & (F.col("block") == F.col("k")) & (estimate("ga", "gb", rules) >= least), "left_semi"))
    asked = few(saved(seeker.select("crowd", "block").distinct()))
    crowd = crowd.join(asked, ["crowd", "block"], "left_semi")
    sets = sets_of(seeker.select(F.col("a").alias("id")).union(crowd.select("b")), docs, rules)
    full = crowd.join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
    seeker = seeker.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a")
    found = saved(seeker.join(full, ["crowd", "block"]).where((estimate("ga", "gb", rules) >= least) & similar("sa", "sb", rules)).select("a", "b").distinct())
    label = labelled.select("node", "comp")
    met = found.join(label.withColumnsRenamed({"node": "a", "comp": "ca"}), "a").join(label.withColumnsRenamed({"node": "b", "comp": "cb"}), "b")
    second = saved(components(met.select("ca", "cb"), "ca", "cb").withColumnsRenamed({"node": "comp", "root": "comp2"}))

    # What is left are pairs of nodes in small components. In each bucket the members outside its largest component look
    # for all others; a pair leaves the join only if it is near by its estimate, and once. Those who look are dealt into
    # blocks, so that no task has more than a block of them.
    small = saved(labelled.join(large, "comp", "left_anti").join(few(second), "comp", "left").select("node", "keys", "sig", F.coalesce("comp2", "comp").alias("comp")))
    inside = small.select("node", "comp", F.explode("keys").alias("key"))
    split = inside.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("all"), F.max_by("comp", F.struct("n", "comp")).alias("top")).where("k > 1")
    split = saved(split.select("key", "top", F.ceil(F.col("all") / rules.block).cast("int").alias("ways")))
    here = inside.join(few(split), "key").join(small.select("node", "keys", "sig"), "node")
    side = lambda s: here.select("key", *[F.col(c).alias(f"{n}{s}") for c, n in (("node", ""), ("comp", "c"), ("sig", "g"), ("keys", "k"))], "top", "ways")
    asking = side("a").where("ca <> top").withColumn("way", F.pmod(F.xxhash64("a"), F.col("ways")).cast("int")).drop("ways")
    other = side("b").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("top", "ways")
    # Two nodes that share several buckets meet in the first of them.
    shared = F.zip_with("ka", "kb", lambda x, y: F.when(x == y, x))
    once = F.filter(shared, lambda x: x.isNotNull())[0] == F.col("key")
    near = asking.join(other, ["key", "way"]).where(F.expr("ca <> cb and (cb = top or a < b)") & (estimate("ga", "gb", rules) >= least) & once)
    pairs = saved(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = confirmed(pairs, docs, rules)
    label = saved(labelled.select("node", "comp").join(few(second), "comp", "left").select("node", F.coalesce("comp2", "comp").alias("comp")))
    met = links.join(label.withColumnsRenamed({"node": "a", "comp": "ca"}), "a").join(label.withColumnsRenamed({"node": "b", "comp": "cb"}), "b")
    third = saved(components(met.select("ca", "cb"), "ca", "cb").withColumnsRenamed({"node": "comp", "root": "comp3"}))
    final = label.join(few(third), "comp", "left").select("node", F.coalesce("comp3", "comp").alias("component"))
    final = nodes.select("node", "s1", "s2").join(final.distinct(), "node").select("s1", "s2", "component")

    out = base.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(final, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component", "doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
