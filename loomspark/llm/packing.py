"""Best-fit packing by a configuration linear program over the length histogram.

Only a histogram of piece lengths, one number per length up to the capacity, reaches the driver. There the covering
program over configurations (multisets of lengths that fit a sequence) is solved by multiplicative weights, with a
knapsack dynamic program that prices the best configuration; counts are rounded down to whole sequences, and what is
left over is packed best fit. The plan is an interval table "the a-th to b-th piece of length l goes to slot s of
sequences x to y"; each piece finds its own place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, map_rows, only

# ---------------------------------------------------------------- tokens


class _Memory(dict):
    """A dictionary that makes what it lacks, and starts anew when it is full."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size

    def __missing__(self, key: bytes) -> bytes:
        made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[key] = made
        return made


class WordTokenizer:
    """Ids of a ``tokenizers`` file, with a bounded memory of the words met.

    Texts are cut at ASCII white space only, which no rule of the vocabulary looks across: its normaliser maps white
    space to one space, and its splitter drops it. Each distinct word is encoded by the library itself.
    """

    def __init__(self, file: str, cache_size: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        # Word by word only for the one known arrangement of rules: composition, white space, lower case; then letters,
        # digits and other signs apart, as bytes.
        before, cut = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        self.by_word = [r["type"] for r in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            (r["type"], r.get("pattern", {}).get("Regex"), r.get("invert")) for r in cut.get("pretokenizers", [])
        ] == [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", True), ("ByteLevel", None, None)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        self.alphabet = dict(zip([b for b in range(256) if b not in shown], range(256, 512)))
        self.words = _Memory(self._ids, cache_size)

    def _ids(self, word: bytes) -> bytes:
        """Ids of a word that isn't in memory. A word of letters that no rule but lower-casing changes goes straight
        to the library's merge model, in its byte alphabet; all others go through the whole library."""
        text = word.decode()
        if text[-1] in ".,;:!?" and len(text) > 1 and self.plain(text[:-1]):
            return self.words[word[:-1]] + self.words[word[-1:]]
        if not self.plain(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        low = text.lower()
        if low != text:
            return self.words[low.encode()]
        return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else word.decode("latin-1").translate(self.alphabet))]).tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text; a null text is empty."""
        if not self.by_word:
            return np.asarray(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


@lru_cache(maxsize=2)
def word_tokenizer(file: str | None = None) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    return WordTokenizer(file)


def _remembering(file: str | None) -> WordTokenizer:
    """The tokenizer of a worker, whose memory is the only one there."""
    tokenizer = word_tokenizer(file)
    only("packing", tokenizer.words.clear)
    return tokenizer


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32)``, with ``ids`` on demand; only longer documents are cut.

    A null or empty text gives one piece that holds the end id alone; a very long one is tokenised whole and cut. Repeated
    rows give their pieces each; an empty table gives none. Columns but the id and the text are not read.
    """

    def fn(columns):
        end = np.asarray([end_id], dtype="<u4").tobytes()
        tokenizer = _remembering(file)
        for t in columns[0]:
            raw = tokenizer.encode(t) + end
            cut = [raw[i : i + 4 * capacity] for i in range(0, len(raw), 4 * capacity)]
            yield ([(i, i * capacity, len(x) // 4, zlib.crc32(x), np.frombuffer(x, "<u4").tolist() if with_ids else None) for i, x in enumerate(cut)],)

    out = f"{P}pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<bigint>>>"
    rows = map_rows(docs, [text], fn, out, keep=[doc_id]).select(doc_id, F.inline(f"{P}pieces"))
    return rows if with_ids else rows.drop("ids")


# ---------------------------------------------------------------- the linear program


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most value that fits in each number of tokens, and the index of
    the length taken last (-1: none). A running maximum along each residue class handles all copies of a length at once."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int32)
    for k in np.argsort(-(values / lengths), kind="stable").tolist():
        step, value = int(lengths[k]), float(values[k])
        grid = np.full(-(-(capacity + 1) // step) * step, -np.inf)
        grid[: capacity + 1] = best
        grid = grid.reshape(-1, step)
        copies = np.arange(grid.shape[0])[:, None] * value
        gained = (np.maximum.accumulate(grid - copies, axis=0) + copies).reshape(-1)[: capacity + 1]
        better = gained > best + 1e-12
        best[better] = gained[better]
        choice[better] = k
    return best, choice


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 24, slack: float = 0.02, rate: float = 0.7) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional numbers of sequences by configuration, by multiplicative weights.

    Each round prices configurations with one knapsack table under the present weights: for each length whose share
    of the demand is not yet met, the best configuration that holds it, if it is worth the optimum but for ``slack``.
    After the round the weight of a length falls with what was used beyond its share and rises with what is missing.
    """
    weights = lengths / capacity  # a length's share of a sequence is a feasible dual solution to begin with
    used = np.zeros(len(lengths))
    chosen: dict[tuple[tuple[int, int], ...], float] = {}
    sizes = lengths.tolist()
    for r in range(1, rounds + 1):
        best, choice = knapsack(weights, lengths, capacity)
        share = counts * (r / rounds)
        for k, size in enumerate(sizes):
            missing = share[k] - used[k]
            if missing <= 0 or weights[k] + best[capacity - size] < (1 - slack) * best[capacity]:
                continue
            config = {k: 1}
            c = capacity - size
            while choice[c] >= 0:
                config[int(choice[c])] = config.get(int(choice[c]), 0) + 1
                c -= sizes[choice[c]]
            x = min(missing / config[k], *(max(counts[i] - used[i], counts[i] / rounds) / n for i, n in config.items()))
            key = tuple(sorted(config.items()))
            chosen[key] = chosen.get(key, 0.0) + x
            for i, n in config.items():
                used[i] += n * x
        weights = weights * np.exp(-rate * np.clip((used - share) / counts, -1, 1))
        weights = np.clip(weights / (lengths / capacity), 1e-3, 1e3) * (lengths / capacity)
    return chosen


def solve(histogram: dict[int, int], capacity: int, shares: tuple[float, ...] = (1.0, 0.97, 0.9, 0.8, 0.6, 0.4, 0.2)) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences by configuration: ``[([(length, copies), ...], number of sequences), ...]`` that use every piece.

    A share of each fractional number is rounded down to whole sequences, as long as pieces last; configurations that
    leave room are left out, but for one more plan that takes them in. What remains is packed best fit, longest first. Of these plans the one that needs
    the fewest sequences is taken: the more is left to the last step, the more kinds of pieces it can choose from.
    """
    start = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if not start:
        return []
    lengths = np.array(sorted(start, reverse=True))
    counts = np.array([start[k] for k in lengths.tolist()], dtype=np.int64)
    mix = sorted(configurations(lengths, counts, capacity).items(), key=lambda m: (-m[1], m[0]))
    every = [([(int(lengths[k]), n) for k, n in config], x) for config, x in mix]
    full = [(content, x) for content, x in every if sum(size * n for size, n in content) == capacity]
    best: list[tuple[list[tuple[int, int]], int]] = []
    for pool, share in [*((full, share) for share in shares), (every, 1.0)]:
        left = dict(start)
        plan = []
        for content, x in pool:
            number = min(int(x * share), *(left[size] // n for size, n in content))
            if number > 0:
                plan.append((content, number))
                for size, n in content:
                    left[size] -= n * number
        plan += best_fit({k: v for k, v in left.items() if v}, capacity)
        if not best or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram: sequences with equal contents are handled together."""
    gaps: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    present = np.zeros(capacity + 1, dtype=np.int64)
    for length in sorted(histogram, reverse=True):
        todo = int(histogram[length])
        while todo:
            fits = np.flatnonzero(present[length:])
            if len(fits):
                gap = length + int(fits[0])
                held, number = gaps[gap].popitem()
                take = min(number, todo)
                if number > take:
                    gaps[gap][held] = number - take
                present[gap] -= take
            else:
                per = capacity // length
                whole = todo // per
                if whole > 0:
                    key, gap, take = ((length, per),), capacity - per * length, whole
                    gaps[gap][key] = gaps[gap].get(key, 0) + take
                    present[gap] += take
                    todo -= whole * per
                    continue
                held, gap, take = (), capacity, 1
            content = dict(held)
            content[length] = content.get(length, 0) + 1
            key = tuple(sorted(content.items()))
            gaps[gap - length][key] = gaps[gap - length].get(key, 0) + take
            present[gap - length] += take
            todo -= take
    return [([*key], n) for g in gaps for key, n in g.items()]


def intervals(plan: list[tuple[list[tuple[int, int]], int]], first: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, from_rank, to_rank, sequences, first_sequence, offset)``: ranks ``from <= r < to`` of a length
    go to sequence ``first_sequence + (r - from) % sequences`` at ``offset + length * ((r - from) // sequences)``."""
    at: Counter = Counter()
    rows = []
    for content, number in plan:
        offset = 0
        for length, copies in content:
            rows.append((length, at[length], at[length] + copies * number, number, first, offset))
            at[length] += copies * number
            offset += copies * length
        first += number
    return rows


# ---------------------------------------------------------------- the distributed part

#: Pieces of one length are ranked in independent groups of about so many.
_RANK_GROUP = 1_000


def pack(rows: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of pieces. Every row gets its own place; equal rows are told apart.

    A piece of the full capacity has a sequence to itself, named by its own rank, and takes no part in the program.
    Equal lengths are placed in the order of a hash, and rows that are equal throughout in any; an empty table gives an
    empty result. Ranks are counted within ``(length, salt)`` groups, and the groups' sizes are summed up, so a length that most
    pieces share is dealt out to many tasks. A length over the capacity, under one, or null is an error.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    total = rows.groupBy(length).count().collect()  # at most ``capacity`` rows
    histogram = {r[0]: r[1] for r in total}
    if any(k is None or k < 1 or k > capacity for k in histogram):
        raise ValueError("a piece is longer than a sequence, or empty")
    plan = solve({k: v for k, v in histogram.items() if k < capacity}, capacity)
    n_packed = sum(n for _, n in plan)
    table = intervals(plan)
    if histogram.get(capacity):
        table.append((capacity, 0, histogram[capacity], histogram[capacity], n_packed, 0))
    schema = "l long, a long, b long, n long, s long, o long"
    by_length = (
        spark.createDataFrame(table, schema).groupBy("l").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n", "s", "o"))).alias("t"))
    )  # one row per length; its intervals are as many as there are configurations that use it
    # The checksum tells pieces apart whose ids are missing or repeated.
    dealt = [c for c in ("ids_crc32",) if c in rows.columns and c not in order]
    # Each length is ranked in as many groups as its pieces need; where a group's ranks begin is joined, not broadcast.
    groups = spark.createDataFrame([(k, -(-v // _RANK_GROUP)) for k, v in histogram.items()], f"{P}l long, {P}n long")
    salted = rows.join(F.broadcast(groups), F.col(length) == F.col(f"{P}l")).withColumn(f"{P}g", F.pmod(F.xxhash64(*order, *dealt), F.col(f"{P}n")).cast("int")).drop(f"{P}l", f"{P}n")
    sizes = salted.groupBy(F.col(length).alias("l"), F.col(f"{P}g").alias("g")).count()
    before = Window.partitionBy("l").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("l").alias(f"{P}l"), F.col("g").alias(f"{P}s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(f"{P}first"))
    within = Window.partitionBy(length, f"{P}g").orderBy(*order)
    ranked = salted.withColumn(f"{P}r", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, (F.col(length) == F.col(f"{P}l")) & (F.col(f"{P}g") == F.col(f"{P}s"))).withColumn(f"{P}r", F.col(f"{P}r") + F.col(f"{P}first"))
    found = ranked.drop(f"{P}l", f"{P}s").join(F.broadcast(by_length.withColumnsRenamed({"l": f"{P}l", "t": f"{P}t"})), F.col(length) == F.col(f"{P}l"))
    slot = F.filter(f"{P}t", lambda t: (t["a"] <= F.col(f"{P}r")) & (F.col(f"{P}r") < t["b"]))[0]
    placed = found.withColumn(f"{P}slot", slot)
    step = F.col(f"{P}r") - F.col(f"{P}slot.a")
    return placed.select(
        *rows.columns,
        (F.col(f"{P}slot.s") + step % F.col(f"{P}slot.n")).alias("sequence_id"),
        (F.col(f"{P}slot.o") + F.col(length) * F.floor(step / F.col(f"{P}slot.n")).cast("long")).alias("offset"),
    )
