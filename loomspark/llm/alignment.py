"""Alignment of two tokenizers' ids, and in how many documents each pair of ids is linked.

Both tokenizers cut the same bytes. Where both have a token end, a group ends; tokens whose bytes overlap are linked. A
link's two ids are packed into one 64-bit key. Distinct keys of documents are counted by partition, the partial counts are
sorted by ranges of keys over all machines, and equal neighbours are summed. Each range is a pair of sorted arrays in a file
of the shared folder; whoever looks a key up maps the files into memory and searches them by halving.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, map_rows, new_folder, saved

SHIFT = 32

#: What the faster merging library is not asked about: characters whose classes later editions of Unicode may have changed,
#: and runs so long that its splitter goes back far.
_RARE = re.compile("[^\x00-\u024f]|\\S{2000}|\\s{500}")

# ---------------------------------------------------------------- tokens


def _shown_bytes() -> dict[str, int]:
    """The characters by which a byte-level vocabulary shows bytes: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """What the ids of a vocabulary stand for: the bytes of each and their numbers."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Pair:
    """The two tokenizers: a byte-level one of the ``tokenizers`` library, which gets a space before each text, and a
    ``sentencepiece`` model, which adds that space itself. Special tokens are plain text to both."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(byte_file)
        self.tokenizer.encode_special_tokens = True
        back = _shown_bytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.a = Tokens(pieces)
        self.merging = self._merging(pieces)
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.b = Tokens([bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])
        #: Decimal digits of the first's ids, then the second's, with each sign that may follow them.
        self.spelled = [f"{i}{end}" for end in (",", "|", ";", "") for t in (self.a, self.b) for i in range(len(t.pieces))]

    def _merging(self, pieces: list[bytes]):
        """The same byte-level tokenizer in the ``tiktoken`` library, which is some three times as fast, where its ids are
        in the order of its merges and it splits by the usual pattern; else None."""
        import public_tokenizers
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        if not usual or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {pieces[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("by merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_bytes(self, text: str) -> list[int]:
        if self.merging is not None and not _RARE.search(text):
            return self.merging.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a whole text by both; None where there is no text, or one of them doesn't spell it."""
        if not text:
            return None
        spaced = " " + text
        raw = spaced.encode()
        a = self.encode_bytes(spaced)
        b = self.processor.encode(text)
        if self.a.joined(a) != raw or self.b.joined(b) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@lru_cache(maxsize=2)
def tokenizers_of(byte_file: str | None = None, piece_file: str | None = None) -> Pair:
    """The tokenizers of a process, made once and kept between tasks."""
    import public_tokenizers

    return Pair(byte_file or public_tokenizers.path("byte_bpe_50k.json"), piece_file or public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Aligned:
    """Groups and links of one text. Each stretch between two neighbouring token ends, of whichever tokenizer, lies in one
    token of each, and two tokens that overlap share exactly one such stretch."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray = field(repr=False)  # does a group end with this token?
    b_last: np.ndarray = field(repr=False)
    links: np.ndarray = field(repr=False)  # packed pairs, one for each link

    @property
    def n_groups(self) -> int:
        return int(self.a_last.sum())


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    end_a, end_b = np.zeros((2, int(a_ends[-1]) + 1), dtype=bool)  # a flag for each byte
    end_a[a_ends] = end_b[b_ends] = True
    cuts = np.flatnonzero(end_a | end_b)
    at_a, at_b = end_a[cuts], end_b[cuts]
    links = a[np.cumsum(at_a) - at_a] << SHIFT | b[np.cumsum(at_b) - at_b]
    return Aligned(a, b, end_b[a_ends], end_a[b_ends], links)


def spelled(x: Aligned, pair: Pair) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    count = len(x.a)
    group = np.concatenate([2 * (np.cumsum(x.a_last) - x.a_last), 2 * (np.cumsum(x.b_last) - x.b_last) + 1])
    order = np.argsort(group, kind="stable")
    ids, last = np.concatenate([x.a, x.b])[order], np.concatenate([x.a_last, x.b_last])[order]
    of_b = order >= count
    ending = np.where(last, np.where(of_b, 2, 1), 0)
    ending[-1] = 3
    size = len(pair.a.pieces)
    return "".join(map(pair.spelled.__getitem__, (ids + of_b * size + ending * (size + len(pair.b.pieces))).tolist()))


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, keep: list[str], text: str = "text", byte_file: str | None = None, piece_file: str | None = None, with_groups: bool = True) -> DataFrame:
    """Alignments of whole texts: numbers of tokens, groups and links, the groups themselves on demand, and the distinct
    packed pairs in ascending order with the number of links of each.

    Null and empty texts, and those that a tokenizer doesn't spell byte by byte, have no tokens: zeros, empty groups, no
    pairs. Very long texts are encoded whole, one text at a time. Repeated rows have equal values; an empty table gives an
    empty result; kept columns named like a result give way.
    """

    def fn(columns):
        pair = tokenizers_of(byte_file, piece_file)
        for t in columns[0]:
            ids = pair.encode(t)
            if ids is None:
                yield (0, 0, 0, 0, "", "" if with_groups else None, [], [])
                continue
            x = align(*ids, pair.a.ends(ids[0]), pair.b.ends(ids[1]))
            groups = spelled(x, pair)
            keys, times = np.unique(x.links, return_counts=True)
            yield len(x.a), len(x.b), x.n_groups, len(x.links), hashlib.sha256(groups.encode()).hexdigest(), groups if with_groups else None, keys, times.astype(np.int32)

    made = map_rows(docs, [text], fn, _ALIGNED, keep=keep)
    return made if with_groups else made.drop("groups")


# ---------------------------------------------------------------- counts


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the folder's place in it."""
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        return pafs.LocalFileSystem(), where.path
    return pafs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class PairCounts:
    """Counts of packed pairs: sorted shards ``(file, least key, greatest key, length)`` in a shared folder, and of each
    first id the greatest count. The list of shards and the greatest counts are bounded by Spark's partitions and by the
    vocabulary, so they travel with the tasks; the shards stay in the folder."""

    folder: str
    shards: tuple[tuple[str, int, int, int], ...]
    greatest: np.ndarray = field(repr=False)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending distinct keys; 0 for a key that was never counted."""
        out = np.zeros(len(keys), dtype=np.int64)
        for name, low, high, length in self.shards:
            i, j = np.searchsorted(keys, low), np.searchsorted(keys, high, side="right")
            if i < j:
                known, counts = _mapped(self.folder, name, length)
                at = np.searchsorted(known, keys[i:j])
                out[i:j] = np.where(known[np.minimum(at, length - 1)] == keys[i:j], counts[np.minimum(at, length - 1)], 0)
        return out

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of keys in any order, repeated or not, and whether each is the greatest of its first id."""
        distinct, at = np.unique(keys, return_inverse=True)
        counts = self.lookup(distinct)
        first = distinct >> SHIFT
        known = first < len(self.greatest)
        best = known & (counts == np.where(known, self.greatest[np.where(known, first, 0)], -1)) if len(self.greatest) else np.zeros(len(distinct), dtype=bool)
        return counts[at], best[at]


@lru_cache(maxsize=512)
def _mapped(folder: str, name: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard. On a mounted folder the file is mapped, so that only what a search touches is read;
    elsewhere it is read whole."""
    store, path = _store(folder)
    if isinstance(store, pafs.LocalFileSystem):
        both = np.memmap(f"{path}/{name}", dtype="<i8", mode="r", shape=(2, length))
    else:
        with store.open_input_file(f"{path}/{name}") as f:
            both = np.frombuffer(f.read(), dtype="<i8").reshape(2, length)
    return both[0], both[1]


_COUNT = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], hold: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Counts of the keys in a partition's lists. At most ``hold`` keys wait to be summed; what has been summed is handed
    on when as many are distinct, and sums are summed again later."""
    keys, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([keys, *waiting])
        ones = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
        distinct, at = np.unique(every, return_inverse=True)
        return distinct, np.bincount(at, weights=ones, minlength=len(distinct)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(counts[i : i + 100_000])], schema=_COUNT)

    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        waiting.append(flat)
        held += len(flat)
        if held >= hold:
            keys, counts = summed()
            waiting, held = [], 0
            if len(keys) >= hold:
                yield from out()
                keys, counts = keys[:0], counts[:0]
    keys, counts = summed()
    yield from out()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of equal neighbours in ascending keys. The last key of a batch waits for the next one."""
    key, total = None, 0
    for batch in batches:
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if key is not None:
            k, n = np.concatenate([[key], k]), np.concatenate([[total], n])
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sums = np.add.reduceat(n, starts)
        key, total = int(k[-1]), int(sums[-1])
        yield k[starts[:-1]], sums[:-1]
    if key is not None:
        yield np.array([key], np.int64), np.array([total], np.int64)


def count_pairs(links: DataFrame, pairs: str = "pairs", ranges: int | None = None) -> PairCounts:
    """In how many rows each key stands; a row's list holds a key once. Spark chooses the number of ``ranges`` unless told.

    Null lists and an empty table give no counts. A key reaches its range once or so from each partition, however often it
    stands there, so no range grows with a hot key. A task that writes a shard does so under a name of its own and moves it
    into place at the end, so it may run twice or be lost.
    """
    spark = links.sparkSession
    folder = new_folder(spark)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    partial = links.select(F.coalesce(F.col(pairs), F.array().cast("array<long>"))).mapInArrow(_counted, "key long, n long")
    schema = pa.schema([("name", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("length", pa.int64()), ("firsts", pa.list_(pa.int64())), ("greatest", pa.list_(pa.int64()))])

    def write(batches):
        from pyspark import TaskContext

        store, path = _store(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}"
        own = f"{path}/{name}-{uuid.uuid4().hex}"
        low, high, length, greatest = None, 0, 0, {}
        counts = []
        with store.open_output_stream(own) as f:
            for k, n in _run_lengths(batches):
                if not len(k):
                    continue
                f.write(np.ascontiguousarray(k, dtype="<i8"))
                counts.append(n.astype("<i8"))  # eight bytes for each distinct key of a range
                low, high, length = int(k[0]) if low is None else low, int(k[-1]), length + len(k)
                first = k >> SHIFT
                starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                for i, m in zip(first[starts].tolist(), np.maximum.reduceat(n, starts).tolist()):
                    greatest[i] = max(m, greatest.get(i, 0))
            for n in counts:
                f.write(np.ascontiguousarray(n))
        if length:
            store.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"name": name, "low": low, "high": high, "length": length, "firsts": list(greatest), "greatest": list(greatest.values())}], schema=schema)
        else:
            store.delete_file(own)

    ranges = partial.repartitionByRange(*([] if ranges is None else [ranges]), "key").sortWithinPartitions("key")
    made = ranges.mapInArrow(write, "name string, low long, high long, length long, firsts array<long>, greatest array<long>").collect()
    top = np.zeros(1 + max((max(r.firsts) for r in made), default=-1), dtype=np.int64)
    for r in made:
        np.maximum.at(top, np.array(r.firsts, dtype=np.int64), np.array(r.greatest, dtype=np.int64))
    return PairCounts(folder, tuple(sorted((r.name, r.low, r.high, r.length) for r in made)), top)


def with_counts(links: DataFrame, counts: PairCounts, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """``n_best``, the links whose count is the greatest of their first id, and ``count_sum``, the sum of counts over all
    links, in place of the pair columns. Rows without pairs have zeros."""
    keep = [c for c in links.columns if c not in (pairs, times, "n_best", "count_sum")]
    kept = [F.col(f"`{c}`").alias(f"{P}k{i}") for i, c in enumerate(keep)]
    sent = links.select(*kept, F.coalesce(F.col(pairs), F.array().cast("array<long>")).alias(f"{P}pairs"), F.coalesce(F.col(times), F.array().cast("array<int>")).alias(f"{P}times"))
    n_kept = len(keep)

    def run(batches):
        for batch in batches:
            lists = batch.column(n_kept)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            each = batch.column(n_kept + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            found, best = counts.of(keys)
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (each * best, each * found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_kept)), *(pa.array(s) for s in sums)], names=[*(f"{P}k{i}" for i in range(n_kept)), "n_best", "count_sum"])

    schema = ", ".join([f"{P}k{i} {links.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["n_best long", "count_sum long"])
    return sent.mapInArrow(run, schema).select(*[F.col(f"{P}k{i}").alias(c) for i, c in enumerate(keep)], "n_best", "count_sum")


def alignment_table(docs: DataFrame, keep: list[str], text: str = "text", byte_file: str | None = None, piece_file: str | None = None) -> DataFrame:
    """Alignments of whole texts with their counts over all rows: texts are encoded once, and their pairs are written."""
    links = saved(aligned(docs, keep, text, byte_file, piece_file, with_groups=False), compression="zstd")
    return with_counts(links, count_pairs(links))
