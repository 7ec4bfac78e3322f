"""SentencePiece merge-type encoding by backtracking, and decoding.

A merge-type encoding is the only sequence of vocabulary pieces in which every piece, and every pair of neighbours,
re-merges to itself. The encoder walks a word with the longest pieces that an Aho-Corasick automaton finds, takes
a piece if it stands the pair check with its left neighbour, goes to shorter prefixes otherwise, and remembers in a
bitfield the positions from which no encoding goes on.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb

SPACE = "▁"
#: No piece holds the space mark after another character (checked when a model is loaded), so no merge crosses this cut.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class PieceEncoder:
    """Encoder of one model file. ``cache_size`` bounds the encoded words, and the checked pairs, that are remembered."""

    def __init__(self, model_file: str, cache_size: int = 400_000):
        proto = model_pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = model_pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != model_pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("only merge-type models without a character map, user symbols or unused pieces are supported")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.dummy_prefix = spec.add_dummy_prefix
        self.eos = self.processor.eos_id()
        self.unk = self.processor.unk_id()
        self.pieces = [p.piece for p in proto.pieces]
        self.normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("a piece holds the space mark inside a word")
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE} if proto.trainer_spec.byte_fallback else None
        self.score = {p: s for p, (_, s) in self.normal.items()}
        self.halves: dict[str, list[str]] = {}
        self.singles = {p for p in self.normal if len(p) == 1}
        # Pieces that the merges never yield are left out of the automaton.
        reachable = {p for p in self.normal if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in reachable), None) for p in reachable}
        self.cache_size = cache_size
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, word: str, stop: int = 1) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until no merge, or no more than ``stop`` parts, are left."""
        parts, normal = list(word), self.normal
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = normal.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Do these neighbours come out of merging their joined text again?"""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.cache_size:
                self.pairs.clear()
            # Runs of space marks all have one score, so only merging them tells.
            tied = SPACE * 2 in left + right
            known = self.pairs[key] = self.merge(left + right) == [left, right] if tied else self.apart(left, right)
        return known

    def apart(self, left: str, right: str) -> bool:
        """Re-merge two pieces along their border only, backwards in time.

        The last of the merges that made the two is undone; the parts that then touch must not merge earlier than the
        merge just undone, or, if that one lies to the right, at the same score. Equal when no merge is left to undo.
        """
        score, last, after_equal = self.score, -float("inf"), False
        while True:
            both = score.get(left + right)
            if both is not None and (both > last or both == last and after_equal):
                return False
            a, b = score[left], score[right]
            if len(left) > 1 and (len(right) == 1 or a < b):
                last, after_equal = a, False
                left = self.parts(left)[1]
            elif len(right) > 1:
                last, after_equal = b, True
                right = self.parts(right)[0]
            else:
                return True

    def parts(self, piece: str) -> list[str]:
        """The two parts whose merge makes a piece."""
        known = self.halves.get(piece)
        if known is None:
            known = self.halves[piece] = self.merge(piece, 2)
        return known

    def backtrack(self, word: str) -> list[str]:
        """Pieces of a word all of whose characters are in the vocabulary."""
        n = len(word)
        longest: list[str | None] = [None] * (n + 1)
        for end, piece in self.automaton.iter(word):
            start = end + 1 - len(piece)
            if longest[start] is None or len(piece) > len(longest[start]):
                longest[start] = piece
        dead = bytearray(n // 8 + 1)  # a bit for each position from which no encoding goes on
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not dead[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece is None:
                dead[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no encoding")
                piece = out.pop()
                at -= len(piece)
            else:
                out.append(piece)
                at += len(piece)
                piece = longest[at]
        return out

    def _encode_chunk(self, chunk: str) -> list[int]:
        if self.singles.issuperset(chunk):
            return [self.normal[p][0] for p in self.backtrack(chunk)]
        ids: list[int] = []
        run = ""
        for c in [*chunk, ""]:
            if c in self.singles:
                run += c
                continue
            if run:
                ids += [self.normal[p][0] for p in self.backtrack(run)]
                run = ""
            if c:
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without an end id; a null text is empty."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        out: list[int] = []
        words = self.words
        for chunk in _CHUNK.findall(text):
            ids = words.get(chunk)
            if ids is None:
                ids = self._encode_chunk(chunk)
                if len(chunk) <= 64:
                    if len(words) >= self.cache_size:
                        words.clear()
                    words[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, by the library's own decoder."""
        return self.processor.decode(ids)


@lru_cache(maxsize=2)
def encoder(model_file: str | None = None) -> PieceEncoder:
    """The encoder of a process, made once and kept between tasks."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return PieceEncoder(model_file)


def encoded(docs, keep: list[str], text: str = "text", model_file: str | None = None, add_eos: bool = True, with_ids: bool = True):
    """``ids array<int>``, ``decoded string`` and their digests beside the ``keep`` columns, over whole texts.

    Null and empty texts give the end id alone and decode to the empty text. Repeated rows are treated alike, an empty
    table gives an empty result, and kept columns named like a result give way; nothing ties. Very long texts are encoded whole. Texts
    go through row by row, so memory is bounded by the longest text and the two bounded caches of a process.
    """
    import hashlib

    from .common import map_rows

    def fn(columns):
        e = encoder(model_file)
        for t in columns[0]:
            ids = e.encode(t)
            if add_eos:
                ids = [*ids, e.eos]
            back = e.decode(ids)
            yield (
                len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
                ids if with_ids else None, back if with_ids else None,
            )

    made = map_rows(docs, [text], fn, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string", keep=keep)
    return made if with_ids else made.drop("ids", "decoded")
