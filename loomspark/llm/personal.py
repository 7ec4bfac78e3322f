"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, map_rows

#: Order of the kinds in results; the first four are the base kinds, which always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
# A match can only begin where a run of digits begins, and a run is never given back, so these take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

# Words that make a kind likelier when they stand nearby (fixed values).
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "tax"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon"),
    "email": ("mail", "email", "contact", "kontakt"),
    "ip": ("ip", "address", "server", "host"),
}

# Digits of an IBAN by country (fixed values); other countries are confirmed by the checksum alone.
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "AT": 20, "BE": 16, "CH": 21, "PL": 28, "PT": 25, "SE": 24}


@dataclass(frozen=True)
class PiiRules:
    """An added span is kept if its score reaches ``threshold``; base spans carry a score too but always stay."""

    threshold: float = 0.6
    window: int = 40
    context_bonus: float = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, sign and domain, found from each sign so that time stays linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind and then start; positions count code points and ends are exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    # Parts may be long: leading zeros aside, a part over three digits is over 255.
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def scored_spans(text: str | None, rules: PiiRules = PiiRules()) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: the base ones, and those added kinds that reach the threshold and touch no base span."""
    if not text:
        return []
    base = base_spans(text)
    proposed: list[tuple[str, int, int, float]] = [(k, a, b, 0.9 if k == "card" else 0.8) for k, a, b in base]
    added: list[tuple[str, int, int, float]] = []
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            # The greedy match may run into capitals that follow; the country's length, or the checksum, says where it ends.
            flat = [i for i in range(m.start(), m.end()) if text[i] != " "]
            known = IBAN_LENGTH.get(m[0][:2])
            for n in [known] if known else range(min(34, len(flat)), 14, -1):
                if n <= len(flat) and mod97("".join(text[i] for i in flat[:n])) and not text[flat[n - 1] + 1 : flat[n - 1] + 2].isalnum():
                    added.append(("iban", m.start(), flat[n - 1] + 1, 0.8 if known else 0.5))
                    break
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                added.append(("ssn", *m.span(), 0.4))
    out = []
    for i, (k, a, b, score) in enumerate(proposed + added):
        near = (text[max(0, a - rules.window) : a] + " " + text[b : b + rules.window]).lower()
        if any(w in CONTEXT[k] for w in re.findall(r"[a-z]+", near)):
            score = min(1.0, score + rules.context_bonus)
        if i < len(proposed) or score >= rules.threshold and not any(x < b and a < y for _, x, y in base):
            out.append((k, a, b, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def detect(docs: DataFrame, keep: list[str], text: str = "text", rules: PiiRules = PiiRules()) -> DataFrame:
    """``pii array<struct<kind, start, end, score>>`` beside the ``keep`` columns, over whole texts.

    A null or empty text has no spans; very long texts are searched whole; repeated rows are treated alike; spans are in
    the order of kinds and places, so none tie; an empty table gives an empty result; a kept column named ``pii`` gives way.
    """

    def fn(columns):
        for t in columns[0]:
            yield ([{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in scored_spans(t, rules)],)

    return map_rows(docs, [text], fn, "pii array<struct<kind:string,start:bigint,end:bigint,score:double>>", keep=keep)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The counts of base kinds, the checksum of base spans, and all spans as text."""
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:4]))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(doc_id, *map(count, KINDS[:4]), F.sha2(told(base), 256).alias("base_sha256"), told("pii").alias("spans"))


def redact_text(text: str | None, rules: PiiRules = PiiRules()) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of spans that touch, the first is named."""
    spans = sorted(scored_spans(text, rules), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, at = [], 0
    for k, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", rules: PiiRules = PiiRules()) -> DataFrame:
    """The documents with all spans masked; other columns stay as they are, whatever their names, null texts stay null and
    empty ones empty, repeated rows are masked alike, and an empty table stays empty."""
    done = map_rows(docs, [text], lambda columns: ((redact_text(t, rules),) for t in columns[0]), f"{P}text string", keep=[c for c in docs.columns if c != text])
    return done.select(*[F.col(f"{P}text").alias(c) if c == text else c for c in docs.columns])
