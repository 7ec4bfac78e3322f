"""The query surface for an agent: named tools over tables, memory and session, a bounded loop over a chat model."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon
from . import cards as K
from . import digest as D
from . import supply as S
from . import vectors as V


@dataclass
class Tool:
    name: str
    run: Callable[..., Any]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()


class Registry:
    """UDF-16, TOOL-09: tools by name; missing and unknown arguments are told."""

    def __init__(self, tools: list[Tool]):
        self.tools = {t.name: t for t in tools}

    def call(self, name: str, arguments: dict[str, Any]) -> Any:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name!r}; known: {', '.join(sorted(self.tools))}")
        tool = self.tools[name]
        missing = [a for a in tool.required if arguments.get(a) in (None, "")]
        unknown = sorted(set(arguments) - set(tool.required) - set(tool.optional))
        if missing or unknown:
            raise ValueError(f"{name}: missing {missing}, unknown {unknown}")
        return tool.run(**arguments)


# Kinds of memory entries, in the order in which they are told, with their names.
MEMORY_KINDS: dict[str, str] = {"positive": "偏好", "negative": "不要", "read": "已读", "note": "备注"}


@dataclass
class Memory:
    """STR-12 to STR-16, TOOL-08: long-term entries in the order of their last writing."""

    entries: dict[tuple[str, str], bool] = field(default_factory=dict)

    def write(self, kind: str, value: str, persistent: bool) -> None:
        value = value.strip()
        if kind not in MEMORY_KINDS or not value:
            raise ValueError(f"a kind of {', '.join(MEMORY_KINDS)} and a value are needed")
        self.entries.pop((kind, value), None)
        self.entries[kind, value] = persistent

    def forget(self, kind: str, value: str) -> int:
        return int(self.entries.pop((kind, value.strip()), None) is not None)

    def saved(self) -> list[tuple[str, str]]:
        return [k for k, p in self.entries.items() if p]

    def summary(self, limit: int = 500) -> str:
        by = {label: [v for k, v in self.entries if k == kind] for kind, label in MEMORY_KINDS.items()}
        return "\n".join(f"{label}：{'、'.join(v)}" for label, v in by.items() if v)[-limit:]


@dataclass
class Session:
    """SET-02 to SET-04, STR-17, STR-18, WIN-07: what a session has shown, recommended and put aside."""

    seen: dict[str, str] = field(default_factory=dict)
    recommended: dict[str, str] = field(default_factory=dict)
    excluded: dict[str, None] = field(default_factory=dict)

    def note_rows(self, rows: list[dict]) -> None:
        for r in rows:
            self.seen.setdefault(r["novel_id"], r.get("title", ""))

    def note_recommendations(self, rows: list[dict]) -> None:
        for r in rows:
            if r.get("novel_id"):
                self.recommended.setdefault(r["novel_id"], r.get("title", ""))

    def exclude(self, ids: list[str]) -> list[str]:
        new = [i for i in dict.fromkeys(ids) if i not in self.excluded]
        self.excluded.update(dict.fromkeys(new))
        return new

    def avoid(self) -> set[str]:
        return set(self.recommended) | set(self.excluded)

    def summary(self, most: int = 12) -> str:
        last = list(self.recommended.items())[-most:]
        lines = [f"{i}. {t or n}" for i, (n, t) in enumerate(last, 1)]
        return "\n".join(lines + ([f"excluded: {', '.join(self.excluded)}"] if self.excluded else []))


@dataclass
class Engine:
    """TOOL-10: the tables that tools work on; the tools of absent ones are not offered."""

    vectors: DataFrame
    encode: Callable[[str], list[float]]
    cards: DataFrame | None = None
    densities: DataFrame | None = None
    passages: DataFrame | None = None
    profiles: DataFrame | None = None
    sections: DataFrame | None = None
    vocabulary: K.Vocabulary = field(default_factory=K.Vocabulary)
    lexicon: Lexicon = field(default_factory=Lexicon)
    key: str = "novel_id"
    max_search_k: int = 20
    max_passages: int = 5
    preview_chars: int = 300
    passage_chars: int = 800

    def _ids(self, ids: set[str]) -> DataFrame | None:
        return self.vectors.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"{self.key} {self.vectors.schema[self.key].dataType.simpleString()}") if ids else None

    def _k(self, k: int, most: int) -> int:
        if not 1 <= int(k) <= most:
            raise ValueError(f"k must be from 1 to {most}")
        return int(k)

    def _told(self, ranked: DataFrame) -> list[dict]:
        """Ranked rows, of which there are few, with title, preview and label as far as tables for them are there."""
        if self.profiles is not None:
            p = self.profiles.select(self.key, F.coalesce("title", F.lit("")).alias("title"), X.synopsis_preview("text", self.preview_chars).alias("preview"))
            ranked = ranked.join(p, self.key, "left")
        if self.cards is not None:
            ranked = ranked.join(self.cards.select(self.key, K.label().alias("genre")), self.key, "left")
        rows = [r.asDict() for r in ranked.orderBy("rank").collect()]
        return [{k: round(v, 4) if k == "score" else v for k, v in r.items() if k != "title_match" or v} for r in rows]

    def search(self, query: str, k: int = 10, genre: str | None = None, elements: list[str] | None = None, style: list[str] | None = None, avoid: set[str] = frozenset()) -> dict:
        """TOOL-01: filters first, then the nearest, with titles, previews and labels.

        A book whose title is the query, or stands in it, comes first with a score of one and says so. A filter that no card
        fits, or that leaves nothing once ``avoid`` is out, is an error, as are an empty query and a ``k`` out of bounds.
        """
        query, k = str(query).strip(), self._k(k, self.max_search_k)
        if not query:
            raise ValueError("the query is empty")
        spec = K.CardFilter.parse(self.vocabulary, genre, elements, style)
        filtered, allowed, matches = spec != K.CardFilter(), None, 0
        if filtered:
            if self.cards is None:
                raise ValueError("filters need cards")
            allowed = spec.select(self.cards)
            matches = allowed.count()
            if not matches:
                raise ValueError(f"no card fits {spec.describe()}")
            if avoid and allowed.join(self._ids(set(avoid)), self.key, "left_anti").isEmpty():
                raise ValueError("nothing is left without the books already shown")
        out = self._ids(set(avoid))
        top = V.topk(self.vectors, self.encode(query), k, key=self.key, allowed=allowed, avoid=out).withColumn("title_match", F.lit(False))
        if self.profiles is not None:
            titles = V.restricted(self.profiles.select(self.key, X.title_key("title").alias("key")).where("key <> ''"), self.key, allowed, out)
            exact = S.find_titles(self.vectors.sparkSession.createDataFrame([(0, query)], "query_id int, query string"), titles.withColumnRenamed(self.key, "novel_id"))
            named = S.promote(top.select(F.lit(0).alias("query_id"), F.col(self.key).alias("novel_id"), "score", "rank"), exact, k)
            top = named.join(exact.select("novel_id", F.lit(True).alias("title_match")), "novel_id", "left").select(F.col("novel_id").alias(self.key), "score", "rank", F.coalesce("title_match", F.lit(False)).alias("title_match"))
        found: dict[str, Any] = {"results": self._told(top)}
        if filtered:
            found |= {"filter": spec.describe(), "filter_matches": matches}
        return found | ({"excluded": len(avoid)} if avoid else {})

    def similar(self, novel_id: str, k: int = 10, avoid: set[str] = frozenset()) -> dict:
        """TOOL-02: the nearest to a book, without it; a book that neither vectors nor profiles have is an error."""
        k = self._k(k, self.max_search_k)
        own = self.vectors.where(F.col(self.key) == novel_id).select("embedding").first()
        if own is None:
            if self.profiles is None or self.profiles.where(F.col(self.key) == novel_id).isEmpty():
                raise ValueError(f"no such book: {novel_id}")
            return {"anchor": novel_id, "results": []}
        return {"anchor": novel_id, "results": self._told(V.topk(self.vectors, list(own[0]), k, key=self.key, avoid=self._ids(set(avoid) | {novel_id})))}

    def ask(self, novel_id: str, question: str, k: int = 3) -> dict:
        """TOOL-03, VEC-25: passages of one book by their nearness to a question, and what of the book was searched.

        Stored vectors are used as they are; passages without one are encoded here, and a book has few passages.
        """
        question, k = str(question).strip(), self._k(k, self.max_passages)
        if not question:
            raise ValueError("the question is empty")
        own = self.passages.where(F.col(self.key) == novel_id)
        if own.isEmpty():
            raise ValueError(f"no such book: {novel_id}")
        q = F.array(*[F.lit(float(x)) for x in self.encode(question)])
        encode = F.udf(self.encode, "array<double>")
        vector = F.coalesce(F.col("embedding").cast("array<double>"), encode("text"))
        norm = F.sqrt(V.dot("__v", "__v"))
        scored = own.withColumn("__v", vector).withColumn("score", V.dot("__v", q) / F.when(norm > 0, norm).otherwise(1.0))
        kind = F.col("kind") if "kind" in own.columns else F.lit("")
        rows = scored.orderBy(F.desc("score"), "ordinal").limit(k).select(X.heading_of("text").alias("chapter"), kind.alias("kind"), X.truncate("text", self.passage_chars).alias("text"), F.round("score", 4).alias("score")).collect()
        covered = self.sections.where(F.col(self.key) == novel_id).select(D.coverage_text("sections")).first() if self.sections is not None else None
        title = self.profiles.where(F.col(self.key) == novel_id).select("title").first() if self.profiles is not None else None
        note = "only the chapters under coverage were searched; what they do not answer is not known"
        return {"novel_id": novel_id, "title": title[0] or "" if title else "", "coverage": covered[0] if covered else "", "passages": [r.asDict() for r in rows], "note": note}

    def check_term(self, novel_id: str, terms: list[str]) -> dict:
        """TOOL-05: the rule's verdict, what it rests on, and terms that it cannot decide."""
        known = [t for t in terms if t in self.lexicon.term_forms]
        parts = [F.round(K.merged_from_map("densities", self.lexicon.term_forms[t]), 3).alias(f"t{i}") for i, t in enumerate(known)]
        row = self.densities.where(F.col(self.key) == novel_id).select(K.violation_by_terms("densities", known, self.lexicon).alias("v"), *parts).first()
        return {"violation": row.v if row else None, "evidence": {t: row[f"t{i}"] for i, t in enumerate(known)} if row else {}, "uncheckable": [t for t in terms if t not in known]}

    def profile(self, novel_id: str, limit: int = 3000) -> dict:
        """TOOL-04: a book's title, synopsis and opening, and its card if there is one; an unknown book is an error."""
        row = self.cards.where(F.col(self.key) == novel_id).first() if self.cards is not None else None
        out = {k: v[:limit] if isinstance(v, str) else v for k, v in row.asDict(recursive=True).items()} if row else {}
        text = None
        if self.profiles is not None:
            text = self.profiles.where(F.col(self.key) == novel_id).select(self.key, F.coalesce("title", F.lit("")).alias("title"), X.synopsis_preview("text", self.preview_chars).alias("synopsis"), F.substring("text", 1, limit).alias("opening")).first()
        if row is None and text is None:
            raise ValueError(f"no such book: {novel_id}")
        return out | (text.asDict() if text else {})

    def registry(self, memory: Memory, session: Session) -> Registry:
        """TOOL-09."""
        avoid = lambda shown: session.avoid() if shown else set()

        def search(query, k=10, genre=None, elements=None, style=None, exclude_shown=False):
            found = self.search(query, k, genre, elements, style, avoid(exclude_shown))
            session.note_rows(found["results"])
            return found

        def similar(novel_id, k=10, exclude_shown=False):
            found = self.similar(novel_id, k, avoid(exclude_shown))
            session.note_rows(found["results"])
            return found

        tools = [
            Tool("search_books", search, ("query",), ("k", "genre", "elements", "style", "exclude_shown")),
            Tool("similar_books", similar, ("novel_id",), ("k", "exclude_shown")),
            Tool("set_aside", lambda novel_ids: session.exclude(novel_ids), ("novel_ids",)),
            Tool("read_memory", lambda: memory.summary()),
            Tool("write_memory", lambda kind, value, persistent=False: memory.write(kind, value, persistent), ("kind", "value"), ("persistent",)),
        ]
        if self.cards is not None or self.profiles is not None:
            tools.append(Tool("get_profile", self.profile, ("novel_id",)))
        if self.densities is not None:
            tools.append(Tool("check_term", self.check_term, ("novel_id", "terms")))
        if self.passages is not None:
            tools.append(Tool("ask_book", self.ask, ("novel_id", "question"), ("k",)))
        return Registry(tools)


def render(result: Any, limit: int = 6000) -> str:
    """TOOL-15."""
    text = json.dumps(result, ensure_ascii=False, default=str)
    return text if len(text) <= limit else text[: limit - 3] + "..."


def system_prompt(memory: Memory, session: Session) -> str:
    """TOOL-14."""
    return "\n\n".join(p for p in ("Recommend books with the given tools; then finish.", memory.summary(), session.summary()) if p)


@dataclass
class Run:
    termination: str
    answer: str = ""
    recommendations: list[dict] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)


NUDGE = "Call a tool, or finish with an answer."


def run_agent(chat: Callable[[list[dict]], dict], registry: Registry, message: str, required: list[str] = (), max_steps: int = 12, prompt: str = "") -> Run:
    """TOOL-11 to TOOL-13: a bounded loop over a chat model that answers ``{"tool", "arguments"}`` or ``{"finish"}``.

    It ends by ``finish``, ``answer_without_finish`` (two answers in a row that call nothing), ``loop`` (the same call twice
    in a row), ``model_error`` (the model fails) or ``max_steps``. It does not accept a finish without an answer. Each book is
    refused once if a check found that it breaks a condition, and once if it was not checked for every required term.
    """
    messages = [{"role": "system", "content": prompt}, {"role": "user", "content": message}]
    run, last, silent = Run("max_steps"), None, 0
    broken: dict[str, list[str]] = {}
    checked: dict[str, set[str]] = {}
    told_broken: set[str] = set()
    told_unchecked: set[str] = set()
    for _ in range(max_steps):
        try:
            action = chat(messages)
        except Exception as e:  # the model is a foreign service: its failure ends the run, not the program
            run.termination, run.answer = "model_error", f"{type(e).__name__}: {e}"
            return run
        if "finish" in action:
            silent = 0
            picks = [p for p in action["finish"].get("recommendations") or [] if isinstance(p, dict) and p.get("novel_id")]
            bad = [p["novel_id"] for p in picks if p["novel_id"] in broken and p["novel_id"] not in told_broken]
            open_ = [p["novel_id"] for p in picks if p["novel_id"] not in told_unchecked and not set(required) <= checked.get(p["novel_id"], set())]
            if not str(action["finish"].get("answer") or "").strip():
                why = "finish needs an answer"
            elif bad:
                told_broken.update(bad)
                why = "these break a condition: " + "; ".join(f"{i}: {', '.join(broken[i])}" for i in bad)
            elif open_:
                told_unchecked.update(open_)
                why = f"these were not checked for {', '.join(required)}: {', '.join(open_)}"
            else:
                run.termination, run.answer, run.recommendations = "finish", action["finish"]["answer"], picks
                return run
            last = None
            messages.append({"role": "tool", "content": why})
            continue
        if "tool" not in action:
            silent += 1
            run.answer = str(action.get("content") or run.answer)
            if silent == 2:
                run.termination = "answer_without_finish"
                return run
            messages.append({"role": "user", "content": NUDGE})
            continue
        silent, name, arguments = 0, action["tool"], action.get("arguments") or {}
        call = json.dumps([name, arguments], ensure_ascii=False, sort_keys=True, default=str)
        if call == last:
            run.steps.append({"tool": name, "arguments": arguments, "result": None, "error": "the same call as before"})
            run.termination = "loop"
            return run
        last = call
        try:
            result, error = registry.call(name, arguments), None
        except ValueError as e:
            result, error = None, str(e)
        if error is None and name in ("check_term", "check_trope"):
            what = list(arguments["terms"]) if name == "check_term" else [arguments["trope"]]
            checked.setdefault(arguments["novel_id"], set()).update(what)
            if result.get("violation") or result.get("verdict") == "yes":
                broken.setdefault(arguments["novel_id"], []).extend(what)
        run.steps.append({"tool": name, "arguments": arguments, "result": result, "error": error})
        messages.append({"role": "tool", "content": error or render(result)})
    return run
