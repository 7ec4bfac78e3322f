"""Generators of evaluation tasks: seeded, on the driver, since tasks are few."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Task:
    task_id: str
    kind: str
    sessions: tuple[tuple[str, ...], ...]
    positives: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    variant: str = ""
    meta: dict = field(default_factory=dict)


REQUESTS = ("a book about {p}", "please, something with {p}", "more like {p}")
EXCLUDES = ("but no {n}", "without {n}", "and keep {n} out")


def constrained(n: int, positives: list[str], negatives: list[str], clashes: dict[str, set[str]] | None = None, seed: int = 0, prefix: str = "rec") -> list[Task]:
    """GEN-01: a third each with one exclusion, two, and none; exclusions that a wish implies are not drawn."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = r.choice(positives)
        free = [x for x in negatives if x not in (clashes or {}).get(p, set())]
        neg = tuple(r.sample(free, min((1, 2, 0)[i % 3], len(free))))
        text = ", ".join([r.choice(REQUESTS).format(p=p), *[r.choice(EXCLUDES).format(n=x) for x in neg]])
        out.append(Task(f"{prefix}-{i:04d}", "constrained", ((text,),), (p,), neg, ("one", "two", "none")[i % 3]))
    return out


def memory(n: int, positives: list[str], negatives: list[str], seed: int = 0, prefix: str = "mem") -> list[Task]:
    """GEN-02: what an earlier session said must hold, must hold for it alone, or is taken back."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        p, x, variant = r.choice(positives), r.choice(negatives), ("persists", "session_only", "forgets")[i % 3]
        first = {"persists": f"from now on no {x}", "session_only": f"today no {x}", "forgets": f"from now on no {x}"}[variant]
        middle = ((f"{x} is fine again",),) if variant == "forgets" else ()
        out.append(Task(f"{prefix}-{i:04d}", "memory", ((first,), *middle, (r.choice(REQUESTS).format(p=p),)), (p,), (x,) if variant == "persists" else (), variant))
    return out


def session_state(n: int, positives: list[str], seed: int = 0, prefix: str = "ses") -> list[Task]:
    """GEN-04: follow-ups: others, like the second one, and not the first one."""
    r = random.Random(seed)
    follow = {"more": "others, please", "like_nth": "something like number 2", "exclude_nth": "not number 1 again"}
    kinds = list(follow)
    return [Task(f"{prefix}-{i:04d}", "session", ((r.choice(REQUESTS).format(p=(p := r.choice(positives))),), (follow[kinds[i % 3]],)), (p,), (), kinds[i % 3]) for i in range(n)]


def clarify(n: int, phrases: list[str], seed: int = 0, prefix: str = "clr") -> list[Task]:
    """GEN-05: vague phrases, each once."""
    picked = random.Random(seed).sample(phrases, min(n, len(phrases)))
    return [Task(f"{prefix}-{i:04d}", "clarify", ((p,),)) for i, p in enumerate(picked)]


def book_qa(books: dict[str, list[tuple[int, str, str]]], n: int, seed: int = 0, prefix: str = "qa") -> list[Task]:
    """GEN-03: five kinds of questions on a book, with the answer's place; a kind that a book can't serve becomes the first."""
    r = random.Random(seed)
    ids = sorted(books)
    out = []
    for i in range(n if ids else 0):
        book = ids[i % len(ids)]
        chapters = books[book]
        k = r.randrange(len(chapters))
        number, title, body = chapters[k]
        variant = ("chapter_event", "which_chapter", "before", "after", "quote")[i % 5]
        line = next((x.strip() for x in body.split("\n") if 16 <= len(x.strip()) <= 48), "")
        if variant == "quote" and not line or variant == "before" and k == 0 or variant == "after" and k == len(chapters) - 1:
            variant = "chapter_event"
        ask = {"chapter_event": f"what happens in {title}?", "which_chapter": f"which chapter is number {number}?", "before": f"what comes before {title}?", "after": f"what comes after {title}?", "quote": f"where does it say “{line}”?"}[variant]
        gold = {"before": k - 1, "after": k + 1}.get(variant, k)
        out.append(Task(f"{prefix}-{i:04d}", "book_qa", ((ask,),), variant=variant, meta={"novel_id": book, "chapter": chapters[gold][1]}))
    return out


def score_qa(answer_chapters: list[str], asked_books: list[str], task: Task, match) -> list[str]:
    """EVL-02: labels of an answer: another book asked, no passage fetched, another chapter cited."""
    labels = []
    if not asked_books:
        labels.append("not_asked")
    elif task.meta["novel_id"] not in asked_books:
        labels.append("other_book")
    if not any(match(c, task.meta["chapter"]) for c in answer_chapters):
        labels.append("other_chapter")
    return labels


def format_summary(rows: list[dict], columns: list[str]) -> str:
    """EVL-11: a table in Markdown."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line(["-"] * len(columns)), *[line([r.get(c, "") for c in columns]) for r in rows]])
