"""Labels of sessions that ask about one book."""

from loomspark.operators import trajectories as R

CHAPTERS = [("opening", "第1章 山门", "少年背着木剑走进云雾深处的山门拜师学艺"), ("middle", "第20章 比剑", "两位剑客在雪夜的湖心亭比试剑法直到天明")]
SCHEMA = (
    "name string, termination string, novel_id string, answerable boolean, gold array<string>, question string, final_answer string, asked boolean,"
    " profiled boolean, returned array<string>, passages array<string>, citations array<struct<novel_id:string,chapter:string>>, chapters array<struct<kind:string,heading:string,text:string>>"
)
GOOD = dict(
    termination="finish", novel_id="b1", answerable=True, gold=["第20章 比剑"], question="第二十章讲了什么？", final_answer="两位剑客在雪夜的湖心亭比试剑法", asked=True,
    profiled=False, returned=["第20章 比剑", "简介"], passages=["两位剑客在雪夜"], citations=[("b1", "第二十章")], chapters=CHAPTERS,
)
CASES = {
    "good": ({}, []),
    "section": ({"citations": [("b1", "第20章"), ("b1", "简 介")]}, []),
    "steps": ({"termination": "max_steps"}, ["format", "budget_exhausted"]),
    "loop": ({"termination": "loop"}, ["format", "loop"]),
    "no end": ({"termination": None}, ["format"]),
    "unresolved": ({"asked": False, "returned": []}, ["book_unresolved", "chapter_not_retrieved"]),
    "invented": ({"citations": [("b1", "第20章"), ("b1", "第99章")]}, ["ungrounded_citation"]),
    "other book": ({"citations": [("b2", "第20章")]}, ["ungrounded_citation"]),
    "no citation": ({"citations": None}, ["no_citation"]),
    "other chapter": ({"citations": [("b1", "第1章")]}, ["gold_not_cited", "answer_unsupported"]),
    "unsupported": ({"final_answer": "大海上的船队遇到风暴全部沉没无人生还"}, ["answer_unsupported"]),
    "short answer": ({"final_answer": "比剑"}, []),
    "profile": ({"gold": ["第1章 山门"], "profiled": True, "asked": False, "returned": None, "citations": [("b1", "第1章")], "final_answer": "少年背着木剑走进云雾深处"}, []),
    "quote shown": ({"question": "「两位剑客在雪夜」在哪一章？", "citations": []}, ["no_citation"]),
    "quote not shown": ({"question": "「湖心亭比试剑法」在哪一章？", "citations": []}, ["quote_not_retrieved"]),
    "quote not shown, right": ({"question": "「湖心亭比试剑法」在哪一章？"}, []),
    "heading quoted": ({"question": "「第20章 比剑」讲了什么？", "citations": []}, ["no_citation"]),
    "fabricated": ({"answerable": False}, ["fabricated_answer"]),
    "abstained": ({"answerable": False, "final_answer": "摘要里没有这一章"}, []),
    "redacted": ({"answerable": False, "final_answer": None}, []),
    "nothing known": ({"answerable": None, "gold": None, "chapters": None, "citations": None, "returned": None, "question": None}, ["chapter_not_retrieved"]),
}


def test_qa_labels(spark):
    names = [c.split()[0] for c in SCHEMA.replace("<novel_id:string,", "<").split(", ")]
    rows = [tuple({**GOOD, **change, "name": name}[c] for c in names) for name, (change, _) in CASES.items()]
    found = {r.name: r.labels for r in R.qa_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {name: labels for name, (_, labels) in CASES.items()}
    assert R.qa_labels(spark.createDataFrame([], SCHEMA)).count() == 0
