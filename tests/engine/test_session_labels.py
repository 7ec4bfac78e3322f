"""Labels of sessions that recommend books."""

from loomspark.operators import trajectories as R

SCHEMA = (
    "name string, termination string, recommended array<string>, searched array<string>, in_text array<string>, meta array<string>,"
    " terms map<string,array<string>>, tropes map<string,array<string>>, verdicts map<string,boolean>"
)
GOOD = ("finish", ["a", "b"], ["a", "b", "c"], ["x"], ["m"], {"a": ["x"], "b": ["x", "y"]}, {"a": ["m"], "b": ["m"]}, {"a": False, "b": None})
NAMES = ("termination", "recommended", "searched", "in_text", "meta", "terms", "tropes", "verdicts")
CASES = {
    "good": ({}, [], (2, True, 1.0, 1.0, 0.0, 0.5)),
    "steps": ({"termination": "max_steps"}, ["format", "budget_exhausted"], (2, True, 1.0, 1.0, 0.0, 0.5)),
    "unknown": ({"searched": ["a"]}, ["ungrounded_id"], (2, False, 1.0, 1.0, 0.0, 0.5)),
    "none": ({"recommended": []}, ["no_recommendation"], (0, True, None, None, None, None)),
    "broken": ({"verdicts": {"a": True, "b": False}}, ["constraint_violated"], (2, True, 1.0, 1.0, 0.5, 0.0)),
    "skipped": ({"tropes": {"a": ["m"]}}, ["tool_skipped"], (2, True, 1.0, 0.5, 0.0, 0.5)),
    "free": ({"in_text": None, "meta": None, "terms": None, "tropes": None, "verdicts": {"a": True}}, [], (2, True, None, None, None, None)),
    "silent": ({"verdicts": None}, [], (2, True, 1.0, 1.0, None, 1.0)),
    "nulls": (dict.fromkeys(NAMES), ["format", "no_recommendation"], (0, True, None, None, None, None)),
}


def test_session_labels(spark):
    good = dict(zip(NAMES, GOOD))
    rows = [(name, *[{**good, **change}[c] for c in NAMES]) for name, (change, _, _) in CASES.items()]
    found = {r.name: (r.labels, (r.n, r.grounded, r.term_coverage, r.trope_coverage, r.violation_rate, r.undecided_rate)) for r in R.session_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {name: (labels, rates) for name, (_, labels, rates) in CASES.items()}
    assert R.session_labels(spark.createDataFrame([], SCHEMA)).count() == 0
