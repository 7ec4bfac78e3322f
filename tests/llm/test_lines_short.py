"""Line dedup with the production rules: exact copies of short lines."""

from __future__ import annotations

from helpers import documents
from loomspark.llm import lines


def test_short_lines_go_as_exact_copies_only(spark):
    long = "a line that is certainly long enough"
    texts = [(1, f"Title\n\n{long}\nAll rights reserved."), (2, f"Titles\n\n \nmore\nAll rights reserved.\nmore"), (3, f"Title\n{long}"), (4, "\r\n\n"), (5, None)]
    rows = {r.doc_id: r for r in lines.dedup(documents(spark, texts)).collect()}
    assert rows[1].text == texts[0][1] and (rows[1].n_lines, rows[1].n_exact) == (3, 0)
    assert rows[2].text == "Titles\n\n \nmore" and (rows[2].n_lines, rows[2].n_exact, rows[2].n_near) == (4, 2, 0)
    assert rows[3].text == "" and (rows[3].n_lines, rows[3].n_exact) == (2, 2)
    assert rows[4].text == texts[3][1] and rows[4].n_lines == 0 and rows[5].text is None
