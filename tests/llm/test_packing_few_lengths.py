"""Packing of histograms with few distinct lengths, none of which fill a sequence exactly."""

from __future__ import annotations

from loomspark.llm import packing


def test_configurations_with_room_are_used():
    hist = {700: 1200, 650: 1200}
    plan = packing.solve(hist, 2048)
    used: dict = {}
    for content, n in plan:
        assert sum(size * k for size, k in content) <= 2048
        for size, k in content:
            used[size] = used.get(size, 0) + k * n
    assert used == hist
    # Best-fit decreasing takes 1,000; 600 of (700, 650, 650) and 300 of (700, 700) are enough.
    assert sum(n for _, n in packing.best_fit(hist, 2048)) == 1000 and sum(n for _, n in plan) <= 910
