"""Fingerprints depend on a payload to its end."""

from __future__ import annotations

import numpy as np
import pytest
from loomspark.llm import media


@pytest.mark.parametrize("size", [320, 448, 4096 + 64])
def test_the_last_bytes_are_in_a_frame(size):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, size, dtype=np.uint8)
    y = x.copy()
    y[-64:] = rng.integers(0, 256, 64, dtype=np.uint8)
    assert not np.array_equal(media.fingerprint(x.tobytes()), media.fingerprint(y.tobytes()))


def test_frames_are_as_many_as_it_takes():
    assert [len(media.peaks(bytes(n))) for n in (0, 64, 256, 320, 384, 448, 512)] == [1, 1, 1, 2, 2, 3, 3]
