"""Media columns: 8-bit WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

UNIT = 64


@dataclass(frozen=True)
class MediaRules:
    """One channel of 8-bit samples. A peak is paired with those up to ``fan_out`` frames ahead in time."""

    rate: int = 8000
    frame: int = 256
    hop: int = 128
    bands: tuple[int, ...] = (1, 8, 16, 32, 64, 129)
    fan_out: int = 3
    block: int = 4096


def to_payload(text: str | None) -> bytes:
    """UTF-8 of the text, null as empty, padded with zero bytes to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_wav(payload: bytes, rules: MediaRules = MediaRules()) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rules.rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a one-channel 8-bit file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.getframerate(), w.readframes(w.getnframes())


def peaks(samples: bytes, rules: MediaRules = MediaRules()) -> np.ndarray:
    """The strongest bin of each frequency band in each frame: an array of frames by bands.

    Frames are transformed in blocks, so memory does not grow with the recording. The last frame is
    filled up with silence, so frames cover the whole recording. Magnitudes are rounded before they are compared, so ties go to the lower bin.
    """
    x = np.frombuffer(samples, dtype=np.uint8)
    n = 1 + max(0, -(-(len(x) - rules.frame) // rules.hop))
    missing = rules.frame + (n - 1) * rules.hop - len(x)
    if missing > 0:
        x = np.concatenate([x, np.full(missing, 128, dtype=np.uint8)])
    window = np.hanning(rules.frame).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(x, rules.frame)[:: rules.hop]
    out = np.empty((n, len(rules.bands) - 1), dtype=np.int64)
    for start in range(0, n, rules.block):
        part = (views[start : start + rules.block].astype(np.float32) - 128) * window
        power = np.round(np.abs(np.fft.rfft(part, axis=1)), 2)
        for b, (low, high) in enumerate(zip(rules.bands, rules.bands[1:])):
            out[start : start + rules.block, b] = low + np.argmax(power[:, low:high], axis=1)
    return out


def fingerprint(samples: bytes, rules: MediaRules = MediaRules()) -> np.ndarray:
    """Time-coded peak pairs as unsigned 64-bit numbers: frame (32 bits), then first bin, second bin and distance in frames."""
    p = peaks(samples, rules).astype(np.uint64)
    n = len(p)
    frames = np.arange(n, dtype=np.uint64)[:, None] << np.uint64(32)
    codes = [frames[:, [0]].repeat(p.shape[1], 1)[: max(0, n - d)] | p[: n - d] << np.uint64(20) | np.roll(p, -1, axis=1)[d:] << np.uint64(8) | np.uint64(d) for d in range(1, rules.fan_out + 1) if n > d]
    if not codes:
        codes = [frames | p << np.uint64(20)]
    return np.sort(np.concatenate([c.reshape(-1) for c in codes]))


def media_table(docs: DataFrame, keep: list[str], text: str = "text", rules: MediaRules = MediaRules(), with_media: bool = True) -> DataFrame:
    """Media columns of whole texts: sizes, checksums, the stored file and its fingerprint array on demand.

    ``media binary`` is the stored WAV file and ``fingerprint array<long>`` its time-coded peak pairs; without
    ``with_media`` only their checksums are kept. Null and empty texts give 64 zero bytes; very long texts are one
    recording, transformed in blocks; equal texts, repeated rows among them, have equal values; peaks that tie go to the
    lower bin. An empty table gives an empty result, and kept columns named like a result give way. The payload's values
    are those of the bytes read back from the stored file.
    """

    def fn(columns):
        for t in columns[0]:
            payload = to_payload(t)
            media = write_wav(payload, rules)
            _, back = read_wav(media)
            prints = fingerprint(back, rules)
            yield (
                len((t or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
                f"{len(prints)}:{hashlib.sha256(prints.astype('<u8').tobytes()).hexdigest()}", media if with_media else None, prints.astype(np.int64).tolist() if with_media else None,
            )

    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, fingerprint array<long>"
    made = map_rows(docs, [text], fn, out, keep=keep)
    return made if with_media else made.drop("media", "fingerprint")

