"""Operators that work text by text, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, documents, empty, words
from loomspark.llm import media, packing, personal, quality, sentencepieces

DOCS = ODD + [(100 + i, " ".join(words(60 + i, i))) for i in range(5)]


# ------------------------------------------------------------------ quality rules


def plain_stats(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    covered, at = set(), {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {j for i in places for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_stats_equal_a_plain_version():
    r = random.Random(1)
    texts = [t for _, t in DOCS] + ["".join(r.choice(["a ", "b ", "c\n", "#", "\x0b", "é ", "a b c d e f g h "]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert quality.document_stats(t) == plain_stats(t)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_verdicts(docs, clean, rules):
    """Verdicts by lists and dictionaries: ``docs`` and the labelled ``clean`` are (text, lang)."""
    import math

    def histograms(text, lang):
        classes = [0] * len(quality.CLASSES)
        for c in text or "":
            o = ord(c)
            kind = "latin" if 128 <= o < 0x800 else "wide" if 0x800 <= o < 0x10000 else "astral" if o >= 0x10000 else (
                "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "line" if c == "\n" else "space" if c.isspace()
                else "control" if not c.isprintable() else "stop" if c in ".!?" else "pause" if c in ",;:-" else "quote" if c in "'\"()" else "symbol"
            )
            classes[quality.CLASSES.index(kind)] += 1
        ws = [w if w in rules.words[lang] else w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] if lang in rules.words else []
        common = [ws.count(w) for w in rules.words.get(lang, [])]
        return classes, [*common, len(ws) - sum(common)]

    def distance(h, ref):
        p = [x / sum(h) for x in h]
        m = [(x + y) / 2 for x, y in zip(p, ref)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt(max(0.0, (kl(p) + kl(ref)) / 2))

    bad = lambda s: s[0] < rules.min_words or 100 * s[4] > rules.max_repeat_percent * s[0]
    ref = {}
    for lang in rules.words:
        hs = [histograms(t, lang) for t, g in clean if g == lang and not bad(plain_stats(t))]
        if hs:
            mean = lambda k: [float(np.mean([h[k][i] / sum(h[k]) for h in hs])) for i in range(len(hs[0][k]))]
            ref[lang] = len(hs) / (len(hs) + rules.trust_docs), mean(0), mean(1)
    out = []
    for t, g in docs:
        s, (classes, common) = plain_stats(t), histograms(t, g)
        trust, far, near = ref.get(g, (0, None, None))
        a = trust * distance(classes, far) if far and sum(classes) >= rules.min_chars_for_classes else None
        b = trust * distance(common, near) if near and s[0] >= rules.min_words_for_common else None
        out.append((a, b, not bad(s) and (a or 0) <= rules.max_class_distance and (b or 0) <= rules.max_common_distance))
    return out


def test_quality_equals_a_plain_version(spark):
    r = random.Random(8)
    prose = lambda g: " ".join(r.choice(quality.COMMON_WORDS[g]) if r.random() < 0.4 else "".join(r.choice("abcdefé") for _ in range(5)) + r.choice(["", "", ",", ".", "!!"]) for _ in range(r.randint(60, 250)))
    odd = lambda: " ".join("".join(r.choice("#$%AB12é中🙂") for _ in range(r.randint(1, 9))) for _ in range(150))
    texts = [(prose(g), g) for g in ("en", "de", "fr") for _ in range(25)] + [(odd(), r.choice(["en", "de", "es", None, "xx"])) for _ in range(30)] + [(t, "en") for _, t in ODD[1:-1]]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string")
    told = labels(spark, [(i, 1, 0) for i in [*range(20), *range(25, 40), 50]] + [(80, 0, 0), (None, 1, 0), (9999, 1, 0), (0, 1, 0)])
    clean = [texts[i] for i in [*range(20), *range(25, 40), 50]]
    rules = quality.QualityRules(max_class_distance=0.2, max_common_distance=0.2)
    rows = quality.judge(df, quality.references(df, told, rules), rules).orderBy("doc_id").collect()
    want = plain_verdicts(texts, clean, rules)
    assert len(rows) == len(texts) and 20 < sum(w[2] for w in want) < len(texts) - 10
    for row, (a, b, kept) in zip(rows, want):
        assert (row.class_distance is None) == (a is None) and (row.common_distance is None) == (b is None) and row.kept == kept
        assert abs((row.class_distance or 0) - (a or 0)) < 1e-9 and abs((row.common_distance or 0) - (b or 0)) < 1e-9


def test_quality_judges_junk_and_keeps_the_rest(spark):
    clean = [(i, " ".join(r if k % 4 else "the" for k, r in enumerate(words(150, i))) + ".") for i in range(200, 260)]
    junk = [(1000, "### $$$ ||| " * 80), (1001, "SHOUT!! LOUD!! " * 60), (1002, "few words")]
    df = documents(spark, clean + junk + ODD).withColumnRenamed("keys", "n_words").drop("lang")
    from pyspark.sql import functions as F

    df = df.withColumn("lang", F.lit("en"))
    reference = quality.references(df, labels(spark, [(i, 1, 0) for i in range(200, 240)]))
    rows = quality.judge(df, reference, quality.QualityRules(), keep=["doc_id", "n_words"]).collect()
    assert len(rows) == len(clean + junk + ODD) and reference.first().docs == 40
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i, _ in clean)
    assert not kept[1000] and not kept[1001] and not kept[1002] and not kept[7] and not kept[8]
    by = {r.doc_id: r for r in rows}
    assert by[1002].class_distance is None and by[200].class_distance is not None
    none = quality.references(empty(spark), labels(spark, []))
    assert none.count() == 0 and quality.judge(empty(spark), none).count() == 0
    # Without references, nothing but the base decides.
    assert {r.doc_id for r in quality.judge(documents(spark, clean[:3]), none).collect() if r.kept} == {200, 201, 202}
    # The number of labelled documents is bounded by the parameter.
    assert quality.references(df, labels(spark, [(i, 1, 0) for i in range(200, 240)]), quality.QualityRules(max_labelled=7)).first().docs == 7


def test_distance_is_the_jensen_shannon_distance(spark):
    df = spark.createDataFrame([([1, 3, 0], [0.5, 0.25, 0.25]), ([0, 0, 0], [0.5, 0.25, 0.25])], "h array<long>, r array<double>")
    got = [x[0] for x in df.select(quality.js_distance("h", "r")).collect()]
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert got[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2)) and got[1] is None


# ------------------------------------------------------------------ pieces


def test_encoding_equals_the_library():
    e = sentencepieces.encoder()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    parts = [" ", "  ", "    ", "a", "the", "tion", "\n", "é", "▁", "🙂", "中", "\x00", "<s>", "</s>", "<0x41>", "12", "."]
    texts = [t for _, t in DOCS] + ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [" " * n + "x" for n in range(40)]
    texts += ["".join(r.choice(e.pieces[259:]) for _ in range(5)) for _ in range(3000)]
    for t in texts:
        ids = e.encode(t)
        assert ids == lib.encode(t or "")
        assert e.decode(ids) == lib.decode(ids)


def test_encoding_over_a_table(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = documents(spark, DOCS).withColumnRenamed("keys", "ids")
    for row in sentencepieces.encoded(df, keep=["doc_id", "text"]).collect():
        ids = lib.encode(row.text or "", add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == lib.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sentencepieces.encoded(empty(spark), keep=["doc_id"]).count() == 0


def test_small_caches_change_nothing():
    small = sentencepieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"), cache_size=3)
    for _, t in DOCS[-5:]:
        assert small.encode(t) == sentencepieces.encoder().encode(t)


# ------------------------------------------------------------------ packing


def test_word_ids_equal_the_library():
    w = packing.word_tokenizer()
    r = random.Random(3)
    parts = [" ", "a", "'s", "'LL", "don't", "\n", "é", "É", "́", "🙂", "\x1c", " ", "Σ", "<|endoftext|>", "1", "23", "The", ".", "!!", "İ", "ﬁ"]
    texts = [t for _, t in DOCS] + ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(w.encode(t), "<u4").tolist() == w.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_and_few_sequences(seed):
    r = random.Random(seed)
    hist = {r.randint(1, 99): r.randint(1, 400) for _ in range(r.randint(1, 60))}
    plan = packing.solve(hist, 100)
    used: dict = {}
    for content, n in plan:
        assert sum(a * k for a, k in content) <= 100
        for a, k in content:
            used[a] = used.get(a, 0) + k * n
    assert used == hist
    assert sum(n for _, n in plan) <= 1.005 * sum(n for _, n in packing.best_fit(hist, 100)) + 1
    assert packing.solve({}, 100) == []


def test_packing_over_a_table(spark):
    tokenizer = packing.word_tokenizer()
    df = documents(spark, DOCS)
    rows = packing.pack(packing.pieces(df, capacity=64), capacity=64).collect()
    want = []
    for i, t in DOCS:
        ids = [*tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(np.array(ids[64 * k : 64 * k + 64], "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 4
    assert packing.pack(packing.pieces(empty(spark))).count() == 0


def test_ranks_go_on_across_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANK_GROUP", 5)
    rows = packing.pack(spark.range(500).selectExpr("id as doc_id", "0 as piece", "30L as length"), capacity=100).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500 and len({r.sequence_id for r in rows}) == 167


# ------------------------------------------------------------------ personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and personal.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_a_plain_version():
    r = random.Random(5)
    parts = ["a", "@", ".", "-", "+", "1", "23", "255", "256", " ", "x.y", "(", ")", "é", "4387513035237269", "000", "%"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert personal.base_spans(t) == plain_spans(t)


def test_long_runs_take_little_time():
    for t in ("1" * 400_000, "a" * 400_000, "1.1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        personal.scored_spans(t)


def test_added_spans_need_checksum_and_context():
    good, bad = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
    kinds = lambda t: [s[0] for s in personal.scored_spans(t)]
    assert "iban" in kinds(f"pay to {good} now") and "iban" not in kinds(f"pay to {bad} now")
    assert "ssn" in kinds("social security 123-45-6789") and "ssn" not in kinds("part 123-45-6789") and "ssn" not in kinds("social security 000-45-6789")


def test_personal_data_over_a_table(spark):
    texts = [(1, "write to a.b@mail.example.com or +1 (456) 555-2186"), (2, "card 4387513035237269 ip 10.0.0.1"), *ODD]
    df = documents(spark, texts).withColumnRenamed("keys", "pii")
    for r in personal.digest(personal.detect(df, keep=["doc_id", "text"]).withColumnRenamed("text", "t"), "doc_id").collect():
        if r.doc_id in (7, 8):
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == ""
    got = {r.doc_id: r for r in personal.digest(personal.detect(df, keep=["doc_id"])).collect()}
    told = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[0][1]))
    assert (got[1].n_email, got[1].n_phone, got[2].n_card, got[2].n_ip) == (1, 1, 1, 1) and got[1].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].spans == told
    masked = {r.doc_id: r for r in personal.redact(df).collect()}
    assert masked[1].text == "write to <EMAIL> or <PHONE>" and masked[7].text is None and masked[12].text == ODD[-1][1]
    assert personal.redact(empty(spark)).count() == 0 and masked[1].asDict().keys() == df.first().asDict().keys()


# ------------------------------------------------------------------ media


def test_media_round_trip(spark):
    rows = media.media_table(documents(spark, DOCS).withColumnRenamed("keys", "media"), keep=["doc_id", "text"]).collect()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        rate, back = media.read_wav(bytes(r.media))
        assert (rate, back) == (8000, payload) and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert len(r.fingerprint) == int(r.feature.split(":")[0])
    assert len({r.feature for r in rows if r.doc_id == 10}) == 1
    assert media.media_table(empty(spark), keep=["doc_id"]).count() == 0


def test_fingerprints_shift_with_time_and_ignore_blocks():
    rng = np.random.default_rng(0)
    sound = rng.integers(0, 256, 128 * 60, dtype=np.uint8).tobytes()
    late = bytes([128]) * 128 * 5 + sound
    strip = lambda x: {int(v) & 0xFFFFFFFF for v in x}
    assert len(strip(media.fingerprint(sound)) - strip(media.fingerprint(late))) == 0
    small = media.MediaRules(block=7)
    assert np.array_equal(media.fingerprint(sound, small), media.fingerprint(sound))
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * np.arange(1024) / 256)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:, 2] == 20).all()
