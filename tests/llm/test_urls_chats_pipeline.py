from __future__ import annotations

import json
import random
import re

from helpers import ODD, documents, words
from loomspark.llm import chats, registry, urls

# ------------------------------------------------------------------ URL filters


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in urls.SITES if (host == (h := r.rule.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.rule.split("/", 1)[1])]
    if fits:
        best = max(fits, key=lambda r: len(r.rule))
        return host, path, best.rule, best.action
    low = (url or "").lower()
    hit = lambda action: any(re.search(r.regex.replace("\\-", "-"), low) for r in urls.PATTERNS if r.action == action)
    return host, path, None, "block" if hit("block") and not hit("allow") else "allow"


def test_urls_equal_a_plain_version(spark):
    r = random.Random(1)
    hosts = ["example.com", "WWW.example.com", "a.example.com", "notexample.com", "com", "x.net", "net", "ads.org", "spam-farm.org", "cheap-pills.example.org", "adserver.x.org", "b.org:80", ""]
    paths = ["", "/", "/en/", "/en/a?b", "/en", "/es/1#t", "/fr/", "/ads/1", "/about/ads/2", "/casino", "/casino/x", "/casinos", "/popup?x", "/help/popup", "/xxx/", "?replytocom=3", "/a-poker-b"]
    rows = [(i, f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(hosts)}{r.choice(paths)}") for i in range(1500)]
    rows += [(8999, "http://a.example.com/en/" + "x" * 200_000), (8998, "http://x.net/" + "casino/" * 30_000)]
    rows += [(9000, None), (9001, ""), (9002, "no scheme"), (9003, "a://b://com/"), (9004, "http://x.com\n/en/"), (9004, "http://x.com\n/en/"), (None, "http://com/")]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string")
    got = urls.judge(df)
    assert "Python" not in got._jdf.queryExecution().toString()
    got = got.collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == plain_verdict(x.url), x
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_are_kept_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a.example.com/en/",)] * 3 + [("http://b.com/en/",)], "url string")
    from pyspark.sql import functions as F

    tokens = F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), 0)
    index = {r.rule: r.token for r in urls.index_of(df.withColumn("t", tokens), urls.SITES, [urls.PatternRule("block", "banner")], "t").collect()}
    assert index["example.com/en/"] == "example" and index["com/"] == "com" and index["banner"] == ""


# ------------------------------------------------------------------ chats


def test_tool_calls(spark):
    call = lambda *calls: json.dumps({"tool_calls": list(calls)})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "assistant", call({"id": "b", "name": "search", "arguments": {"query": "$call:a", "limit": 3}}, {"id": "a", "name": "search", "arguments": '{"query": "é", "limit": 2}'})),
        (1, 1, "tool", result("a", "found")),
        (1, 2, "tool", result("a", "again")),
        (1, 3, "assistant", call({"id": "c", "name": "search", "arguments": {"query": "", "limit": 500, "x": 1}}, {"id": "d", "name": "nothing", "arguments": {}}, {"name": "search", "arguments": {"query": "q"}})),
        (1, 4, "assistant", call({"id": "e", "name": "search", "arguments": {"query": "$call:f"}}, {"id": "f", "name": "search", "arguments": {"query": "$call:e"}})),
        (1, 5, "assistant", call({"id": "g", "name": "search", "arguments": {"query": "$call:h"}}, {"id": "a", "name": "search", "arguments": {"query": "z"}})),
        (1, 6, "assistant", call({"id": "h", "name": "search", "arguments": {"query": "$call:a"}})),
        (1, 7, "tool", result("zz", {"k": 1})),
        (2, 0, "tool", result("a", "other conversation")),
        (3, 0, "assistant", "{broken"), (3, 1, "user", None), (3, 2, None, ""), (None, 0, "user", "hi"), (3, None, "user", "hi"),
    ]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, rank int")
    got = chats.link(df, plain=False).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.status != "duplicate"}
    assert (by[1, "a"].status, by[1, "a"].rank, by[1, "a"].result_turn) == ("linked", 0, 1)
    assert (by[1, "b"].status, by[1, "b"].rank) == ("unanswered", 1)
    assert by[1, "a"].message == '{"arguments":{"limit":2,"query":"é"},"id":"a","name":"search","result":"found"}'
    assert by[1, "c"].status == "invalid" and by[1, "c"].problem == "$.limit: out of bounds; $.query: length; $.x: unknown"
    assert by[1, "d"].problem == "unknown tool" and by[1, None].status == "unidentified"
    assert by[1, "e"].status == by[1, "f"].status == "circular" and by[1, "g"].status == "forward" and by[1, "h"].status == "unanswered"
    assert by[1, "zz"].status == by[2, "a"].status == "orphan" and '"result":"{\\"k\\":1}"' in by[1, "zz"].message
    assert sum(r.status == "duplicate" for r in got) == 2
    assert chats.link(df.limit(0)).count() == 0


def plain_links(rows, schemas):
    """Status and result by identifier, from lists and dictionaries alone."""
    calls, results, lost = {}, {}, 0
    order = sorted((x for x in rows if x[3] is not None), key=lambda x: (x[0], x[1]))
    for conv, turn, role, text in order:
        data = json.loads(text)
        for k, c in enumerate(data.get("tool_calls", []) if role == "assistant" else []):
            if c.get("id") is None:
                lost += 1
            else:
                calls.setdefault((conv, c["id"]), []).append((turn, k, c))
        if role == "tool":
            results.setdefault((conv, data["tool_call_id"]), []).append((turn, data["content"]))
    message = {}  # (conversation, turn) -> first place of each identifier, and what each call refers to
    for conv, turn, role, text in order:
        if role == "assistant":
            listed = json.loads(text)["tool_calls"]
            at = {c["id"]: k for k, c in reversed(list(enumerate(listed))) if c.get("id") is not None}
            needs = [{at[v[6:]] for v in c["arguments"].values() if isinstance(v, str) and v.startswith("$call:") and v[6:] in at} for c in listed]
            rank, done = {}, []
            while True:
                ready = [k for k in range(len(listed)) if k not in done and needs[k] <= set(done)]
                if not ready:
                    break
                for k in ready:
                    rank[k] = len(done)
                    done.append(k)
            message[conv, turn] = rank
    out = {}
    for key in calls.keys() | results.keys():
        (turn, k, c) = min(calls[key], key=lambda x: x[:2]) if key in calls else (None, None, None)
        answer = min(results[key]) if key in results else None
        if c is None:
            out[key] = ("orphan", answer[0])
            continue
        rank = message[key[0], turn].get(k)
        forward = False
        for v in c["arguments"].values():
            if isinstance(v, str) and v.startswith("$call:"):
                to = calls.get((key[0], v[6:]))
                there = min(to, key=lambda x: x[:2]) if to else None
                before = there and (there[0] < turn or there[0] == turn and rank is not None and message[key[0], turn].get(there[1]) is not None and message[key[0], turn][there[1]] < rank)
                forward = forward or not before
        bad = bool(chats.problems(c["arguments"], schemas[c["name"]])) if c["name"] in schemas else True
        status = "circular" if rank is None else "forward" if forward else "invalid" if bad else "unanswered" if answer is None else "early" if answer[0] <= turn else "linked"
        out[key] = (status, answer and answer[0])
    return out, lost, sum(len(v) - 1 for v in [*calls.values(), *results.values()])


def test_links_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(6):
            ids = [f"c{r.randint(0, 5)}" for _ in range(3)]
            if r.random() < 0.6:
                value = lambda: r.choice(["q", "", f"$call:c{r.randint(0, 6)}", f"$call:{r.choice(ids)}"])
                listed = [{"id": r.choice([*ids, None]), "name": r.choice(["search", "search", "nothing"]), "arguments": {"query": value(), "limit": r.choice([1, 5, 500])}} for _ in range(r.randint(1, 4))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": listed})))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{r.randint(0, 6)}", "content": f"r{turn}"})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chats.link(df, plain=False).collect()
    want, lost, copies = plain_links(rows, chats.SCHEMAS)
    assert {(x.conv_id, x.call_id): (x.status, x.result_turn) for x in got if x.status not in ("duplicate", "unidentified")} == want
    assert sum(x.status == "unidentified" for x in got) == lost and sum(x.status == "duplicate" for x in got) == copies
    assert len({s for s, _ in want.values()}) == 7 and all(json.loads(x.message)["id"] == x.call_id for x in got)


def test_messages_that_are_hard_to_read(spark):
    call = lambda i, a: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": a}]})
    deep = '{"tool_calls": [{"id": "d", "name": "search", "arguments": ' + "[" * 1500 + "]" * 1500 + "}]}"
    long = "q" * 300_000
    rows = [
        (1, 0, "assistant", call("s", {"query": "\ud800 half"})), (1, 1, "tool", '{"tool_call_id": "s", "content": "\\udfff"}'), (1, 2, "assistant", deep),
        (1, 3, "assistant", '{"tool_calls": [{"id": "n", "name": "search", "arguments": {"query": "q", "limit": NaN}}]}'), (1, 4, "assistant", '{"tool_calls": [{"id": "i", "name": "search", "arguments": {"query": "q", "limit": 1e999}}]}'),
        (1, 5, "assistant", call("t", '{"query": Infinity}')), (1, 6, "assistant", call("l", {"query": long})), (1, 7, "tool", json.dumps({"tool_call_id": "l", "content": long})),
        *[(2, 0, "assistant", call("r", {"query": "q"}))] * 3, *[(2, 1, "tool", json.dumps({"tool_call_id": "r", "content": "x"}))] * 2, *[(2, 2, "assistant", call(None, {}))] * 2,
    ]
    got = chats.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), plain=False).collect()
    by = {(x.conv_id, x.call_id): x for x in got if x.status != "duplicate"}
    assert sorted(k[1] for k in by if k[0] == 1) == ["l", "s", "t"]
    assert by[1, "s"].status == "linked" and json.loads(by[1, "s"].message)["result"] == "\\udfff" and "\\ud800 half" in by[1, "s"].message
    assert by[1, "t"].status == "invalid" and by[1, "l"].status == "linked" and len(by[1, "l"].message) > 600_000
    assert by[2, "r"].status == "linked" and sum(x.status == "duplicate" and x.name == "search" for x in got) == 2 and sum(x.status == "duplicate" and x.name is None for x in got) == 1
    assert sum(x.status == "unidentified" for x in got) == 2


def test_plain_dialogues(spark):
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (2, 1, "assistant", "alone"), (2, 2, "system", "x")]
    got = {r.call_id: r for r in chats.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"1:0": "linked", "1:2": "unanswered", "2:0": "orphan"}
    assert json.loads(got["1:0"].message) == {"arguments": {"text": 'say "hi"\n'}, "id": "1:0", "name": "reply", "result": "hi"}


def test_schema_checks():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": ["integer", "null"], "minimum": 0}}, "b": {"enum": ["x"]}}}
    assert chats.problems({"a": [1, None, 2.0]}, s) == []
    assert chats.problems({"a": [-1, True, "t"], "b": "y"}, s) == ["$.a[0]: out of bounds", "$.a[1]: not of type ['integer', 'null']", "$.a[2]: not of type ['integer', 'null']", "$.b: not an allowed value"]
    assert chats.problems([], s) == ["$: not of type object"] and chats.problems({}, s) == ["$.a: missing"]


# ------------------------------------------------------------------ pipeline


def test_pipeline_against_its_stages_done_plainly(spark, tmp_path):
    import corpus_pipeline
    from loomspark.llm import packing, personal

    line = "this is a line that several documents share word by word"
    body = lambda s: " ".join(words(200, s))
    texts = [(20 + i, f"{body(i)}\n{line}\nmail me: {'uvwxyz'[i] * 6}@mail.example.com") for i in range(6)]
    near = body(0).split()
    near[5] = "changed"
    texts += [(40, " ".join(near) + "\nmail me: uuuuuu@mail.example.com"), (41, "too short"), (42, texts[1][1]), (43, " ".join(words(30_000, 99))), *ODD]
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20 + i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in seen[name] if r.text is not None and name != "quality rules")
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("quality rules") == [20, 21, 22, 23, 24, 25, 40, 42, 43]
    kept = {r.doc_id: r.text for r in seen["line dedup"]}
    assert kept[20].count(line) == 1 and all(kept[20 + i].count(line) == 0 for i in range(1, 6)) and 42 not in kept
    assert ids("near dedup") == [20, 21, 22, 23, 24, 25, 43]
    assert all("<EMAIL>" in r.text and "@" not in r.text for r in seen["personal data"] if r.doc_id != 43)
    tokenizer = packing.word_tokenizer()
    lengths = {r.doc_id: len(tokenizer.encode(r.text)) // 4 + 1 for r in seen["personal data"]}
    packed: dict = {}
    for r in seen["packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == lengths and lengths[43] > 30_000
    assert personal.redact_text(None) is None
    run = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == ids("packing")


def test_registry_names_each_operator_once():
    names = [n.split("_")[0] for n in registry.QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
