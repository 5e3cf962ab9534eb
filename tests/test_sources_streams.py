import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import jsonl, markdown, transcripts
from tidemark.streaming import ingest


def test_lines_and_offsets(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"a":1}\r\n\n  \n{"b":"\xc3\xa9"}\n' + b"x" * 100 + b"\nunfinished")
    got = list(jsonl.read_lines(str(p), 0, p.stat().st_size, 0, 50))
    assert [(g[1], g[3][:12], g[4]) for g in got] == [(0, '{"a":1}', False), (13, '{"b":"é"}', False), (24, "x" * 12, True)]
    whole = list(jsonl.read_lines(str(p), 0, p.stat().st_size, 0))
    for size in (1, 3, 7, 20):
        cut = [x for s in range(0, p.stat().st_size, size) for x in jsonl.read_lines(str(p), s, min(s + size, p.stat().st_size), 0)]
        assert cut == whole
    assert jsonl.complete_end(str(p), p.stat().st_size) == whole[-1][2]


def test_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(jsonl.JsonlSource)
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.jsonl").write_text('{"k":1}\n{"k":2}\n{"k":')
    (d / "sub" / "b.jsonl").write_text('{"k":3}\n')
    (d / "c.txt").write_text("no\n")
    assert sorted(r["text"] for r in spark.read.format("jsonl_offsets").option("split_bytes", "5").load(str(d)).collect()) == ['{"k":1}', '{"k":2}', '{"k":3}']
    table, state = str(tmp_path / "t"), str(tmp_path / "s")

    def run(adapter=lambda x: x.select("path", "src_offset", "text", F.sha2("text", 256).alias("sha"))):
        ingest.ingest(spark.readStream.format("jsonl_offsets").load(str(d)), adapter, table, state)
        return sorted(r["text"] for r in ingest.earlier(spark, table).collect())

    assert run() == ['{"k":1}', '{"k":2}', '{"k":3}']
    with (d / "a.jsonl").open("a") as f:
        f.write('4}\n{"k":1}\n')

    def crash(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        run(crash)
    assert run() == ['{"k":1}', '{"k":2}', '{"k":3}', '{"k":4}']  # the unfinished line once finished, the repeated one not again
    assert run() == ['{"k":1}', '{"k":2}', '{"k":3}', '{"k":4}']


def test_first_dialect(spark):
    rec = lambda **x: json.dumps({"sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "uuid": "u"} | x)
    msg = lambda c: {"role": "user", "content": c}
    lines = [
        rec(type="user", message=msg("hello  sk-" + "a" * 20)), rec(type="assistant", message=msg([{"type": "text", "text": "one"}, {"type": "text", "text": "two"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a/b.py"}}])),
        rec(type="assistant", message=msg([{"type": "tool_use", "name": "Bash", "input": {"command": "cat src/x.rs"}}])), rec(type="assistant", message=msg([{"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}])),
        rec(type="user", message=msg([{"type": "tool_result", "content": "x"}])), rec(type="user", isSidechain=True, message=msg("side")), rec(type="user", isCompactSummary=True, message=msg("sum")), rec(type="system", message=msg("no")), "cut {",
    ]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, src_offset bigint, text string")
    got = {r["src_offset"]: r for r in transcripts.first_dialect(df, "proj").collect()}
    assert {k: (r["kind"], r["origin"], r["body"], r["files_json"], r["tools_json"]) for k, r in got.items()} == {
        0: ("turn", "direct", "hello  [scrubbed]", "[]", "[]"), 1: ("turn", "direct", "one\ntwo", '["a/b.py"]', '["Edit"]'), 2: ("turn", "tool", "(tool-only turn: Bash) src/x.rs", '["src/x.rs"]', '["Bash"]'), 6: ("compact_summary", "summary", "sum", "[]", "[]"),
    }


def test_second_dialect(spark):
    r = lambda n, t, p, ts="2026-01-01T00:00:00Z": ("f", n, n, ts, t, json.dumps(p))
    m = lambda role, *content, **x: {"type": "message", "role": role, "content": list(content)} | x
    i = lambda s: {"type": "input_text", "text": s}
    o = lambda s: {"type": "output_text", "text": s}
    reply = '<send_user_message_question_reply>[{"question": "Which?", "answer": "Red"}]</send_user_message_question_reply>'
    rows = [
        r(0, "session_meta", {"id": "th", "session_id": "se", "history_base": {"end_ordinal_exclusive": 2}, "forked_from_id": "old"}), r(1, "response_item", m("user", i("inherited"))),
        r(2, "response_item", m("user", i("<env_context>x</env_context> do it"), {"type": "input_image"}, {"type": "input_image"}, id="a")), r(3, "response_item", m("assistant", o("done"), phase="final_answer", id="b")),
        r(4, "response_item", m("assistant", o("hm"), phase="odd")), r(5, "response_item", m("developer", i("no"))), r(6, "response_item", m("user", i(reply), id="c")), r(7, "response_item", m("user", i("<env_context>x</env_context>"))),
        r(8, "event_msg", {"type": "item_completed", "item": {"type": "FileChange", "id": "e", "changes": {"a.py": {"type": "add"}}}}), r(9, "response_item", m("user", i("<b>mine</b> fix")), "not a time"), r(10, "response_item", m("user", i("# Files mentioned by the user:\n## a\n## My request:\nfix it"))),
        r(11, "response_item", m("user", i("<div>x</div> fix this"))),
    ]
    df = spark.createDataFrame(rows, "path string, src_offset bigint, ordinal bigint, timestamp string, type string, payload string")
    got = sorted((x["ordinal"], x["session_id"], x["role"], x["origin"], x["body"]) for x in transcripts.second_dialect(df, "p").collect())
    assert got == [
        (1, "codex:old", "user", "reference", "inherited"), (2, "codex:th", "user", "direct", "do it\n[image]"), (3, "codex:th", "assistant", "direct", "done"), (4, "codex:th", "assistant", "reference", "hm"),
        (6, "codex:th", "assistant", "reference", "Which?"), (6, "codex:th", "user", "direct", "Red"), (8, "codex:th", "assistant", "tool", "(tool-only turn: apply_patch) a.py"), (10, "codex:th", "user", "direct", "fix it"), (11, "codex:th", "user", "direct", "<div>x</div> fix this"),
    ]


def test_markdown(spark):
    note = "---\r\nname: n\r\ntype: feedback\r\n---\r\n# T\n\n## One\nbody\n\n## Empty\n\n## Two\nmore\n### deep\nx"
    df = spark.createDataFrame([("p", note)], "path string, content string")
    meta, rest = markdown.front_matter(F.col("content"))
    r = df.select(meta.alias("m"), rest.alias("r")).first()
    assert r["m"] == {"name": "n", "type": "feedback"} and r["r"].startswith("# T")
    assert [(x["title"], x["section"]) for x in markdown.sections(df, "memory").orderBy("place").collect()] == [("One", "body"), ("Two", "more\n### deep\nx")]
    assert [x["title"] for x in markdown.sections(df, "map_section").orderBy("place").collect()] == ["One", "Two", "deep"]
    log = spark.createDataFrame([("p", "**2026-01-02, First** text\n\n**2026-01-03: Second** x")], "path string, content string")
    assert [(x["title"], x["ts"]) for x in markdown.sections(log, "changelog").orderBy("place").collect()] == [("First", "2026-01-02T00:00:00.000Z"), ("Second", "2026-01-03T00:00:00.000Z")]
    plain = spark.createDataFrame([("p", None), ("q", "no front")], "path string, content string")
    assert markdown.sections(plain, "memory").count() == 0


def test_stream_windows_match_batch(spark, sf):
    ev = ingest.files(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = {(r["start"], r["event_type"]): r["n"] for r in ingest.drain(ingest.tumbling(ev, "at", "1 day", "1 hour", "event_type")).collect()}
    b = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("s"), "event_type").count().collect()
    want = {(r["s"], r["event_type"]): r["count"] for r in b}
    last = max(s for s, _ in want)
    assert got == {k: v for k, v in want.items() if k[0] < last}  # the last day is still open
