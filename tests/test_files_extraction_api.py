import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extraction
from tidemark.plans import api, search
from tidemark.session import read
from tidemark.sources import files


def test_selector():
    assert files.Selector("all").moves_checkpoints() and not files.Selector("range", since="2026-01").moves_checkpoints()
    for bad in ({"kind": "x"}, {"kind": "session"}, {"kind": "all", "since": "2026"}, {"kind": "new", "session": "s"}):
        with pytest.raises(ValueError):
            files.Selector(**bad)


def test_range_days_are_inclusive(spark):
    df = spark.createDataFrame([("2026-01-01T23:59:59Z",), ("2026-01-02T00:00:00Z",), ("bad",)], "ts string")
    assert files.Selector("range", since="2026-01-01", until="2026-01-01").where(df).count() == 1


def test_resume_and_moved(spark, sf):
    f, s = read(spark, sf, "source_files"), read(spark, sf, "sources")
    got = files.resume(f, s).groupBy("action").count().collect()
    assert {r["action"] for r in got} <= {"append", "rewrite", "new"} and sum(r["count"] for r in got) > 0
    for r in files.moved(f, s).collect():
        assert r["old_path"] != r["new_path"]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x" * 5000)
    r = files.fingerprints(spark, str(tmp_path / "*.jsonl")).first()
    import hashlib

    assert r["size"] == 5000 and r["sha"] == hashlib.sha256(b"x" * 4096).hexdigest()


def test_bind(spark):
    roots = spark.createDataFrame([("one", "/srv/x", "git@h.example:o/one.git"), ("two", "/srv/x/deep", "https://h.example/o/two"), ("win", "C:\\w", None)], "project string, root string, repo string")
    rows = [("a", "/srv/x/lib", None), ("b", "/srv/x/deep/y", None), ("c", "/srv/x-copy", None), ("d", "/else", "https://u@h.example/o/one.git/"), ("e", "C:\\w\\s", None), ("f", None, None)]
    got = {r["session_id"]: (r["project"], r["why"]) for r in files.bind(spark.createDataFrame(rows, "session_id string, cwd string, repo string"), roots).collect()}
    assert got == {"a": ("one", "folder"), "b": ("two", "folder"), "c": (None, "unresolved"), "d": ("one", "remote"), "e": ("win", "folder"), "f": (None, "unresolved")}


def test_replies():
    assert extraction.parse_reply('{"none": true}') == ([], None)
    assert extraction.parse_reply('```json\n[{"turn": 1}]\n```') == ([{"turn": 1}], None)
    assert extraction.parse_reply('{"turn": 1}\n{"turn": 2}') == ([{"turn": 1}, {"turn": 2}], None)
    for bad in ("", None, "no", '{"a": 1}', "3"):
        assert extraction.parse_reply(bad)[0] is None


def test_slices_are_read_once_and_failures_again(spark, sf):
    docs = read(spark, sf, "docs")
    s = extraction.slices(docs, 4000).cache()
    first = s.orderBy("first_id").first()
    assert first["shown"].startswith(f"[T{first['first_id']}] ")

    def reader(shown):
        return "oops" if "[T" + str(bad) + "]" in shown else json.dumps([{"turn": "T1", "outcome": "open"}])

    bad = first["first_id"]
    todo = extraction.undone(s, None, "m", "p")
    items, ledger, dead = extraction.split_outcome(extraction.read_slices(todo, reader))
    assert items.count() == ledger.count() == s.count() - 1 and dead.first()["fault"] == "not JSON"
    assert [r["first_id"] for r in extraction.undone(s, ledger, "m", "p").collect()] == [bad]
    assert extraction.undone(s, ledger, "m", "other").count() == s.count()


def test_score(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "slice int, turn int, outcome string")
    gold = spark.createDataFrame([(1, 1, "a"), (1, 3, "c")], "slice int, turn int, outcome string")
    got = {tuple(r) for r in extraction.score(found, gold, spark.createDataFrame([(2, "x")], "slice int, outcome string")).collect()}
    assert got == {(1, 1, 2, 0), (2, 0, 0, 1)}


def test_dispatch_and_lines(spark, sf):
    store = search.Store(read(spark, sf, "docs").filter(F.col("id") <= 300).cache(), now_ms=1_790_000_000_000)
    got = api.execute(store, "find", {"query": "ledger", "limit": 2, "kinds": ["turn"], "since": "2025"})
    assert "#" in api.render(got) or got["rows"] == []
    for op, args in (("nope", {}), ("find", {"id": 1}), ("read", {}), ("find", {"on": "2026", "since": "2025"})):
        with pytest.raises(ValueError):
            api.execute(store, op, args)
    lines = [json.dumps({"jsonrpc": "2.0", "id": k, "method": m, "params": p}) for k, (m, p) in enumerate([("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "inventory", "arguments": {"what": "projects"}}), ("tools/call", {"name": "x"}), ("odd", {})])]
    out = [json.loads(x) for x in api.serve(store, [*lines, "junk", ""])]
    assert [("error" in x) for x in out] == [False, False, False, True, True, True] and out[4]["error"]["code"] == -32601
