import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import decisions, inventory, lifecycle, relations, semantic
from tidemark.sources.snapshots import Snapshots


@pytest.fixture
def make(spark):
    def rows(*dicts):
        names = [x.strip().split(" ")[0] for x in schema.DOCS.split(",")]
        return spark.createDataFrame([tuple(({"status": "active", "kind": "turn", "project": "p"} | d).get(n) for n in names) for d in dicts], schema.DOCS)

    return rows


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def test_insert_once(make):
    old = make({"id": 1, "sha": "a", "path": "x"})
    fresh, again = lifecycle.insert_once(old, make({"id": 2, "sha": "a", "path": "y"}, {"id": 3, "sha": "b", "path": "y"}, {"id": 4, "sha": "b", "path": "z"}, {"id": 5, "sha": "b", "path": "y"}))
    assert [r["id"] for r in fresh.collect()] == [3]
    assert {tuple(r) for r in again.select("doc_id", "path").collect()} == {(1, "y"), (3, "z")}


def test_supersede_strike_reactivate(spark, make):
    d = make({"id": 1, "path": "x", "body": "b"}, {"id": 2, "path": "y", "status": "struck"})
    gone = lifecycle.supersede_path(d, "x")
    assert by_id(gone)[1]["status"] == "superseded"
    back = lifecycle.reactivate(gone, spark.createDataFrame([(1,), (2,)], "id bigint"))
    assert by_id(back)[1]["status"] == "active" and by_id(back)[2]["status"] == "struck"  # struck stays struck
    hit = lifecycle.strike(d, 1, "2026-01-01", "wrong")
    assert by_id(hit)[1]["body"] == "b\nstruck 2026-01-01: wrong"
    assert by_id(lifecycle.unstrike(hit, 1))[1] == by_id(d)[1]


def test_merge_note(make):
    d = make({"id": 1, "path": "n", "kind": "memory", "title": "A", "sha": "a1"}, {"id": 2, "path": "n", "kind": "memory", "title": "B", "sha": "b1"})
    out = by_id(lifecycle.merge_note(d, make({"id": 3, "path": "n", "kind": "memory", "title": "A", "sha": "a2"}, {"id": 4, "path": "n", "kind": "memory", "title": "B", "sha": "b1"}), "n"))
    assert {k: (v["status"], v["superseded_by"]) for k, v in out.items()} == {1: ("superseded", 3), 2: ("active", None), 3: ("active", None)}


def test_dedupe_statements(make):
    s = {"kind": "statement", "session_id": "s", "outcome": "approved", "evidence_ids": "[3, 9]"}
    d = make(s | {"id": 1, "quote": "do  it"}, s | {"id": 2, "quote": "do it"}, s | {"id": 3, "quote": "do it", "outcome": "rejected"}, s | {"id": 4, "quote": ""}, s | {"id": 5, "quote": " "}, s | {"id": 6, "quote": "do it", "evidence_ids": None})
    out = lifecycle.dedupe_statements(d)
    assert {k: v["superseded_by"] for k, v in by_id(out).items()} == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert by_id(lifecycle.dedupe_statements(out)) == by_id(out)


def test_nominate(make):
    s = {"kind": "statement", "who": "owner"}
    d = make(
        s | {"id": 1, "ts": "1", "outcome": "completed", "title": "blue ledger page", "session_id": "a"}, s | {"id": 2, "ts": "2", "outcome": "rejected", "title": "blue ledger", "session_id": "b"},
        s | {"id": 3, "ts": "3", "outcome": "approved", "title": "blue ledger", "session_id": "b"}, s | {"id": 5, "ts": "5", "outcome": "superseded", "title": "red cache", "session_id": "c"},
        s | {"id": 6, "ts": "6", "outcome": "approved", "title": "red cache", "session_id": "c", "who": "claude"}, s | {"id": 7, "ts": "7", "outcome": "approved", "title": "red cache", "session_id": "d"},
    )
    assert {(r["old_id"], r["new_id"]) for r in relations.nominate(d).collect()} == {(1, 2), (5, 6)}


def test_nominate_in_blocks(spark, make, monkeypatch):
    """Titles of one template: the result is that of all pairs, over several blocks, and what is shuffled grows with the statements, not with the pairs."""
    import random

    r = random.Random(5)
    outcomes, whos, sessions = ["approved", "proposed", "completed", "rejected", "standing", "superseded", "open", None], ["owner", "owner", "codex", None], ["a", "b", "c", None]
    rows = [
        {"id": i, "kind": "statement", "who": r.choice(whos), "outcome": r.choice(outcomes), "session_id": r.choice(sessions), "ts": r.choice([None, *(f"{x:03}" for x in range(200))]),
         "title": r.choice(["nothing explains why {} rows were {} twice", "please keep {} or {}"]).format(*(f"w{r.randrange(40)}x" for _ in range(2)))}
        for i in range(1500)
    ]
    from tidemark.functions.text import OVERLAP_STOP

    words = [{w for w in d["title"].split() if len(w) >= 3 and w not in OVERLAP_STOP} for d in rows]
    want = set()
    for n, nw in zip(rows, words):
        met = []
        for o, ow in zip(rows, words):
            same = o["session_id"] == n["session_id"]
            labelled = o["outcome"] == "superseded" and same
            overturn = n["who"] == "owner" and o["outcome"] in relations.OVERTURNS.get(n["outcome"], ())
            score = len(nw & ow) / min(len(nw), len(ow))
            if n["outcome"] not in ("superseded", None) and None not in (o["ts"], n["ts"]) and o["ts"] < n["ts"] and (labelled or overturn) and score >= 0.3 and (labelled or n["outcome"] != "approved" or not same):
                met.append((-score, o["id"]))
        want |= {(o, n["id"], -s) for s, o in sorted(met)[:3]}
    docs = make(*rows)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    written = lambda: sum(x.shuffleWriteRecords() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())))
    before = written()
    assert {tuple(x) for x in relations.nominate(docs).collect()} == want
    assert written() - before < 20 * len(rows)
    for name in ("NEWER", "OLDER"):
        monkeypatch.setattr(relations, name, 60, raising=False)
    assert {tuple(x) for x in relations.nominate(docs).collect()} == want


def test_snapshots_publish_whole_versions(spark, make, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.read() is None and s.publish(make({"id": 1})) == 1
    bad = make({"id": 2}).withColumn("id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception):
        s.publish(bad)
    assert s.version() == 1 and s.publish(make({"id": 1}, {"id": 2})) == 2 and s.read().count() == 2 and s.read(1).count() == 1


def test_validate_statements(spark, make):
    t = {"session_id": "s"}
    d = make(t | {"id": 1, "ts": "1", "role": "user", "body": "Please keep the old layout for the report"}, t | {"id": 2, "ts": "2", "role": "assistant", "source_client": "codex", "body": "I will keep the old layout"}, t | {"id": 3, "ts": "3", "role": "user", "body": "Yes. Is it done?"})
    items = [
        (1, "T1", "approved", "keep it", "keep the old layout", None, None), (2, "T2", "approved", "keep it", "keep the old layout", None, None), (3, "T2", "completed", "keep it", "keep the old layout", "null?", None),
        (4, "T9", "open", "x", "y", None, None), (5, "T3", "open", "x", "Is it done?", None, None), (6, "1", "standing", "x", "never seen", None, None), (7, "1", "odd", "x", "keep", None, None), (8, "1", "approved", "", "keep", None, None), (9, "1", "approved", "x", "keep", None, "bob"),
    ]
    got = {r["item"]: r for r in decisions.validate(spark.createDataFrame(items, "item int, turn string, outcome string, statement string, quote string, reason string, who string"), d).collect()}
    assert {k: v["reject_reason"] for k, v in got.items()} == {1: None, 2: "not the owner's", 3: None, 4: "turn not there", 5: "a question is not open work", 6: "quote not in turn", 7: "outcome", 8: "no statement", 9: "speaker"}
    assert got[3]["evidence"] == [1, 2] and got[1]["evidence"] == [1] and got[3]["who"] == "codex"
    items = spark.createDataFrame([(1, "T3", "approved", "the layout", "Yes", None, None), (2, "T3", "approved", "the layout", "Is it done", None, None), (3, "T1", "standing", "the layout", "keep the old layout", None, None)], "item int, turn string, outcome string, statement string, quote string, reason string, who string")
    got = {r["item"]: (r["reject_reason"], r["evidence"], r["certainty"]) for r in decisions.validate_decisions(items, d).collect()}
    assert got == {1: (None, [2, 3], "clear"), 2: ("part of a question", [2, 3], "clear"), 3: (None, [1], "unclear")}


def test_link_pending(spark):
    h = 3_600_000
    p = spark.createDataFrame([(1, "p", 100 * h, "go ahead"), (2, "p", 200 * h, "yes"), (3, "p", 300 * h, "never said")], "id bigint, project string, ms bigint, quote string")
    t = spark.createDataFrame([(10, "p", 90 * h, "Go  ahead now"), (11, "p", 70 * h, "go ahead"), (12, "q", 99 * h, "go ahead"), (13, "p", 199 * h, "Yes!"), (14, "p", 198 * h, "yes, that"), (15, "p", 299 * h, "yesterday")], "id bigint, project string, ms bigint, body string")
    assert {r["id"]: (r["turn_id"], r["state"]) for r in decisions.link_pending(p, t).collect()} == {1: (10, "linked"), 2: (None, "ambiguous"), 3: (None, "waiting")}


def test_relation(spark):
    S = "old_id bigint, old_outcome string, old_status string, old_ts string, new_outcome string, new_ts string, new_quote string, turn_body string, certainty string"
    rows = [(7, "approved", "active", "1", "rejected", "2", "use red", "Replace decision #7 with: use red", "clear"), (7, "approved", "active", "1", "rejected", "2", "use red", "use red", "clear"), (7, "standing", "active", "1", "approved", "2", "x", "Replace decision #7 with: x", "clear"), (7, "approved", "active", "2", "rejected", "1", "x", "Replace decision #7 with: x", "clear")]
    assert [r["relation"] for r in decisions.relation(spark.createDataFrame(rows, S)).collect()] == ["replaces", "conflict", "conflict", "conflict"]


def test_index_goes_on_where_it_stopped(spark, make):
    d = make({"id": 1, "sha": "a", "title": "t", "body": "t one"}, {"id": 2, "sha": "b", "title": "u", "body": "x " * 2000})
    enc = semantic.hashing_encoder(8)
    full = semantic.build_index(d, None, enc, "m")
    assert {(r["id"], r["total"]) for r in full.collect()} == {(1, 1), (2, 3)}
    part = full.filter("id = 1 or ordinal = 0")
    assert {r["id"] for r in semantic.build_index(d, part, enc, "m").collect()} == {2}
    assert semantic.build_index(d, full, enc, "m").count() == 0 and semantic.build_index(d, full, enc, "m2").count() == 4


def test_revision_ignores_order_and_sees_change(make):
    a = inventory.revision(make({"id": 1}, {"id": 2})).first()[0]
    assert a == inventory.revision(make({"id": 2}, {"id": 1})).first()[0] != inventory.revision(make({"id": 1}, {"id": 3})).first()[0]


def test_small_relations(spark, make):
    from tidemark.operators import filters

    t = {"role": "user", "body": "x"}
    d = make(t | {"id": 1, "session_id": "a", "ts": "2026-01-10T00:00:00Z", "path": "p"}, t | {"id": 2, "session_id": "b", "ts": "2026-01-09T00:00:00Z", "path": "q", "sha": "k"}, t | {"id": 3, "ts": "2026-01-09T00:00:00Z"}, t | {"id": 4, "session_id": "c", "ts": "2025-01-09T00:00:00Z"})
    ledger = spark.createDataFrame([("a",)], "session_id string")
    now = 1_768_089_600_000  # 2026-01-11
    assert [r["id"] for r in relations.recent_unread(d, ledger, now).collect()] == [2]
    assert {r["id"] for r in relations.without_sessions(d, ledger).collect()} == {2, 4}
    src = spark.createDataFrame([("p", "1"), ("z", "2"), ("y", "3")], "path string, sha string")
    assert {r["path"] for r in relations.attributed_sources(src, d, spark.createDataFrame([("2",)], "sha string")).collect()} == {"p", "z"}
    import hashlib

    q = make({"id": 9, "sha": hashlib.sha256(b"k|question").hexdigest()})
    assert [tuple(r) for r in relations.questions_of(d.filter("id = 2"), q).collect()] == [(2, 9)]
    chunks = relations.packed_chunks(make(*[t | {"id": i, "session_id": "s", "ts": str(i)} for i in range(1, 8)]), 75)
    docs = make(*[t | {"id": i, "session_id": "s", "ts": str(i)} for i in range(1, 8)])
    assert {r["chunk"]: r["context"] for r in relations.context_before_chunks(docs, chunks, 2).collect()} == {0: [], 1: [2, 3], 2: [5, 6]}
    shown = make({"id": 1, "status": "unverified", "body": "x\nPENDING: not found yet"}).select(filters.shown_body().alias("b")).first()["b"]
    assert shown.startswith("x\nUNVERIFIED")
    s = make({"id": 1, "body": "a " * 100 + "needle " + "b " * 200}).select(filters.snippet(F.col("body"), ["NEEDLE"]).alias("s")).first()["s"]
    assert s.startswith("…") and "needle" in s and s.endswith("…") and len(s) == 202


def test_pending_decisions_are_linked_by_words_context_and_session(spark):
    from tidemark.operators import decisions

    at, minute = 1_780_000_000_000, 60_000
    p = [
        (1, "p", at, "go", "codex", None, None, None), (2, "p", at, "make the   Header blue", "codex", None, None, None), (3, "p", at, "keep seven rows of the old ledger", "codex", None, None, None),
        (4, "p", at, "yes do it", "codex", None, None, None), (5, "p", at, "yes do it", "codex", None, "blue door", None), (6, "p", at, "yes do it", "codex", "s2", None, None),
        (7, "p", at, "never said", "codex", None, None, None), (8, "p", at, "never said", "claude", None, None, None), (9, "p", at, "", "codex", None, None, None),
    ]
    pending = spark.createDataFrame(p, "id int, project string, ms bigint, quote string, client string, session_id string, context string, status string")
    t = [
        (10, "s1", 1, "assistant", "shall I paint the blue door?"), (11, "s1", 2, "user", "Google said so. Go!"), (12, "s1", 3, "user", "Please make the header\nBLUE today"), (13, "s1", 4, "user", "keep at least seven of the rows of the old big ledger"),
        (14, "s1", 5, "user", "Yes, do it: yes do it"), (20, "s2", 1, "assistant", "and the red one?"), (21, "s2", 2, "user", "yes do it"), (22, "s2", 900, "user", "later"),
    ]
    spoken = spark.createDataFrame([(i, s, f"{k:06d}", r, b, "p", at + (k - 60) * minute, "codex") for i, s, k, r, b in t], "id int, session_id string, ts string, role string, body string, project string, ms bigint, client string")
    got = {r["id"]: (r["turn_id"], r["context_id"], r["state"]) for r in decisions.link_pending(pending, spoken.filter("role = 'user'"), spoken).collect()}
    assert got[1] == (11, 10, "linked") and got[2] == (12, 10, "linked")
    assert got[4] == (None, None, "ambiguous") and got[5] == (14, 10, "linked") and got[6] == (21, 20, "linked")
    assert got[7] == (None, None, "unverified") and got[8] == (None, None, "waiting") and got[9][0] is None
    assert decisions.link_pending(pending.limit(0), spoken, spoken).count() == 0


def test_questions_rules_and_topics(spark):
    from tidemark.operators import decisions
    from tidemark.plans import search

    rows = [("Should we  drop\nthe cache?", "drop the CACHE", True), ("Drop the cache. Ok?", "drop the cache", False), ("use config.toml here?", "use config", True), ("a (b) c?", "(b)", True), ("x", "", False), ("x?", "y", False)]
    df = spark.createDataFrame(rows, "body string, quote string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", decisions.ends_as_question(F.col("body"), F.col("quote"))).collect())
    topics = {"We discussed something similar before about the ledger?": "the ledger", "catch me up on parsers": "parsers", "resumed work": "resumed work", "Why did we keep it?": "keep it"}
    assert {k: search.request_topic(k) for k in topics} == topics


def test_dedupe_keeps_case_and_leaves_rows_without_a_session(spark):
    rows = [(1, "s", "Keep it", "[5]"), (2, "s", "keep it", "[5]"), (3, "s", "Keep  it", "[5]"), (4, None, "Keep it", "[5]"), (5, None, "Keep it", "[5]"), (6, "s", "", "[5]"), (7, "s", "", "[5]")]
    docs = spark.createDataFrame([(i, "statement", "active", s, "open", q, e, None) for i, s, q, e in rows], "id int, kind string, status string, session_id string, outcome string, quote string, evidence_ids string, superseded_by int")
    got = {r["id"]: (r["status"], r["superseded_by"]) for r in lifecycle.dedupe_statements(docs).collect()}
    assert got[1] == ("superseded", 3) and all(got[i] == ("active", None) for i in (2, 3, 4, 5, 6, 7))


def test_rows_without_a_key_are_kept_and_places_of_many_ranges(spark):
    from tidemark.operators import semantic

    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, sha string")
    assert sorted(r["id"] for r in lifecycle.first_of_each(df, "sha").collect()) == [1, 2, 4]
    many = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = semantic.placed_all(many, "v", "id").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1000)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)
