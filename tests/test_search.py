import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import Scope, resolve_session
from tidemark.operators.semantic import hashing_encoder
from tidemark.plans import search
from tidemark.session import read


@pytest.fixture(scope="module")
def store(spark, sf):
    docs = read(spark, sf, "docs").cache()
    return search.Store(docs, now_ms=1_790_000_000_000)


@pytest.mark.parametrize("order", ["relevance", "newest"])
def test_pages_are_the_whole(store, order):
    scope = Scope(kinds=["statement"], order=order, include_superseded=True)
    ids, cursor = [], None
    while True:
        got = search.find(store, "", scope=scope, limit=7, cursor=cursor)
        ids += [r["id"] for r in got["rows"]]
        cursor = got["next"]
        if not cursor:
            break
    want = search.matches(store, "", "any", scope).count()
    assert len(ids) == len(set(ids)) == want == got["counts"]["records"]


def test_cursor_is_refused_after_a_change(spark, store):
    cursor = search.find(store, "ledger", limit=1)["next"]
    other = search.Store(store.docs.withColumn("title", F.lit("x")))
    for s, c in ((other, cursor), (store, "junk")):
        with pytest.raises(ValueError):
            search.find(s, cursor=c)


def test_order_never_changes_the_matches(store):
    a, b = (search.matches(store, "ledger parser", "any", Scope(order=o)).filter("ms is not null") for o in ("relevance", "oldest"))
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def test_exact_modes_hold_with_meaning(spark, store):
    enc = hashing_encoder(16)
    rows = [(r["id"], r["project"], enc([(r["body"] or "")[:500]])[0]) for r in store.docs.filter("kind = 'statement'").collect()]
    chunks = spark.createDataFrame([(p, i, 0, 0, 10, v) for i, p, v in rows], "project string, doc_id bigint, ordinal bigint, start_offset bigint, end_offset bigint, vec array<float>")
    both = search.Store(store.docs, chunks, enc, least=0.1)
    words = {r["id"] for r in search.matches(store, "the rows", "all", Scope(kinds=["statement"])).collect()}
    assert {r["id"] for r in search.matches(both, "the rows", "all", Scope(kinds=["statement"])).collect()} == words
    assert {r["id"] for r in search.matches(both, "the rows", "any", Scope(kinds=["statement"])).collect()} >= words


def test_bad_requests(store):
    for bad in ({"kinds": ["x"]}, {"outcomes": ["x"]}, {"who": "x"}, {"order": "x"}, {"direct": True, "tools": True}):
        with pytest.raises(ValueError):
            Scope(**bad)
    with pytest.raises(ValueError):
        search.find(store, limit=0)
    with pytest.raises(ValueError):
        resolve_session(store.docs, "0")
    with pytest.raises(ValueError):
        search.read(store, -1)


def test_read_is_lossless(store):
    r = store.docs.orderBy(F.desc(F.length("body"))).first()
    out, at = "", 0
    while at is not None:
        got = search.read(store, r["id"], at, 1000)
        out, at = out + got["text"], got["next_offset"]
    assert out.endswith(r["body"])


def test_recall(store):
    got = search.recall(store, "Why did we reject the ledger schema last week?")
    assert got["intent"] == "rationale" and got["interpretation"].startswith("last week")
    got = search.recall(store, "What did we decide about the ledger?", limit=3)
    assert got["evidence_status"] in ("ready", "partial") and sum(r["seed"] for r in got["records"]) <= 3
    assert search.recall(store, "show me the standing rules")["counts"].keys() == {"rules"}
    assert search.recall(store, "qqqzzz vvvxxx")["evidence_status"] == "no_matches"
    for bad in ("", "x" * 4001):
        with pytest.raises(ValueError):
            search.recall(store, bad)


def test_recall_reads_the_texts_once(spark, sf):
    """Three lanes share one count of the words and one look at the scope; each lane used to read all rows several times."""
    docs = read(spark, sf, "docs")
    scala, tracker = spark._jvm.scala.jdk.javaapi.CollectionConverters, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    rows_read = lambda: sum(x.inputRecords() for x in scala.asJava(tracker.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())))
    n, before = docs.count(), rows_read()
    got = search.recall(search.Store(docs), "What did we decide about the ledger schema?")
    assert got["records"] and rows_read() - before < 9 * n
    order = [r["id"] for r in got["records"]]
    assert order == [r["id"] for r in search.recall(search.Store(docs.repartition(3, "title")), "What did we decide about the ledger schema?")["records"]]


def test_lanes_are_those_of_find(store):
    """What a lane of recall counts is what a search of its scope finds, whatever else the scope asks for."""
    for base in (Scope(), Scope(outcomes=["approved", "standing"]), Scope(include_superseded=True, who="owner", client="codex")):
        for request, words in (("What did we decide about the ledger schema?", "ledger schema"), ("continue what we were doing", "")):
            got = search.recall(store, request, base)["counts"]
            for lane, kinds in (("decisions", ["statement"]), ("summaries", ["handoff", "compact_summary", "memory"]), ("history", ["turn"])):
                order = "relevance" if words else "newest"
                scope = Scope(client=base.client, who=base.who, outcomes=base.outcomes, include_superseded=base.include_superseded, tools=base.tools, kinds=kinds, order=order)
                assert got[lane] == search.matches(store, words, "any", scope).count(), (base, request, lane)


def test_neighbours_of_a_long_session(spark):
    """A session's turns are walked once a side: no frame reaches to the session's end, which costs the square of its turns."""
    from tidemark import schema
    from tidemark.operators import relations

    names = [x.strip().split(" ")[0] for x in schema.DOCS.split(",")]
    made = [{"id": i, "kind": "turn", "status": "active", "session_id": None if i % 2 else "s", "ts": None if i % 7 == 0 else f"{i * 37 % 1000:04}", "body": "(tool-only turn: x" if i % 5 == 0 else "b"} for i in range(1500)]
    docs = spark.createDataFrame([tuple(d.get(n) for n in names) for d in made], schema.DOCS)
    got = relations.neighbours_of(docs.filter("id % 10 in (0, 5)"), docs)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    key = lambda d: (d["ts"] is not None, d["ts"] or "", d["id"])
    for r in got.collect():
        me = made[r["id"]]
        others = sorted(key(d) for d in made if d["session_id"] == me["session_id"] and not d["body"].startswith("("))
        before, after = [k[2] for k in others if k < key(me)], [k[2] for k in others if k > key(me)]
        assert (r["previous"], r["next"]) == (before[-1] if before else None, after[0] if after else None)
