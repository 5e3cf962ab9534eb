import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions import vectors as V


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("use sk-" + "a1B2" * 6 + " now", "use [scrubbed] now"), ("ghp_" + "a" * 24, "[scrubbed]"), ("xoxb-" + "1" * 12, "[scrubbed]"), ("AKIA" + "A1" * 8, "[scrubbed]"), ("Bearer " + "x" * 20, "Bearer [scrubbed]"),
        ("my token is " + "f0" * 20, "my token is [scrubbed]"), ("API_KEY=abc\nB=1", "API_KEY=[scrubbed]\nB=1"), ("token sk-short", "token sk-short"), ("", ""),
    ],
)
def test_scrub(spark, raw, clean):
    assert one(spark, text.scrub(F.col("s")), s=raw) == clean


def test_tokens_fold_accents(spark):
    assert one(spark, text.tokens(F.col("s")), s="Crème BRÛLÉE café ß2, naïve_x") == ["creme", "brulee", "cafe", "ß2", "naive", "x"]


def test_phrase_and_glob(spark):
    assert not one(spark, text.contains_phrase(F.col("s"), "go"), s="google") and one(spark, text.contains_phrase(F.col("s"), "GO  on."), s="we go\n on. now")
    assert not one(spark, text.contains_phrase(F.col("s"), " "), s="x")
    for pattern, s, hit in (("a*c", "xxabbcxx", True), ("a?c", "abbc", False), (r"a\*c", "a*c", True), (r"a\*c", "abc", False), ("A.C", "abc", False)):
        assert one(spark, F.col("s").rlike(text.glob_regex(pattern)), s=s) is hit
    with pytest.raises(ValueError):
        text.glob_regex("a\\")


def test_fuzzy_span():
    body = "Well, keep the old layout, I think, for the report."
    assert text.fuzzy_span(body, "keep the old layout for the report") == "keep the old layout, I think, for the report"
    assert text.fuzzy_span(body, "old layout keep the report") is None and text.fuzzy_span(body, "the old layout") is None and text.fuzzy_span(None, "a b c d") is None


def test_overlap_and_intent(spark):
    a = text.topic_tokens(F.col("a"))
    assert one(spark, text.overlap(a, text.topic_tokens(F.col("b"))), a="Owner approved the blue ledger", b="the blue schema") == 0.5
    assert one(spark, text.overlap(a, text.topic_tokens(F.col("b"))), a="the", b="the blue") == 0.0
    for s, want in (("Why did we choose it?", "rationale"), ("show me the standing rules", "instruction"), ("continue", "continue"), ("what did we decide", "decision"), ("hello", "recollection")):
        assert one(spark, text.intent(F.col("s")), s=s) == want


def test_quote_key(spark):
    assert one(spark, text.quote_key(F.col("s")), s=" café  A ") == "café A"


def test_event_ms(spark):
    for s, ok in (("2026-01-01T10:00:00Z", True), ("2026-01-01T10:00:00.123+02:00", True), ("2026-01-01T10:00:00", False), ("2026-02-30T10:00:00Z", False), ("2026-01-01", False), ("x", False)):
        assert (one(spark, dates.event_ms(F.col("s")), s=s) is not None) is ok


def test_periods():
    h = 3_600_000
    a, b = dates.period("2026-03-08", "America/New_York")
    assert b - a == 23 * h
    a, b = dates.period("2026-11-01", "America/New_York")
    assert b - a == 25 * h
    assert dates.period("2026-12", "UTC")[1] == dates.period("2027", "UTC")[0]
    for bad in ("2026-02-30", "2026-13", "soon"):
        with pytest.raises(ValueError):
            dates.period(bad)
    with pytest.raises(ValueError):
        dates.date_range(since="2026-02", until="2026-01")
    with pytest.raises(ValueError):
        dates.date_range(on="2026", since="2025")
    lo, hi = dates.last_week("America/New_York", dates.period("2026-09-19", "America/New_York")[0])
    assert (lo, hi) == (dates.period("2026-09-07", "America/New_York")[0], dates.period("2026-09-14", "America/New_York")[0])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=6), st.lists(st.floats(-3, 3), min_size=1, max_size=6))
def test_cosine(spark, a, b):
    got = spark.range(1).select(V.cosine(V.literal(a), V.literal(b)).alias("x")).first()["x"]
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    if len(a) != len(b) or na * nb == 0:
        assert got is None
    else:
        assert got == pytest.approx(sum(x * y for x, y in zip(a, b)) / (na * nb), abs=1e-9)
