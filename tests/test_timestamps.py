import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timestamps as T


def ms(*a, off=0):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000) - off * 60_000


CASES = [
    ("2026-03-08T01:10:46.896771-05:00", ms(2026, 3, 8, 1, 10, 46, off=-300) + 896), ("2026-08-23T18:52:41,716Z", ms(2026, 8, 23, 18, 52, 41) + 716),
    ("2026-08-20T23:50:19.5+02:00", ms(2026, 8, 20, 21, 50, 19) + 500), ("2026/01/19 20:15:40 GMT", ms(2026, 1, 19, 20, 15, 40)), ("20250702T234638Z", ms(2025, 7, 2, 23, 46, 38)),
    ("Mon, 24 Nov 2025 03:12:57 -0500", ms(2025, 11, 24, 8, 12, 57)), ("Tue, 24 Nov 2025 03:12:57 -0500", None), ("Mon, 8 Sep 2025 04:59:50 GMT", ms(2025, 9, 8, 4, 59, 50)),
    ("Nov 2, 2025 12:15:36 AM EDT", ms(2025, 11, 2, 4, 15, 36)), ("Nov 2, 2025 12:15:36 PM EST", ms(2025, 11, 2, 17, 15, 36)), ("Nov 2, 2025 13:15:36 PM EST", None),
    ("2025-07-25 12:34:27-04", ms(2025, 7, 25, 16, 34, 27)), ("2026-07-06 04:25:27.155+0530", ms(2026, 7, 5, 22, 55, 27) + 155), ("1753213003", 1753213003000), ("1753213003.147", 1753213003147),
    ("1748747084207", 1748747084207), ("1749148899584187", 1749148899584), ("2025-09-20T23:01:27[Europe/Berlin]", ms(2025, 9, 20, 21, 1, 27)), ("2025-09-11 20:22:27 America/New_York", ms(2025, 9, 12, 0, 22, 27)),
    ("2025-11-02 01:19:35 America/Los_Angeles", None), ("2026-03-08 02:57:32 America/New_York", None), ("2026-17-19T20:35:11+00:00", None), ("2026-03-04T26:07:06.000Z", None), ("2026-02-29T10:00:00Z", None),
    ("2024-02-29T10:00:00Z", ms(2024, 2, 29, 10)), ("2026-10-16", None), ("23:57:30", None), ("", None), (" ", None), ("null", None), ("n/a", None), (None, None), ("2026-01-01 10:00:00 Mars/Phobos", None),
    ("2026-01-01T10:00:00z", ms(2026, 1, 1, 10)), ("2026-01-01T10:00:60Z", None),
]


def sources(spark, rows=()):
    return spark.createDataFrame(list(rows), "path string, state string, ingested_at string")


def test_notations(spark):
    df = spark.createDataFrame([(i, t, "p") for i, (t, _) in enumerate(CASES)], "id int, ts string, path string")
    got = {r["id"]: r["utc_ms"] for r in T.normalise(df, "ts", "path", "id", sources(spark)).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_every_hour_of_a_year_against_zoneinfo(spark):
    """Wall times in zones with changes: exactly those that the zone showed once have an instant."""
    rows, want = [], {}
    for zone in ("America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "Australia/Lord_Howe"):
        z = ZoneInfo(zone)
        t = dt.datetime(2026, 1, 1, 0, 20)
        while t.year == 2026:
            fits = {int((t - off).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) for off in {t.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1)}}
            fits = [m for m in fits if dt.datetime.fromtimestamp(m / 1000, z).replace(tzinfo=None) == t]
            want[f"{t:%Y-%m-%dT%H:%M:%S}", zone] = fits[0] if len(fits) == 1 else None
            rows.append((f"{t:%Y-%m-%dT%H:%M:%S}", zone))
            t += dt.timedelta(minutes=90)
    df = spark.createDataFrame(rows, "ts string, path string")
    src = sources(spark, [(z, f'{{"tz": "{z}"}}', None) for z in {z for _, z in rows}])
    got = {(r["ts"], r["path"]): r["utc_ms"] for r in T.normalise(df.withColumn("o", F.lit(1)), "ts", "path", "o", src).collect()}
    assert got == want


def test_estimate_uses_order_and_is_marked(spark):
    rows = [(0, "2026-01-10T12:00:00Z", "a"), (1, "2026-01-10T07:30:00", "a"), (2, "2026-01-10T13:00:00Z", "a"), (0, "2026-01-10T07:30:00", "b")]
    df = spark.createDataFrame(rows, "o int, ts string, path string")
    src = sources(spark, [("a", None, None), ("b", '{"run": "ok"}', None)])
    got = {(r["path"], r["o"]): (r["utc_ms"], r["zone_from"]) for r in T.normalise(df, "ts", "path", "o", src).collect()}
    assert got["a", 1] == (ms(2026, 1, 10, 12, 30), "estimate")  # New York alone lies between its neighbours
    assert got["b", 0] == (None, None)  # nothing ties it down


def test_estimate_over_many_blocks(spark):
    rows = [(i * 1000, f"2026-01-10T{12 + i // 6:02d}:{i % 6 * 10:02d}:00Z", "a") for i in range(30)] + [(5500, "2026-01-10T13:55:00", "a")]
    df = spark.createDataFrame(rows, "o int, ts string, path string")
    zones = T.file_zones(sources(spark, [("a", None, None)]))
    parsed = T.parse(df.select(F.col("path").alias("_t_path"), F.col("o").cast("bigint").alias("_t_order"), "ts"), "ts")
    for block in (100, 2500, 10**6):
        r = T.choose_zones(parsed, zones, T.CANDIDATES, block).collect()
        assert [(x["_t_zone"], x["violations"], x["readings"]) for x in r] == [("Europe/Berlin", 0, 1)]


def test_estimate_tries_every_history(spark):
    """A file from a zone that no record names; one that no zone fits; one whose clock showed a time twice."""
    rows = [(0, "2026-01-10T12:00:00Z", "t"), (1, "2026-01-10T21:10:00", "t"), (2, "2026-01-10T12:20:00Z", "t")]
    rows += [(0, "2026-01-10T12:00:00Z", "n"), (1, "2026-01-10T12:47:00", "n"), (2, "2026-01-10T12:01:00Z", "n")]
    rows += [(0, "2026-11-01T05:50:00Z", "y"), (1, "2026-11-01T01:55:00", "y"), (2, "2026-11-01T06:10:00Z", "y"), (3, "2026-11-01T01:12:00", "y"), (4, "2026-11-01T06:15:00Z", "y")]
    # Several zones fit, and give different instants.
    rows += [(k, t, "s") for k, t in enumerate(("2026-01-10T11:00:00Z", "2026-01-10T12:30:00", "2026-01-10T13:00:00Z", "2026-07-10T09:00:00Z", "2026-07-10T12:30:00", "2026-07-10T12:00:00Z"))]
    df = spark.createDataFrame(rows, "o int, ts string, path string")
    src = sources(spark, [(p, None, None) for p in "tnys"])
    got = {(r["path"], r["o"]): (r["utc_ms"], r["zone_from"]) for r in T.normalise(df, "ts", "path", "o", src).collect()}
    assert got["t", 1] == (ms(2026, 1, 10, 12, 10), "estimate")  # Tokyo
    assert got["n", 1] == (None, None) and got["y", 1] == (None, None) and got["s", 1] == (None, None)
    parsed = T.parse(df.select(F.col("path").alias("_t_path"), F.col("o").cast("bigint").alias("_t_order"), "ts"), "ts")
    est = {r["_t_path"]: r for r in T.choose_zones(parsed, T.file_zones(src)).collect()}
    assert est["t"]["_t_zone"] and est["t"]["violations"] == 0 and est["n"]["_t_zone"] is None and est["n"]["violations"] > 0
    few = {r["_t_path"]: r for r in T.choose_zones(parsed, T.file_zones(src), ["America/New_York"]).collect()}
    assert few["y"]["_t_zone"] == "America/New_York" and few["y"]["violations"] == 0
    assert len(T.histories()) > 300 and T.histories()[:7] == T.CANDIDATES


def test_a_recorded_zone_is_taken_and_its_violations_told(spark):
    rows = [(0, "2026-01-10T12:00:00Z", "a"), (1, "2026-01-10T13:10:00", "a"), (2, "2026-01-10T12:30:00Z", "a")]
    df = spark.createDataFrame(rows, "o int, ts string, path string")
    parsed = T.parse(df.select(F.col("path").alias("_t_path"), F.col("o").cast("bigint").alias("_t_order"), "ts"), "ts")
    for tz, violations in (("Europe/Berlin", 0), ("Asia/Kolkata", 1)):
        src = sources(spark, [("a", f'{{"tz": "{tz}"}}', None)])
        (r,) = T.choose_zones(parsed, T.file_zones(src)).collect()
        assert (r["_t_zone"], r["zone_from"], r["violations"], r["zoneless"]) == (tz, "file", violations, 1)
        assert {r["zone_from"] for r in T.normalise(df, "ts", "path", "o", src).collect()} == {"text", "file"}


def test_hidden_zones_are_recovered(spark):
    """Zones of files with zoned and zone-less times side by side are hidden and estimated: what is settled is right."""
    import random

    r, rows, truth = random.Random(5), [], {}
    names = ("America/New_York", "Asia/Tokyo", "Europe/Berlin", "America/Sao_Paulo", "Asia/Kathmandu", "Australia/Sydney", "Africa/Lagos", "Pacific/Auckland")
    for f in range(24):
        zone = truth[f"f{f}"] = names[f % len(names)]
        at = dt.datetime(2026, r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), tzinfo=dt.timezone.utc)
        for k in range(60):
            at += dt.timedelta(minutes=r.randint(1, 9))
            text = at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M:%S") if k % 3 == 1 else at.strftime("%Y-%m-%dT%H:%M:%SZ")
            rows.append((k, text, f"f{f}", int(at.timestamp() * 1000)))
    df = spark.createDataFrame(rows, "o int, ts string, path string, want bigint")
    src = sources(spark, [(p, None, None) for p in truth])
    got = T.normalise(df, "ts", "path", "o", src).filter("zone_from is null or zone_from = 'estimate'").collect()
    settled = [x for x in got if x["utc_ms"] is not None]
    assert len(settled) >= 0.9 * len(got) and all(x["utc_ms"] == x["want"] for x in settled)


@pytest.mark.parametrize("name", ["Factory", "BST", "IST", "localtime", "Nowhere/City"])
def test_names_that_are_no_zone(spark, name):
    df = spark.createDataFrame([(1, f"2026-01-10 12:00:00 {name}", "p")], "o int, ts string, path string")
    assert T.normalise(df, "ts", "path", "o", sources(spark)).first()["utc_ms"] is None


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([], "ts string, path string, o int")
    assert T.normalise(df, "ts", "path", "o", sources(spark)).count() == 0
    df = spark.createDataFrame([("2026-01-01T10:00:00Z", None, 1, 5, "x")] * 2, "ts string, path string, o int, utc_ms int, _t_ms string")
    assert [r["utc_ms"] for r in T.normalise(df, "ts", "path", "o", sources(spark)).collect()] == [ms(2026, 1, 1, 10)] * 2
    long = spark.createDataFrame([("9" * 100_000, "p", 1)], "ts string, path string, o int")
    assert T.normalise(long, "ts", "path", "o", sources(spark)).first()["utc_ms"] is None


@pytest.mark.parametrize("at", [0, 1786169669123, -86_400_001, 4102444800000])
def test_canonical(spark, at):
    got = spark.range(1).select(T.canonical(F.lit(at)).alias("x")).first()["x"]
    d = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=at)
    assert got == d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at % 1000:03d}Z"
