"""Queries of the general data problems on made tables."""

import datetime as dt

from tidemark.operators import timestamps
from tidemark.plans import data_queries


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_p7_found_chooses_zones_by_canonical_records_too(spark, tmp_path, monkeypatch):
    """Records in canonical form are no result of p7_found, yet the order of a file's times rests on them: both p7 queries make one choice."""
    docs = [(1, "2026-01-10T12:00:00.000Z", "open", 0), (2, "2026-01-10T07:30:00", "open", 10), (3, "2026-01-10T13:00:00.000Z", "open", 20)]
    docs += [(4, "2026-01-10T12:00:00.000Z", "told", 0), (5, "2026-01-10T13:10:00", "told", 10), (6, "2026-01-10T12:30:00.000Z", "told", 20)]
    docs += [(7, "2026-01-10T12:00:00Z", "told", None), (8, "2026-01-10T13:10:00", None, None), (9, None, "told", 30)]
    rollout = [(1, "2026-01-10T12:00:00.000Z", "against", 0), (2, "2026-01-10T13:10:00", "against", 10), (3, "2026-01-10T12:30:00.000Z", "against", 20)]
    src = [("open", None, None), ("told", '{"tz": "Europe/Berlin"}', None), ("against", '{"tz": "Europe/London"}', None)]
    spark.createDataFrame(docs, "id bigint, ts string, path string, src_offset bigint").write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame(rollout, "rec_id bigint, timestamp string, path string, src_offset bigint").write.parquet(f"{tmp_path}/codex_rollout.parquet")
    spark.createDataFrame(src, "path string, state string, ingested_at string").write.parquet(f"{tmp_path}/sources.parquet")

    choose, chosen = timestamps.choose_zones, []
    monkeypatch.setattr(timestamps, "choose_zones", lambda *a, **k: chosen.append(choose(*a, **k)) or chosen[-1])
    found = {tuple(r) for r in data_queries.p7_found(spark, str(tmp_path)).collect()}
    zones = {r["path"]: (r["zone_from"], r["violations"], r["readings"], r["zone"] is not None) for r in data_queries.p7_zones(spark, str(tmp_path)).collect()}
    by_found, by_zones = [sorted(map(tuple, c.collect())) for c in chosen]

    assert by_found == by_zones
    assert zones == {"open": ("estimate", 0, 1, True), "told": ("file", 0, 1, True), "against": ("file", 1, 1, True)}
    # Canonical texts, an estimated zone, no path and no text name nothing here; a recorded zone counts whatever its violations.
    assert found == {("docs", 5, ms(2026, 1, 10, 12, 10)), ("docs", 7, ms(2026, 1, 10, 12)), ("codex_rollout", 2, ms(2026, 1, 10, 13, 10))}
