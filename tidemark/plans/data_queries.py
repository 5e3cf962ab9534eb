"""Queries of the general data problems (2, 5, 7) with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, merkle, timestamps
from tidemark.session import materialise, read


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "docs").select(F.lit("docs").alias("tab"), F.col("id").alias("rec_id"), "ts", "path", F.coalesce("src_offset", "id").alias("place"))
    rollout = read(spark, sf_dir, "codex_rollout").select(F.lit("codex_rollout").alias("tab"), "rec_id", F.col("timestamp").alias("ts"), "path", F.coalesce("src_offset", "rec_id").alias("place"))
    return docs.unionByName(rollout)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of records not yet in canonical form; those that rest on an estimated zone are left out.

    Canonical records leave after the zones are chosen: they are most of the known instants that a file's order rests on.
    """
    out = timestamps.normalise(_stamped(spark, sf_dir), "ts", "path", "place", read(spark, sf_dir, "sources"))
    wanted = out.filter(~F.col("ts").rlike(timestamps.CANONICAL) & F.expr("utc_ms is not null and zone_from <> 'estimate'"))
    return wanted.select("tab", "rec_id", "utc_ms").distinct()


def p7_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of every file that has zone-less times: recorded or estimated, with the violations of order and storing time that remain."""
    rows = _stamped(spark, sf_dir).select(F.col("path").alias("_t_path"), F.col("place").cast("bigint").alias("_t_order"), "ts")
    rows = materialise(timestamps.parse(rows, "ts").drop("ts"), "parsed")
    zones = materialise(timestamps.file_zones(read(spark, sf_dir, "sources")), "file-zones")
    return timestamps.choose_zones(rows, zones).select(
        F.col("_t_path").alias("path"), F.col("_t_zone").alias("zone"), "zone_from", F.col("violations").cast("bigint"), F.col("zoneless"), "readings"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: drift.departures(read(s, d, "codex_rollout"), read(s, d, "payload_schema")),
        "p2_ingest": lambda s, d: drift.ingest(read(s, d, "codex_rollout"), read(s, d, "payload_schema")),
        "p5_found": lambda s, d: merkle.pending_files(read(s, d, "source_files"), read(s, d, "sources")).select("path", "from_offset"),
        "p7_found": p7_found,
        "p7_zones": p7_zones,
    }


P2_FOUND = """
with r as (
  select path, type, payload, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as p from codex_rollout),
k as (
  select path, coalesce(type, '') || case when json_type(p, '$.type') = 'VARCHAR' then '|' || json_extract_string(p, '$.type') else '' end as kind, p,
         row_number() over () as rn from r where p is not null),
n as (select path, kind, count(*) as total from k group by all),
e as (select path, kind, rn, unnest(json_keys(p)) as field, p from k),
t as (
  select path, kind, field, rn,
         case json_type(json_extract(p, '$."' || field || '"')) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object'
              when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as jt from e),
f as (select path, kind, field, count(distinct rn) as occ, count(distinct jt) as kinds, min(jt) as jt, list(distinct jt) filter (jt is not null) as jts from t group by all),
known as (select n.* from n where kind in (select kind from payload_schema)),
unl as (select f.*, known.total from f join known using (path, kind) where not exists (select 1 from payload_schema s where s.kind = f.kind and s.field = f.field)),
gone as (
  select known.path, known.kind, s.field, s.json_type from known join payload_schema s using (kind)
  where s.required and not exists (select 1 from f where f.path = known.path and f.kind = known.kind and f.field = s.field)),
cand as (select * from unl where occ = total and kinds = 1)
select path, kind, '*' as field, 'kind_added' as change from n where kind not in (select kind from payload_schema)
union all
select f.path, f.kind, f.field, 'retyped' from f join payload_schema s on s.kind = f.kind and s.field = f.field
where len(list_filter(f.jts, lambda x: x <> s.json_type)) > 0
union all
select g.path, g.kind, g.field, case when exists (select 1 from cand c where c.path = g.path and c.kind = g.kind and c.jt = g.json_type) then 'renamed' else 'removed' end from gone g
union all
select u.path, u.kind, u.field, 'added' from unl u
where not (u.occ = u.total and u.kinds = 1 and exists (select 1 from gone g where g.path = u.path and g.kind = u.kind and g.json_type = u.jt))
"""

P5_FOUND = """
with l as (
  select path, size, sha, regexp_extract(path, '[^/\\\\]*$') as base from source_files
  qualify row_number() over (partition by path order by listed_at desc, size desc, sha desc) = 1),
c as (
  select path, sha, ingested_at, regexp_extract(path, '[^/\\\\]*$') as base,
         case when json_extract_string(state, '$.run') is not null and json_extract_string(state, '$.run') <> 'ok'
              then coalesce(try_cast(json_extract_string(state, '$.committed') as bigint), 0) else "offset" end as durable from sources),
m as (
  select * from c where path not in (select path from l)
  qualify row_number() over (partition by base order by ingested_at desc, path desc) = 1),
j as (
  select l.path, l.size, l.sha, case when c.path is not null then c.sha else m.sha end as csha, case when c.path is not null then c.durable else m.durable end as durable
  from l left join c on c.path = l.path left join m on m.base = l.base)
select path, (case when durable is null or csha is distinct from sha or size < durable then 0 else durable end)::bigint as from_offset
from j where (case when durable is null or csha is distinct from sha or size < durable then 0 else durable end) < size
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p5_found": P5_FOUND}
