"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, leakage, neighbours, packing, pii, spans, splitting
from tidemark.session import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: conversations.defects(read(s, d, "docs"), read(s, d, "sources")),
        "p1_conversations": lambda s, d: conversations.conversations(read(s, d, "docs"), read(s, d, "sources")),
        "p3_found": lambda s, d: splitting.audit(read(s, d, "chunks"), read(s, d, "docs")),
        "p3_pieces": lambda s, d: splitting.split(read(s, d, "docs"), "id", "body"),
        "p4_found": lambda s, d: pii.items(read(s, d, "docs"), read(s, d, "people")),
        "p4_redacted": lambda s, d: pii.redact(read(s, d, "docs"), "id", ["body", "quote"], read(s, d, "people")),
        "p6_found": lambda s, d: neighbours.found(read(s, d, "chunks"), read(s, d, "vectors")),
        "p6_nearest": p6_nearest,
        "p8_containers": lambda s, d: packing.containers(read(s, d, "documents")),
        "p9_found": lambda s, d: leakage.find(read(s, d, "documents"), read(s, d, "eval_items")).select("item_id", "doc_id"),
        "p9_leaks": lambda s, d: leakage.find(read(s, d, "documents"), read(s, d, "eval_items"), similarity=0.8),
        "p10_found": p10_found,
        "p10_spans": lambda s, d: spans.spans_of_all(read(s, d, "documents")),
        "p10_shared": lambda s, d: spans.shared_extent(read(s, d, "documents")),
    }


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose doc_id is divisible by 100, against all rows."""
    rows = neighbours.tables(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "vectors"))
    doc = F.when(F.col("grp").startswith("chunks|"), F.floor(F.col("key") / 1000)).otherwise(F.col("key"))
    return neighbours.nearest(rows, doc % 100 == 0).withColumn("cos", F.round("cos", 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, copies = spans.shared_pairs(read(spark, sf_dir, "documents"))
    return spans.expand_copies(pairs, copies)


P3_FOUND = """
with c as (
  select c.*, d.body, coalesce(length(d.body), 0) as n, p.end_offset as pe,
         max(c.ordinal) over (partition by c.doc_id) as last,
         substring(d.body, (c.start_offset + 1500)::int, 549) as w,
         substring(d.body, (c.end_offset - 1)::int, 2) as tail
  from chunks c left join docs d on d.id = c.doc_id
  left join chunks p on p.project is not distinct from c.project and p.doc_id = c.doc_id and p.ordinal = c.ordinal - 1),
l as (
  select *, case when contains(w, chr(10) || chr(10)) then 1 when contains(substring(w, 2), chr(10)) then 2
                 when regexp_matches(substring(w, 2), '[ \\t]') then 3 else 4 end as best,
         case when tail = chr(10) || chr(10) then 1 when ends_with(tail, chr(10)) then 2
              when ends_with(tail, ' ') or ends_with(tail, chr(9)) then 3 else 4 end as own
  from c)
select distinct doc_id, ordinal from l
where coalesce(end_offset <= start_offset or end_offset - start_offset > 2048 or start_offset < 0 or end_offset > n
      or case when ordinal = 0 then start_offset <> 0 else pe is null or start_offset <> pe - 256 end
      or case when ordinal = last then end_offset <> n
         else best < 4 and (end_offset <= start_offset + 1500 or end_offset > start_offset + 2048 or own > best) end, true)
union
select id, -1::bigint from docs where length(body) > 2048 and id not in (select doc_id from chunks where doc_id is not null)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND}
