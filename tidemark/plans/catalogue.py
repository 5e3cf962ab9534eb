"""Queries of the engine's own operators over the test tables, with the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import dates, text
from tidemark.functions import vectors as V
from tidemark.operators import filters, fulltext, inventory, lifecycle, relations, semantic
from tidemark.session import read, shared_dir

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


MS = r"""case when regexp_full_match(ts, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?(Z|[+-]\d{2}:\d{2})') then epoch_ms(try_cast(ts as timestamptz)) end"""
SPEAKER = "case when kind = 'turn' and role = 'user' then 'owner' when kind = 'turn' and role = 'assistant' then source_client else who end"
LIVE = "status = 'active' and superseded_by is null"
NOT_TOOL = "coalesce(origin, '') <> 'tool' and not starts_with(lower(body), '(tool-only turn:')"
SPOKEN = f"kind = 'turn' and {LIVE} and {NOT_TOOL}"
ELIGIBLE = f"{LIVE} and coalesce(origin, '') not in ('tool', 'reference') and not coalesce(starts_with(lower(body), '(tool-only turn:'), false)"
TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
LAST_EVIDENCE = "list_max(cast(json(evidence_ids) as bigint[]))"


# Scans, filters, projections


@query(f"select id, project, kind, {SPEAKER} as speaker, {MS} as event_ms, length(body) as chars from docs")
def docs_view(s, d):
    return read(s, d, "docs").select("id", "project", "kind", filters.speaker().alias("speaker"), dates.event_ms(F.col("ts")).alias("event_ms"), F.length("body").cast("bigint").alias("chars"))


@query(f"select id, ts from docs where {LIVE} and {NOT_TOOL} and kind in ('turn', 'statement') and source_client = 'codex'")
def filter_live_kind_client(s, d):
    return filters.Scope(kinds=["turn", "statement"], client="codex").where(read(s, d, "docs")).select("id", "ts")


@query(f"select id, {SPEAKER} as speaker from docs where {LIVE} and {NOT_TOOL} and {SPEAKER} in ('claude', 'codex')")
def filter_speaker(s, d):
    return filters.Scope(who="assistant").where(read(s, d, "docs")).select("id", filters.speaker().alias("speaker"))


@query(f"select id, ts from docs where {LIVE} and {NOT_TOOL} and ({MS}) >= 1764547200000 and ({MS}) < 1767225600000")
def filter_date_range(s, d):
    lo, hi = dates.period("2025-12", "UTC")
    return filters.Scope(lo=lo, hi=hi).where(read(s, d, "docs")).select("id", "ts")


@query(f"select id from docs where {LIVE} and kind = 'turn' and origin = 'direct' and role in ('user', 'assistant')")
def filter_direct(s, d):
    return filters.Scope(direct=True).where(read(s, d, "docs")).select("id")


@query(f"select id, outcome from docs where {LIVE} and {NOT_TOOL} and kind = 'statement' and outcome in ('standing', 'approved') and not (outcome = 'standing' and coalesce(origin, '') = 'decision-unclear')")
def filter_outcome_clear(s, d):
    return filters.Scope(outcomes=["standing", "approved"]).where(read(s, d, "docs")).select("id", "outcome")


@query(
    r"""select id from docs where coalesce(regexp_matches(replace(path, '\', '/'), '(?is)agents/.*halcyon'), false)
or len(list_filter(coalesce(try_cast(json(files_json) as varchar[]), []), lambda f: regexp_matches(replace(f, '\', '/'), '(?is)agents/.*halcyon'))) > 0"""
)
def filter_path_glob(s, d):
    return read(s, d, "docs").filter(filters.files_glob("agents/*halcyon")).select("id")


@query(f"select id, title, body from docs join (select id as k from docs where {LIVE} and ({MS}) is not null order by ({MS}) desc, id desc limit 50) on id = k")
def late_materialize_topk(s, d):
    docs = read(s, d, "docs")
    top = docs.filter(filters.live()).select("id", dates.event_ms(F.col("ts")).alias("ms")).filter("ms is not null").orderBy(F.desc("ms"), F.desc("id")).limit(50)
    return docs.select("id", "title", "body").join(F.broadcast(top.select("id")), "id")  # 50 rows


@query("select id, substring(body, 101, 200) as part, length(body) as total from docs where length(body) > 100")
def read_slice(s, d):
    return read(s, d, "docs").filter(F.length("body") > 100).select("id", F.substring("body", 101, 200).alias("part"), F.length("body").cast("bigint").alias("total"))


@query(f"select {SPEAKER} as speaker, count(*) as n from docs group by 1")
def project_speaker(s, d):
    return read(s, d, "docs").groupBy(filters.speaker().alias("speaker")).agg(F.count("*").alias("n"))


@query("select id, case when starts_with(coalesce(body, ''), coalesce(title, '')) then coalesce(body, '') else coalesce(title, '') || chr(10) || coalesce(body, '') end as t from docs")
def record_text(s, d):
    return read(s, d, "docs").select("id", semantic.record_text(F.col("title"), F.col("body")).alias("t"))


@query(
    f"""with st as (select id, project, {SPEAKER} as speaker, who, outcome, origin, source_client, path, superseded_by, unnest(case when len(coalesce(try_cast(json(evidence_ids) as bigint[]), [])) = 0 then [null] else list_distinct(cast(json(evidence_ids) as bigint[])) end) as ev from docs where kind = 'statement'),
j as (select st.id, st.speaker, st.who, st.outcome, st.origin, st.source_client, st.path, count(e.id) as evidence, max(r.id) as replacement
from st left join docs e on e.id = st.ev and e.project = st.project left join docs r on r.id = st.superseded_by and r.project = st.project group by all),
n as (select *, coalesce(origin = 'file', false) or (coalesce(origin, '') = '' and coalesce(source_client, '') = '' and coalesce(lower(path) like '%.md', false) and evidence = 0) as note from j)
select id, speaker, who is distinct from 'owner' and outcome is not distinct from 'completed' as reported_only, evidence, replacement, case when note then 'memory-note-excerpt' else 'recorded-conversation-quote' end as quote_kind,
case when note then 'imported memory-note summary; excerpt is not a verified owner quotation; no linked conversation evidence' else (case when coalesce(starts_with(path, 'decide:'), false) then 'recorded in session' else 'extracted later' end)
|| '; ' || (case when evidence > 0 then 'interpretation of linked conversation' else 'no linked conversation evidence available' end) end as authority from n"""
)
def decorate(s, d):
    return relations.presented(read(s, d, "docs"))


@query(
    """select id, case when kind in ('turn', 'compact_summary', 'statement') then coalesce(source_client, 'claude') else source_client end as source_client,
case when kind = 'compact_summary' then 'summary' when kind = 'statement' then null when kind <> 'turn' then 'file' when starts_with(lower(body), '(tool-only turn:') then 'tool' else 'direct' end as origin from docs"""
)
def migration_backfill(s, d):
    old = read(s, d, "docs").drop("native_session", "item_key", "turn_key", "ordinal", "segment", "src_offset", "origin", "adapter")
    return schema.migrate(old).select("id", "source_client", "origin")


# Aggregates


@query("select count(*) as records, count(*) filter (kind = 'turn') as messages, count(distinct case when session_id is not null then coalesce(source_client, '') || ':' || session_id end) as sessions, count(*) filter (kind = 'statement') as decisions from docs")
def count_units(s, d):
    return inventory.units(read(s, d, "docs"))


@query(f"select source_client, session_id, count(*) as records, min({MS}) as first_ms, max({MS}) as last_ms from docs where session_id is not null group by 1, 2")
def session_inventory(s, d):
    return inventory.sessions(read(s, d, "docs"))


@query(f"select source_client, kind, count(*) as records, min({MS}) as first_ms, max({MS}) as last_ms, count(*) filter (({MS}) is null) as undated from docs group by 1, 2")
def coverage_by_client_kind(s, d):
    return inventory.coverage(read(s, d, "docs"))


@query(f"select session_id, max(ts) as last_ts, count(*) as turns from docs where kind = 'turn' and {LIVE} and session_id is not null group by 1 order by 2 desc, 1 limit 20")
def recent_sessions(s, d):
    return inventory.recent_sessions(read(s, d, "docs"), 20)


@query("select distinct source_client from docs where kind = 'turn'")
def distinct_clients(s, d):
    return read(s, d, "docs").filter("kind = 'turn'").select("source_client").distinct()


@query(f"select id, {LAST_EVIDENCE} as last_evidence from docs where kind = 'statement'")
def max_evidence(s, d):
    return read(s, d, "docs").filter("kind = 'statement'").select("id", lifecycle.last_evidence().alias("last_evidence"))


@query(f"select count(*) as records, sum(length(body))::bigint as chars, sum(strlen(body))::bigint as bytes from docs where {ELIGIBLE}")
def dryrun_chunk_sizing(s, d):
    return inventory.sizing(read(s, d, "docs"))


@query(f"select project, count(*) as undated from docs where ({MS}) is null group by 1")
def invalid_timestamp_count(s, d):
    return read(s, d, "docs").filter(dates.event_ms(F.col("ts")).isNull()).groupBy("project").agg(F.count("*").alias("undated"))


@query("select event_type, count(*) as n, round(sum(value), 6) as total, count(*) filter (cast(props::json->>'k' as bigint) >= 50) as high from events group by 1")
def json_props(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_if(k >= 50).alias("high"))


@query()
def corpus_revision(s, d):
    return inventory.revision(read(s, d, "docs"))


@query(
    f"""with last as (select session_id from docs where kind = 'turn' and {LIVE} and session_id is not null group by 1 order by max(ts) desc, 1 limit 3),
f as (select min(json_extract_string(files_json, '$[0]')) as f from docs where json_array_length(files_json) > 0),
m as (select docs.*, coalesce(len(list_filter(from_json(coalesce(files_json, '[]'), '["varchar"]'), lambda x: ends_with(replace(x, chr(92), '/'), replace(f.f, chr(92), '/')))) > 0, false)
 or coalesce(length(regexp_extract(replace(f.f, chr(92), '/'), '[^/]*$')) > 5 and contains(concat_ws(' ', title, body), regexp_extract(replace(f.f, chr(92), '/'), '[^/]*$')), false) as touched from docs, f),
r as (select id, ts, who, outcome, title, ({MS}) as ms, touched from m where kind = 'statement' and {LIVE} and coalesce(outcome, '') <> 'standing' and session_id in (from last)
 union all select id, ts, 'handoff', 'note', title, ({MS}), touched from m where kind = 'handoff' and {LIVE}),
o as (select min({MS}) as t0 from docs where kind = 'turn' and {LIVE} and session_id in (from last))
select id, ts, who, outcome, title, round(case when touched then 3 else 0 end + case outcome when 'open' then 2 when 'rejected' then 1 else 0 end + coalesce(greatest(0.0, (coalesce(ms, t0) - coalesce(t0, ms)) / 86400000.0), 0), 6) as score
from r, o order by score desc, coalesce(outcome = 'open', false) desc, id limit 20"""
)
def brief_scoring(s, d):
    docs = read(s, d, "docs")
    file = docs.agg(F.min(F.get_json_object("files_json", "$[0]"))).first()[0]
    return inventory.brief(docs, files=[file] if file else [])


# Full text

_LEAF = "len(list_filter({t}, lambda x: x = '{w}'))"


def _bm25_sql(words: list[str], cond: str, weight: str = "1.0", extra: str = "") -> str:
    """BM25 in SQL for single words."""
    cols = ", ".join(f"{_LEAF.format(t='tt', w=w)} as t{k}, {_LEAF.format(t='bt', w=w)} as b{k}" for k, w in enumerate(words))
    dfs = ", ".join(f"count(*) filter (t{k} + b{k} > 0) as df{k}" for k in range(len(words)))
    rank = " - ".join(
        f"case when t{k} + b{k} > 0 then (case when ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 then 1e-6 else ln((n - df{k} + 0.5) / (df{k} + 0.5)) end) * (t{k} * {weight} + b{k}) * 2.2 / (t{k} * {weight} + b{k} + 1.2 * (0.25 + 0.75 * len / avgdl)) else 0 end"
        for k in range(len(words))
    )
    return f"""with w as (select id, status, superseded_by, kind, {TOKENS.format("coalesce(title, '')")} as tt, {TOKENS.format("coalesce(body, '')")} as bt from docs),
h as (select *, len(tt) + len(bt) as len, {cols} from w), s as (select count(*) as n, avg(len) as avgdl, {dfs} from h)
select id, round(0 - {rank}, 6) as rank from h, s where ({cond}) {extra} order by 2, 1"""


def _search(s, d, q, mode, weight=1.0):
    return fulltext.bm25(read(s, d, "docs"), fulltext.parse(q, mode), weight)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


@query(_bm25_sql(["ledger", "parser"], "t0 + b0 > 0 or t1 + b1 > 0", extra=f"and {LIVE}") + " limit 20")
def fts_any_bm25(s, d):
    return _ranked(filters.Scope(tools=True).where(_search(s, d, "ledger parser", "any"))).orderBy("rank", "id").limit(20)


@query(_bm25_sql(["ledger", "schema"], "t0 + b0 > 0 and t1 + b1 > 0"))
def fts_all_bm25(s, d):
    return _ranked(_search(s, d, "ledger schema", "all"))


@query(_bm25_sql(["handoff", "review"], "t0 + b0 > 0 or t1 + b1 > 0", "3.0"))
def fts_weighted_bm25(s, d):
    return _ranked(_search(s, d, "handoff review", "any", 3.0))


_PAD = "' ' || array_to_string({}, ' ') || ' '"
_T, _B = TOKENS.format("coalesce(title, '')"), TOKENS.format("coalesce(body, '')")


@query(f"select id from docs where contains({_PAD.format(_B)}, ' no answer ') or contains({_PAD.format(_T)}, ' no answer ')")
def fts_phrase(s, d):
    return _search(s, d, '"no answer"', "any").select("id")


@query(f"select id from docs where len(list_filter(list_concat({_T}, {_B}), lambda x: starts_with(x, 'migr'))) > 0 and not list_contains(list_concat({_T}, {_B}), 'ledger')")
def fts_prefix_not(s, d):
    return _search(s, d, "migr* NOT ledger", "advanced").select("id")


@query(
    f"""with w as (select id, unnest([{_T}, {_B}]) as toks from docs), p as (select id, toks, generate_series(1, len(toks)) as g from w),
a as (select id, list_filter(g, lambda i: toks[i] = 'ledger') as x, list_filter(g, lambda i: toks[i] = 'closed') as y from p)
select distinct id from a where len(list_filter(x, lambda i: len(list_filter(y, lambda j: abs(i - j) - 1 <= 4)) > 0)) > 0"""
)
def fts_near(s, d):
    return _search(s, d, "NEAR(ledger closed, 4)", "advanced").select("id")


@query(f"select id from docs where list_contains({_T}, 'review') and (list_contains({_B}, 'open') or list_contains({_B}, 'ledger'))")
def fts_column_boolean(s, d):
    return _search(s, d, "title: review AND body: (open OR ledger)".replace("body: (open OR ledger)", "(body: open OR body: ledger)"), "advanced").select("id")


@query("select id from docs where regexp_matches(coalesce(title, ''), '(?is)ledger.*cold') or regexp_matches(coalesce(body, ''), '(?is)ledger.*cold')")
def substring_glob(s, d):
    return fulltext.substring(read(s, d, "docs"), "ledger*cold").select("id")


@query(_bm25_sql(["ledger", "schema"], "t0 + b0 > 0 and t1 + b1 > 0"))
def fts_indexed_bm25(s, d):
    """From a written index: the buckets of two terms, lengths and statistics."""
    index = fulltext.write_index(read(s, d, "docs"), shared_dir(s, "index"))
    return _ranked(fulltext.bm25_indexed(index, fulltext.parse("ledger schema", "all"))).orderBy("rank", "id")


@query(f"with t as (select id, unnest(list_concat({_T}, {_B})) as term from docs) select term, count(distinct id) as df, count(*)::bigint as cf from t group by 1")
def token_df_stats(s, d):
    return fulltext.term_statistics(read(s, d, "docs"))


@query(f"with t as (select id, unnest({_B}) as term from docs) select term, id, count(*) as tf from t where term in ('ledger', 'parser', 'schema') group by 1, 2")
def postings_lookup(s, d):
    return fulltext.postings(read(s, d, "docs")).filter(F.col("term").isin("ledger", "parser", "schema") & (F.col("col") == "body")).select("term", "id", "tf")


# Vectors


def _query_vector(s, d, width: int = 64) -> list[float]:
    return [((k * 37) % 17 - 8) / 8.0 for k in range(width)]


_QV = "[" + ", ".join(repr(((k * 37) % 17 - 8) / 8.0) for k in range(64)) + "]::double[]"


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QV}), 6) as sim from embeddings order by list_cosine_similarity(embedding::double[], {_QV}) desc, vec_id limit 20")
def vector_topk_cosine(s, d):
    return semantic.top_k(read(s, d, "embeddings"), _query_vector(s, d), 20, "embedding", "vec_id").withColumn("sim", F.round("sim", 6))


@query(f"select vec_id, label from embeddings where list_cosine_similarity(embedding::double[], {_QV}) >= 0.1")
def vector_floor_filter(s, d):
    return read(s, d, "embeddings").filter(V.cosine(F.col("embedding"), V.literal(_query_vector(s, d))) >= 0.1).select("vec_id", "label")


_CSIM = f"case when vec is not null and len(vec) = 64 and list_dot_product(vec::double[], vec::double[]) > 0 then list_cosine_similarity(vec::double[], {_QV}) end"


@query(f"select project, doc_id, round(sim, 6) as sim, start_offset from (select *, {_CSIM} as sim from chunks) where sim is not null qualify row_number() over (partition by project, doc_id order by sim desc, ordinal) = 1")
def best_chunk_per_doc(s, d):
    return semantic.best_chunk(read(s, d, "chunks"), _query_vector(s, d)).select("project", "doc_id", F.round("sim", 6).alias("sim"), "start_offset")


@query(
    f"""with h as (select doc_id, count(*) as n, count(vec) as good from chunks group by 1)
select project, count(*) as eligible, count(n) as indexed, count(*) filter (n = good) as complete, count(*) filter (n is null) as missing
from (select id, project from docs where {ELIGIBLE}) left join h on doc_id = id group by 1"""
)
def vector_coverage(s, d):
    return semantic.coverage(read(s, d, "docs"), read(s, d, "chunks"))


@query(f"select id from docs where {ELIGIBLE} and id not in (select doc_id from vectors where model = 'tern-64' and vec is not null)")
def anti_missing_vectors(s, d):
    return semantic.missing_vectors(read(s, d, "docs"), read(s, d, "vectors"), "tern-64").select("id")


def _lanes(s, d):
    words = fulltext.bm25(read(s, d, "docs"), fulltext.parse("ledger", "any")).select("id", "rank")
    sims = semantic.best_chunk(read(s, d, "chunks"), _query_vector(s, d)).select(F.col("doc_id").alias("id"), F.round("sim", 9).alias("sim"))
    return {"words": semantic.placed_all(words, "rank", "id").select("id", "place"), "meaning": semantic.placed_all(sims, F.desc("sim"), "id").select("id", "place")}


@query(
    f"""with k as ({_bm25_sql(["ledger"], "t0 + b0 > 0").replace("round(0 - ", "(0 - ").replace(", 6) as rank", ") as rank")}), a as (select id, row_number() over (order by rank, id) - 1 as place from k),
v as (select doc_id as id, round(max({_CSIM}), 9) as sim from chunks group by 1 having max({_CSIM}) is not null), b as (select id, row_number() over (order by sim desc, id) - 1 as place from v)
select id, round(sum(1.0 / (5 + place)), 6) as score, string_agg(lane, ',' order by lane) as lanes from (select *, 'words' as lane from a union all select *, 'meaning' from b) group by 1"""
)
def rrf_fusion(s, d):
    return semantic.fuse(_lanes(s, d)).withColumn("score", F.round("score", 6))


@query(f"select distinct doc_id as id from chunks where vec is not null and ({_CSIM}) >= 0.0 and doc_id in (select id from docs where list_contains({_T}, 'ledger') or list_contains({_B}, 'ledger'))")
def hard_match_semijoin(s, d):
    hits = fulltext.bm25(read(s, d, "docs"), fulltext.parse("ledger", "all")).select("id")
    near = semantic.best_chunk(read(s, d, "chunks"), _query_vector(s, d)).filter("sim >= 0").select(F.col("doc_id").alias("id"))
    return near.join(hits, "id", "left_semi").distinct()


@query()
def chunk_text(s, d):
    return semantic.chunked(read(s, d, "docs")).select("id", "ordinal", "start_offset", "end_offset")


# Joins and windows


@query("select path from sources where path in (select path from docs)")
def semi_sources(s, d):
    return read(s, d, "sources").select("path").join(read(s, d, "docs").select("path"), "path", "left_semi")


@query(f"select id, lag(id) over w as previous, lead(id) over w as next from docs where {SPOKEN} window w as (partition by session_id order by ts nulls first, id)")
def neighbours_lag_lead(s, d):
    return relations.neighbours(read(s, d, "docs"))


@query(
    f"""with t as (select session_id, ts, id from docs where {SPOKEN}), a as (select session_id, ts, id from docs where kind = 'statement' and session_id is not null)
select a.id, (select t.id from t where t.session_id = a.session_id and (t.ts, t.id) < (a.ts, a.id) order by t.ts desc, t.id desc limit 1) as previous,
(select t.id from t where t.session_id = a.session_id and (t.ts, t.id) > (a.ts, a.id) order by t.ts, t.id limit 1) as next from a"""
)
def asof_neighbours(s, d):
    docs = read(s, d, "docs")
    return relations.neighbours_of(docs.filter("kind = 'statement' and session_id is not null"), docs)


@query(f"select id, list(id) over (partition by session_id order by ts nulls first, id rows between 3 preceding and 1 preceding) as before from docs where {SPOKEN}".replace("list(id) over", "coalesce(array_to_string(list(id) over").replace("1 preceding) as", "1 preceding), ','), '') as"))
def asof_previous_turns(s, d):
    return relations.turns_before(read(s, d, "docs"), 3).withColumn("before", F.array_join("before", ","))


@query(
    f"""with a as (select id as anchor, project, ({MS}) as ms from docs where kind = 'statement'), t as (select id, project, ({MS}) as ms from docs where {SPOKEN} and role = 'user')
select a.anchor, t.id from a join t on a.project = t.project and t.ms between a.ms - 86400000 and a.ms + 120000 qualify row_number() over (partition by anchor order by t.ms desc, t.id desc) <= 400"""
)
def range_join_recent_turns(s, d):
    docs = read(s, d, "docs").withColumn("ms", dates.event_ms(F.col("ts"))).filter("ms is not null")
    anchors = docs.filter("kind = 'statement'").select(F.col("id").alias("anchor"), "project", "ms")
    turns = docs.filter(filters.spoken() & (F.col("role") == "user")).select("id", "project", "ms")
    return relations.turns_around(anchors, turns, 86_400_000, 120_000, 400)


@query("select distinct s.id as statement_id, e.id, e.ts from (select id, project, unnest(cast(json(evidence_ids) as bigint[])) as ev from docs where kind = 'statement') s join docs e on e.id = s.ev and e.project = s.project")
def evidence_unnest_join(s, d):
    return relations.evidence(read(s, d, "docs"))


@query("select a.id as old_id, b.id as new_id, a.project from docs a join docs b on a.superseded_by = b.id and a.project = b.project")
def relations_self_join(s, d):
    docs = read(s, d, "docs")
    b = docs.select(F.col("id").alias("new_id"), F.col("project").alias("_p"))
    return docs.filter("superseded_by is not null").select(F.col("id").alias("old_id"), "superseded_by", "project").join(b, (F.col("superseded_by") == F.col("new_id")) & (F.col("project") == F.col("_p"))).select("old_id", "new_id", "project")


_META = """select path, json_extract_string(payload, '$.id') as thread, coalesce(json_extract_string(payload, '$.history_base.thread_id'), json_extract_string(payload, '$.forked_from_id')) as base_thread, min(ordinal) as first_ordinal,
max(coalesce(try_cast(json_extract_string(payload, '$.history_base.end_ordinal_exclusive') as bigint), 1000000)) as cut from codex_rollout where type = 'session_meta' and json_valid(payload) group by 1, 2, 3"""


@query(
    f"""with f as ({_META}) select f.path, arg_max(b.path, (b.first_ordinal, b.path)) filter (b.path is not null) as base_path
from f left join f b on f.base_thread = b.thread and b.first_ordinal < f.cut and b.path <> f.path where f.base_thread is not null group by 1"""
)
def lineage_latest_earlier(s, d):
    j = lambda p: F.get_json_object("payload", p)
    meta = read(s, d, "codex_rollout").filter((F.col("type") == "session_meta") & F.try_parse_json("payload").isNotNull())
    base = F.coalesce(j("$.history_base.thread_id"), j("$.forked_from_id"))
    cut = F.coalesce(j("$.history_base.end_ordinal_exclusive").try_cast("bigint"), F.lit(1_000_000))
    files = meta.groupBy("path", j("$.id").alias("thread"), base.alias("base_thread")).agg(F.min("ordinal").alias("first_ordinal"), F.max(cut).alias("cut"))
    return relations.lineage_base(files)


_TOPIC = "list_filter(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]{3,}')), lambda x: not list_contains([" + ", ".join(f"'{w}'" for w in text.OVERLAP_STOP) + "], x))"


@query(
    f"""with s as (select id, session_id, ts, who, outcome, {_TOPIC} as w from docs where kind = 'statement' and status = 'active'),
p as (select o.id as old_id, n.id as new_id, len(list_intersect(o.w, n.w)) / least(len(o.w), len(n.w)) as score,
 o.outcome = 'superseded' and o.session_id is not distinct from n.session_id as labelled, n.outcome as no, o.session_id is not distinct from n.session_id as same,
 coalesce(n.who = 'owner' and ((n.outcome = 'rejected' and o.outcome in ('approved', 'proposed', 'completed')) or (n.outcome = 'approved' and o.outcome = 'rejected') or (n.outcome = 'standing' and o.outcome = 'standing')), false) as overturn
 from s n join s o on o.ts < n.ts and o.id <> n.id where len(o.w) > 0 and len(n.w) > 0)
select old_id, new_id, round(score, 6) as score from p where no <> 'superseded' and (labelled or overturn) and score >= 0.3 and (labelled or no <> 'approved' or not same)
qualify row_number() over (partition by new_id order by score desc, old_id) <= 3"""
)
def nominate_theta_topk(s, d):
    return relations.nominate(read(s, d, "docs")).withColumn("score", F.round("score", 6))


@query(
    f"""with i as (select id, session_id, outcome, {LAST_EVIDENCE} as turn, trim(regexp_replace(nfc_normalize(quote), '\\s+', ' ', 'g')) as q from docs where kind = 'statement' and status not in ('active', 'struck') and quote is not null)
select id from i where not exists (select 1 from docs k where k.kind = 'statement' and k.status in ('active', 'struck') and k.session_id = i.session_id and k.outcome = i.outcome
and list_max(cast(json(k.evidence_ids) as bigint[])) = i.turn and trim(regexp_replace(nfc_normalize(k.quote), '\\s+', ' ', 'g')) = i.q and i.q <> '')"""
)
def twin_anti_join(s, d):
    docs = read(s, d, "docs")
    items = docs.filter("kind = 'statement' and status not in ('active', 'struck') and quote is not null").select("id", "session_id", "outcome", lifecycle.last_evidence().alias("turn"), "quote")
    return relations.twins(items, docs).select("id")


@query(
    """with l as (select session_id, max((ts, source_client)) as m from docs where kind = 'turn' and status = 'active' and session_id is not null and ts is not null group by 1)
select distinct l.session_id from l join docs h on h.kind = 'handoff' and h.status = 'active' and substring(h.ts, 1, 10) = substring(m[1], 1, 10) and (h.source_client is null or h.source_client = m[2])""".replace("m[1]", "struct_extract_at(m, 1)").replace("m[2]", "struct_extract_at(m, 2)")
)
def covered_sessions(s, d):
    return relations.covered_sessions(read(s, d, "docs").filter("ts is not null"))


_LANE_SQL = " union all ".join(f"select * from (select id, {n} as lane, row_number() over (order by id) - 1 as place from docs where kind = '{k}' and {LIVE} order by id limit 20)" for n, k in enumerate(("statement", "handoff", "turn")))


@query(f"with l as ({_LANE_SQL}) select id, lane, place from l order by place, lane limit 30")
def lane_interleave(s, d):
    docs = read(s, d, "docs").filter(filters.live())
    lanes = [semantic.placed(docs.filter(F.col("kind") == k).select("id").orderBy("id").limit(20), "id") for k in ("statement", "handoff", "turn")]
    return relations.interleave(lanes, 30).withColumn("place", F.col("place").cast("bigint"))


@query(
    """with t as (select id, row_number() over (order by ts nulls first, id) as n from docs where kind = 'turn' and (project, session_id, coalesce(source_client, '')) = (select (project, session_id, coalesce(source_client, '')) from docs where id = 100))
select id, n - (select n from t where id = 100) as "offset" from t where n - (select n from t where id = 100) between -3 and 4"""
)
def context_window(s, d):
    return relations.context_window(read(s, d, "docs"), 100, 3, 4)


@query(f"select id, ({MS}) as ms from docs where {LIVE} and ({MS}) is not null and (({MS}), id) < (1764547200000, 1) order by 2 desc, 1 desc limit 25")
def keyset_page(s, d):
    rows = read(s, d, "docs").filter(filters.live()).select("id", dates.event_ms(F.col("ts")).alias("ms")).filter("ms is not null")
    after = (F.col("ms") < 1764547200000) | ((F.col("ms") == 1764547200000) & (F.col("id") < 1))
    return rows.filter(after).orderBy(F.desc("ms"), F.desc("id")).limit(25)


@query("select p_partkey, l_suppkey, q from (select l_partkey as p_partkey, l_suppkey, sum(l_quantity) as q from lineitem group by 1, 2) qualify row_number() over (partition by p_partkey order by q desc, l_suppkey) <= 3")
def top3_per_key(s, d):
    q = read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("p_partkey").orderBy(F.desc("q"), "l_suppkey")
    return q.withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query(
    f"""with recursive t as (select session_id, id, length(body) + 24 as n, row_number() over (partition by session_id order by ts nulls first, id) as k from docs where {SPOKEN} and session_id is not null),
r as (select session_id, k, id, n, 0 as chunk, n as size from t where k = 1 union all
 select t.session_id, t.k, t.id, t.n, case when r.size + t.n > 4000 then r.chunk + 1 else r.chunk end, case when r.size + t.n > 4000 then t.n else r.size + t.n end from r join t on t.session_id = r.session_id and t.k = r.k + 1)
select session_id, chunk::bigint as chunk, arg_min(id, k) as first_id, arg_max(id, k) as last_id, count(*) as turns, sum(n)::bigint as size from r group by 1, 2"""
)
def greedy_chunk_packing(s, d):
    return relations.packed_chunks(read(s, d, "docs"), 4000)


# Changes of state


@query("select sha, min(id) as id, count(*) as n from docs where sha is not null group by 1")
def dedup_by_sha(s, d):
    docs = read(s, d, "docs").filter("sha is not null")
    n = docs.groupBy("sha").agg(F.count("*").alias("n"))
    return lifecycle.first_of_each(docs.select("sha", "id"), "sha").join(n, "sha")


@query(
    """with n as (select * from docs where id > 2000), e as (select * from docs where id <= 2000), h as (select sha, min(id) as k, arg_min(path, id) as p from docs where sha is not null group by 1)
select distinct h.k as doc_id, n.path from n join h using (sha) where n.id <> h.k and n.path is distinct from h.p"""
)
def insert_once_occurrences(s, d):
    docs = read(s, d, "docs")
    return lifecycle.insert_once(docs.filter("id <= 2000"), docs.filter("id > 2000"))[1].select("doc_id", "path")


@query("select path, epoch_ms(max(listed_at)) as listed_ms, arg_max(size, (listed_at, size)) as size from source_files group by 1")
def upsert_latest(s, d):
    return lifecycle.latest(read(s, d, "source_files").select("path", "listed_at", "size"), ["path"], [F.col("listed_at"), F.col("size")]).select("path", F.unix_millis("listed_at").alias("listed_ms"), "size")


_QKEY = "trim(regexp_replace(nfc_normalize(coalesce(quote, '')), '\\s+', ' ', 'g'))"


@query(
    f"""with r as (select id, max(id) over (partition by session_id, {LAST_EVIDENCE}, outcome, {_QKEY}) as keep from docs where kind = 'statement' and status = 'active' and session_id is not null and {_QKEY} <> '' and {LAST_EVIDENCE} is not null)
select d.id, case when r.keep <> d.id then 'superseded' else d.status end as status, case when r.keep <> d.id then r.keep else d.superseded_by end as superseded_by from docs d left join r on r.id = d.id where d.kind = 'statement'"""
)
def dedupe_statements(s, d):
    return lifecycle.dedupe_statements(read(s, d, "docs")).filter("kind = 'statement'").select("id", "status", "superseded_by")


@query(
    """with l as (select path, kind, title, max(id) as k from docs where status = 'active' and kind <> 'turn' group by all)
select d.id, coalesce(d.superseded_by, case when d.status = 'superseded' then l.k end) as superseded_by from docs d left join l on l.path = d.path and l.kind = d.kind and l.title = d.title where d.kind <> 'turn'"""
)
def supersede_and_link(s, d):
    return lifecycle.link_sections(read(s, d, "docs")).filter("kind <> 'turn'").select("id", "superseded_by")


@query(f"select id, case when kind = 'statement' and status = 'active' and session_id is not null and {LAST_EVIDENCE} between 1 and 2000 and session_id = (select session_id from docs where kind = 'statement' and status = 'active' and session_id is not null order by id limit 1) then 'superseded' else status end as status from docs where kind = 'statement'")
def supersede_by_evidence(s, d):
    docs = read(s, d, "docs")
    row = docs.filter("kind = 'statement' and status = 'active' and session_id is not null").orderBy("id").select("session_id").first()
    return lifecycle.supersede_by_evidence(docs, row[0] if row else "", 1, 2000).filter("kind = 'statement'").select("id", "status")


_REPLACED = "select id as old_id, unnest([lead(id, 1) over w, lead(id, 2) over w]) as new_id from docs where kind = 'statement' window w as (partition by project order by id)"


@query(f"with v as ({_REPLACED}), f as (select v.old_id, arg_min(n.id, (coalesce(n.ts, ''), n.id)) as t from v join docs n on n.id = v.new_id group by 1) select d.id, coalesce(f.t, d.superseded_by) as superseded_by from docs d left join f on f.old_id = d.id where d.kind = 'statement'")
def first_replacement(s, d):
    docs = read(s, d, "docs")
    w = Window.partitionBy("project").orderBy("id")
    verdicts = docs.filter("kind = 'statement'").select(F.col("id").alias("old_id"), F.array(F.lead("id", 1).over(w), F.lead("id", 2).over(w)).alias("later")).select("old_id", F.explode("later").alias("new_id")).filter("new_id is not null")
    return lifecycle.point_replaced(docs, verdicts).filter("kind = 'statement'").select("id", "superseded_by")


# Text functions


def _scrub_sql(column: str) -> str:
    """All seven patterns; where look-arounds stand for word borders in the expression, the SQL's own borders are those of ASCII."""
    for pattern, to in text.SECRETS:
        flags = "g"
        for name in "im":
            if pattern.startswith(f"(?{name})"):
                pattern = pattern[4:]
                flags += "i" if name == "i" else "m"
        pattern = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
        if "m" in flags:
            pattern, flags = "(?m)" + pattern, "g"
        column = f"regexp_replace({column}, '{pattern}', '{to.replace('$', chr(92))}', '{flags}')"
    return column


@query(f"select id, {_scrub_sql('body')} as body, {_scrub_sql('title')} as title, {_scrub_sql('quote')} as quote from docs")
def scrub_secrets(s, d):
    return read(s, d, "docs").select("id", *[text.scrub(F.col(c)).alias(c) for c in ("body", "title", "quote")])


@query(f"select id, len({_TOPIC}) as words, round(case when len({_TOPIC}) > 0 then len(list_intersect({_TOPIC}, ['ledger', 'cache', 'schema'])) / least(len({_TOPIC}), 3) else 0 end, 6) as share from docs")
def token_overlap(s, d):
    w = text.topic_tokens(F.col("title"))
    return read(s, d, "docs").select("id", F.size(w).cast("bigint").alias("words"), F.round(text.overlap(w, F.array(F.lit("ledger"), F.lit("cache"), F.lit("schema"))), 6).alias("share"))


@query("select id, trim(regexp_replace(nfc_normalize(coalesce(quote, '')), '\\s+', ' ', 'g')) as q from docs where quote is not null")
def quote_key(s, d):
    return read(s, d, "docs").filter("quote is not null").select("id", text.quote_key(F.col("quote")).alias("q"))


@query("select id from docs where regexp_matches(' ' || lower(regexp_replace(body, '\\s+', ' ', 'g')) || ' ', '[^\\p{L}\\p{N}]can you make[^\\p{L}\\p{N}]')")
def phrase_match(s, d):
    return read(s, d, "docs").filter(text.contains_phrase(F.col("body"), "Can you make")).select("id")


@query(
    r"""select id, case when regexp_matches(regexp_replace(regexp_replace(body, '^\s+|\s+$', '', 'g'), '[?!.]+$|\s+[?!.]+$', ''), '""" + text.RULES + r"""') then 'instruction' when regexp_matches(lower(body), '\b(continue|resume|pick up|where (we|i) left off)\b') then 'continue' when regexp_matches(lower(body), '\b(what do you remember about|catch me up|overview)\b') then 'overview'
when regexp_matches(lower(body), '\bwhy (did|do|was|were)\b') then 'rationale' when regexp_matches(lower(body), '\b(decide|decided|decision|agreed|choose|chose)\b') then 'decision'
when regexp_matches(lower(body), '\b(told you|my rules|standing orders|preference|always|never)\b') then 'instruction' when regexp_matches(lower(body), '\b(similar|before|remember|discussed)\b') then 'related-history' else 'recollection' end as intent
from docs where body is not null"""
)
def intent_classify(s, d):
    return read(s, d, "docs").filter("body is not null").select("id", text.intent(F.col("body")).alias("intent"))


@query(f"select id, strftime(timezone('America/New_York', make_timestamp(({MS}) * 1000)::timestamptz), '%Y-%m-%d') as day from docs where ({MS}) is not null")
def local_day_periods(s, d):
    ms = dates.event_ms(F.col("ts"))
    return read(s, d, "docs").filter(ms.isNotNull()).select("id", F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), "America/New_York"), "yyyy-MM-dd").alias("day"))


# Sources


@query(
    """select rec_id, json_extract_string(payload, '$.id') as item_key from codex_rollout where type = 'event_msg' and json_valid(payload) and json_extract_string(payload, '$.type') = 'item_completed' and json_extract_string(payload, '$.item.type') = 'FileChange' and len(json_keys(payload, '$.item.changes')) > 0"""
)
def rollout_file_changes(s, d):
    j = lambda p: F.get_json_object("payload", p)
    r = read(s, d, "codex_rollout").filter((F.col("type") == "event_msg") & F.try_parse_json("payload").isNotNull() & (j("$.type") == "item_completed") & (j("$.item.type") == "FileChange"))
    return r.filter(F.size(F.map_keys(F.from_json(j("$.item.changes"), "map<string,string>"))) > 0).select("rec_id", j("$.id").alias("item_key"))


@query()
def transcript_second_dialect(s, d):
    from tidemark.sources import transcripts

    return transcripts.second_dialect(read(s, d, "codex_rollout"), "p").select("session_id", "ts", "role", "origin", "body", "sha")


@query()
def transcript_left_out(s, d):
    from tidemark.sources import transcripts

    return transcripts.left_out(read(s, d, "codex_rollout"))


@query(r"select doc_id, len(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: regexp_matches(l, '^#{2,3} +[^ ]'))) as headings from documents where text is not null")
def section_headings(s, d):
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    return read(s, d, "documents").filter("text is not null").select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(r"^#{2,3} +[^ ]"))).cast("bigint").alias("headings"))


@query()
def section_split(s, d):
    from tidemark.sources import markdown

    notes = read(s, d, "documents").select("doc_id", "path", F.col("text").alias("content"))
    return markdown.sections(notes, "map_section").select("doc_id", "place", "title", "section")


@query("select distinct sha from docs where sha is not null and kind = 'turn' order by sha limit 50")
def sha_sample(s, d):
    return read(s, d, "docs").filter("sha is not null and kind = 'turn'").select("sha").distinct().orderBy("sha").limit(50)


# Streams, drained and held against the batch result


def _events(s, d):
    from tidemark.streaming import ingest

    return ingest.files(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))




@query("select event_id, user_id, event_type from events")
def stream_dedup_ingest(s, d):
    from tidemark.streaming import ingest

    ev = _events(s, d)
    return ingest.drain(ingest.once_per_key(ev, "event_id", "at", "30 days").select("event_id", "user_id", "event_type"))


@query()
def stream_tumbling(s, d):
    from tidemark.streaming import ingest

    return ingest.drain(ingest.tumbling(_events(s, d), "at", "1 day", "1 hour", "event_type"))


@query()
def stream_session_window(s, d):
    from tidemark.streaming import ingest

    return ingest.drain(ingest.sessions(_events(s, d), "at", "30 minutes", "1 hour", "user_id"))


@query("select epoch_ms(time_bucket(interval 1 day, ts)) as start_ms, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def batch_tumbling(s, d):
    ev = read(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return ev.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


# Extraction and decisions


@query(
    f"""with s as (select id, {LAST_EVIDENCE} as turn, outcome, title, quote, who from docs where kind = 'statement' and quote is not null),
t as (select id, {SPEAKER} as sp, lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) as b from docs where {SPOKEN})
select s.id as item, t.id is not null as there, coalesce(contains(t.b, lower(trim(regexp_replace(s.quote, '\\s+', ' ', 'g')))), false) as exact from s left join t on t.id = s.turn"""
)
def quote_in_turn(s, d):
    docs = read(s, d, "docs")
    st = docs.filter("kind = 'statement' and quote is not null").select(F.col("id").alias("item"), lifecycle.last_evidence().alias("turn"), "quote")
    turns = docs.filter(filters.spoken()).select("id", text.collapse(F.col("body")).alias("b"))
    met = st.join(turns, F.col("turn") == F.col("id"), "left")
    return met.select("item", F.col("id").isNotNull().alias("there"), F.coalesce(F.contains("b", text.collapse(F.col("quote"))), F.lit(False)).alias("exact"))


@query()
def validate_statements(s, d):
    from tidemark.operators import decisions

    docs = read(s, d, "docs")
    items = docs.filter("kind = 'statement'").select(F.col("id").alias("item"), F.concat(F.lit("T"), lifecycle.last_evidence().cast("string")).alias("turn"), "outcome", F.col("title").alias("statement"), "quote", "reason", "who")
    return decisions.validate(items, docs).select("item", "doc_id", "who", "quote", "reject_reason")


@query()
def link_pending(s, d):
    from tidemark.operators import decisions

    docs = read(s, d, "docs").withColumn("ms", dates.event_ms(F.col("ts")))
    pending = docs.filter("kind = 'statement' and status in ('pending', 'unverified') and ms is not null").select("id", "project", "ms", "quote", "status", F.col("source_client").alias("client"))
    turns = docs.filter(filters.spoken() & (F.col("role") == "user") & F.col("ms").isNotNull()).select("id", "project", "ms", "body", "session_id", F.col("source_client").alias("client"))
    return decisions.link_pending(pending, turns, docs.filter(filters.spoken()).select("id", "session_id", "ts", "role", "body"))


# Orchestration


@query()
def find_page(s, d):
    from tidemark.plans import search

    got = search.find(search.Store(read(s, d, "docs")), "ledger parser", limit=10)
    return s.createDataFrame([(r["id"], r["kind"], r["title"]) for r in got["rows"]], "id bigint, kind string, title string")


@query()
def recall_packet(s, d):
    from tidemark.plans import search

    got = search.recall(search.Store(read(s, d, "docs")), "What did we decide about the ledger schema?")
    return s.createDataFrame([(r["id"], r["kind"], r["seed"], r["text"][:200]) for r in got["records"]], "id bigint, kind string, seed boolean, text string")


# Star schema: the relational core at scale


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty, round(sum(l_extendedprice), 4) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem
where l_shipdate <= timestamp '1998-09-02' group by 1, 2"""
)
def star_pricing_summary(s, d):
    li = read(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 4).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"""
)
def star_local_suppliers(s, d):
    c, o, li, su, n, r = (read(s, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    geo = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    sup = su.join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
    j = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def star_customers_without_orders(s, d):
    return read(s, d, "customer").join(read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
