"""The top-level operations: find with pages and cursors, read, inventory, and the recall packet."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import filters, fulltext, inventory, relations, semantic
from tidemark.operators.filters import Scope

LIMIT, MOST, PAGE_CHARS = 20, 100, 8000


@dataclass
class Store:
    """The tables that the operations work on."""

    docs: DataFrame
    chunks: DataFrame | None = None
    encoder: Callable[[list[str]], list[list[float]]] | None = None
    least: float = 0.62
    timezone: str = "UTC"
    now_ms: int | None = None
    #: Postings of exactly these docs, where they are kept; without them each search reads the texts.
    index: fulltext.Index | None = None
    #: The revision stored with the snapshot; without it each page hashes all rows.
    stored_revision: str | None = None

    def revision(self) -> str:
        return self.stored_revision or inventory.revision(self.docs).first()[0]


def _pack(**x) -> str:
    return base64.urlsafe_b64encode(json.dumps(x, sort_keys=True).encode()).decode().rstrip("=")


def _unpack(cursor: str, op: str, revision: str) -> dict:
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if x.get("op") != op:
        raise ValueError("a cursor of another operation")
    if x.get("revision") != revision:
        raise ValueError("the records changed since this cursor was made; search anew")
    return x


def matches(store: Store, query: str, mode: str, scope: Scope) -> DataFrame:
    """(id, ms, score, rank, lanes): all matches. Lexical statistics cover every row; filters come after."""
    docs = store.docs
    parsed = None if mode == "substring" else fulltext.parse(query, mode if mode != "words" else "any")
    keep = scope.where(docs).select("id", dates.event_ms(F.col("ts")).alias("ms"))
    if mode == "substring":
        return fulltext.substring(docs, query).select("id").join(keep, "id").select("id", "ms", F.lit(0.0).alias("score"), F.lit(0.0).alias("rank"), F.lit("words").alias("lanes"))
    if parsed is None:
        return keep.select("id", "ms", F.lit(0.0).alias("score"), F.lit(0.0).alias("rank"), F.lit("filter").alias("lanes"))
    ranked = fulltext.bm25_indexed(store.index, parsed) if store.index else fulltext.bm25(docs, parsed).select("id", "rank")
    return _fused(store, query, mode, keep, ranked.join(keep, "id"))


def _fused(store: Store, query: str, mode: str, keep: DataFrame, words: DataFrame) -> DataFrame:
    """`matches` from the rows in scope (id, ms) and those of them that the words found (id, ms, rank)."""
    docs = store.docs
    if store.encoder is None or store.chunks is None:
        return words.select("id", "ms", (-F.col("rank")).alias("score"), "rank", F.lit("words").alias("lanes"))
    vector = store.encoder([query])[0]
    near = semantic.best_chunk(store.chunks, vector).filter(F.col("sim") >= store.least).select(F.col("doc_id").alias("id"), "sim").join(keep, "id")
    near = near.join(docs.filter(filters.indexable()).select("id"), "id", "left_semi")
    if mode in ("all", "phrase", "advanced"):  # exact modes: meaning only orders what the words found
        near = near.join(words.select("id"), "id", "left_semi")
    lanes = {"words": semantic.placed_all(words, "rank", "id").select("id", "place"), "meaning": semantic.placed_all(near, F.desc("sim"), "id").select("id", "place")}
    return semantic.fuse(lanes).join(words.select("id", "rank"), "id", "left").join(keep, "id").select("id", "ms", "score", F.coalesce("rank", F.lit(0.0)).alias("rank"), "lanes")


def find(store: Store, query: str = "", mode: str = "any", scope: Scope | None = None, limit: int = LIMIT, cursor: str | None = None, chars: int = PAGE_CHARS) -> dict:
    """A page of matches: rows, counts over all matches, and the cursor of the next page.

    Pages by time go on from the last (time, id); pages by relevance from a place. A cursor is refused
    once the records have changed. Bodies are fetched for the page's rows only.
    """
    scope = scope or Scope()
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    revision = store.revision()
    state = _unpack(cursor, "find", revision) if cursor else {"query": query, "mode": mode, "scope": asdict(scope), "limit": limit, "place": 0, "after": None}
    query, mode, limit, scope = state["query"], state["mode"], state["limit"], Scope(**state["scope"])
    hits = matches(store, query, mode, scope).cache()
    try:
        counts = inventory.units(store.docs.join(hits.select("id"), "id", "left_semi")).first().asDict()
        rows, place = hits, state["place"]
        if scope.order == "relevance":
            rows = rows.orderBy(F.desc("score"), F.asc("rank"), "id").limit(place + limit + 1)
        else:
            newest = scope.order == "newest"
            if state["after"]:
                ms, i = state["after"]
                m, same = F.col("ms"), F.col("ms") == ms
                rows = rows.filter((m < ms) | (same & (F.col("id") < i))) if newest else rows.filter((m > ms) | (same & (F.col("id") > i)))
            rows, place = rows.orderBy(*([F.desc("ms"), F.desc("id")] if newest else ["ms", "id"])).limit(limit + 1), 0
        got = [r.asDict() for r in rows.collect()][place:]  # at most a page and one row
        wanted = [r["id"] for r in got[:limit]]
        full = {r["id"]: r.asDict() for r in store.docs.filter(F.col("id").isin(wanted)).withColumn("speaker", filters.speaker()).collect()} if wanted else {}
    finally:
        hits.unpersist()
    page, used = [], 0
    for r in got[:limit]:
        d = full[r["id"]]
        room = max(0, min(500, chars - used))
        row = {"id": d["id"], "ts": d["ts"], "kind": d["kind"], "speaker": d["speaker"], "outcome": d["outcome"], "title": (d["title"] or "")[:300], "text": (d["body"] or "")[:room], "truncated": len(d["body"] or "") > room, "lanes": r["lanes"], "score": r["score"]}
        cost = len(json.dumps(row, ensure_ascii=False))
        if page and used + cost > chars:
            break
        page.append(row)
        used += cost
    more = len(page) < len(got)
    state |= {"place": state["place"] + len(page), "after": [got[len(page) - 1]["ms"], page[-1]["id"]] if page and scope.order != "relevance" else None}
    return {"rows": page, "counts": counts, "next": _pack(op="find", revision=revision, **{k: v for k, v in state.items() if k not in ("op", "revision")}) if more and page else None}


def read(store: Store, id_: int, offset: int = 0, chars: int = 6000, before: int = 0, after: int = 0) -> dict:
    """One record as a stream of characters, from offset, with the turns around it."""
    row = store.docs.filter(F.col("id") == id_).limit(1).collect()
    if not row:
        raise ValueError(f"no record {id_}")
    d = row[0]
    head = f"{d['outcome']}: {d['title']}\n" if d["kind"] == "statement" else ""
    whole = head + (d["body"] or "")
    out = {"id": id_, "text": whole[offset : offset + chars], "total": len(whole), "next_offset": offset + chars if offset + chars < len(whole) else None}
    if before or after:
        out["context"] = [r.asDict() for r in relations.context_window(store.docs, id_, before, after).orderBy("offset").collect()]
    return out


def read_session(store: Store, session: str, page: int = 0, size: int = 50, newest: bool = False) -> list[dict]:
    """A page of a session's records by time; records without a time come first (last when newest first)."""
    sid = filters.resolve_session(store.docs, session)
    ms = dates.event_ms(F.col("ts"))
    order = [ms.desc_nulls_last(), F.desc("id")] if newest else [ms.asc_nulls_first(), F.asc("id")]
    rows = store.docs.filter(F.col("session_id") == sid).orderBy(*order).offset(page * size).limit(size)
    return [r.asDict() for r in rows.select("id", "ts", "role", "kind", "title").collect()]


def overview(store: Store, what: str, page: int = 0, size: int = 50) -> list[dict]:
    """sessions, coverage or projects."""
    if what == "sessions":
        df = inventory.sessions(store.docs).orderBy(F.desc_nulls_last("last_ms"), "session_id")
    elif what == "coverage":
        df = inventory.coverage(store.docs).orderBy("source_client", "kind")
    elif what == "projects":
        df = store.docs.groupBy("project").agg(F.count("*").alias("records")).orderBy("project")
    else:
        raise ValueError(f"no such overview: {what}")
    return [r.asDict() for r in df.offset(page * size).limit(size).collect()]


def request_intent(request: str) -> str:
    bare = re.sub(r"[?!.]+$", "", request.strip()).strip()
    if re.match(text.RULES, bare):
        return "instruction"
    return next((name for name, p in text.INTENTS if re.search(p, request.lower())), "recollection")


# The lead-ins of a request that are no part of its topic.
_LEAD = r"(?i)^(?:please\s+)?(?:do you remember(?: when we discussed)?|what do you remember about|what did we (?:decide|agree)(?: about| on)?|why did we|what have i told you about|we discussed something similar before(?: about)?|continue what we were doing|resume(?: work on)?|catch me up(?: on)?)\b\s*"


def request_topic(request: str) -> str:
    bare = re.sub(r"[?!.]+$", "", request.strip()).strip()
    if m := re.match(text.RULES, bare):
        return (m[1] or "").strip()
    return re.sub(_LEAD, "", bare).strip()


def recall(store: Store, request: str, scope: Scope | None = None, limit: int = 8, chars: int = 24_000) -> dict:
    """A bounded packet: one to three lanes of matches, taken in turn, opened, with the evidence and neighbours of what was opened."""
    if not request.strip() or len(request) > 4000:
        raise ValueError("a request has 1 to 4000 characters")
    if not 1 <= limit <= 30:
        raise ValueError("limit must be 1 to 30")
    base = scope or Scope()
    intent, topic = request_intent(request), request_topic(request)
    note = None
    if (m := re.search(r"(?i)\b(today|yesterday|last week)$", topic)) and base.lo is None and base.hi is None:
        now = store.now_ms or 0
        lo, hi = dates.last_week(store.timezone, now) if m[1].lower() == "last week" else dates.period(m[1].lower(), store.timezone, now)
        base, topic, note = Scope(**(asdict(base) | {"lo": lo, "hi": hi})), topic[: m.start()].strip(), f"{m[1].lower()} in {store.timezone}"
    words = [w for w in dict.fromkeys(re.findall(r"\w+", topic)) if w.lower() not in text.TOPIC_STOP]
    rules = intent == "instruction" and re.match(text.RULES, re.sub(r"[?!.]+$", "", request.strip()).strip())
    if rules:
        plans = [("rules", {"kinds": ["statement"], "outcomes": ["standing"]})]
    else:
        plans = [("decisions", {"kinds": ["statement"]}), ("summaries", {"kinds": ["handoff", "compact_summary", "memory"]}), ("history", {"kinds": ["turn"]})]
        if intent == "rationale":
            plans.reverse()
    order = "newest" if intent == "continue" or not words else "relevance"
    lanes, counts = [], {}
    # Texts are counted once and the scope is asked once; the lanes take their share of what is left.
    query, docs = " ".join(words), store.docs
    parsed, kept = fulltext.parse(query, "any"), []
    rows = replace(base, kinds=[], outcomes=[], order="relevance").where(docs).select("id", "kind", "outcome", "origin", "ts", dates.event_ms(F.col("ts")).alias("ms"))
    try:
        if parsed is not None:
            if store.index:
                ranked = fulltext.bm25_indexed(store.index, parsed)
            else:
                hits = fulltext.counted(docs.select("id", "title", "body"), parsed).drop("title", "body").cache()
                kept.append(hits)
                ranked = fulltext.bm25_counted(hits, parsed)
            meant = store.encoder is not None and store.chunks is not None
            rows = rows.join(ranked.select("id", "rank"), "id", "left" if meant else "inner")
        kept.append(rows.cache())
        for name, extra in plans:
            s = Scope(**({"outcomes": base.outcomes, "include_unclear": base.include_unclear, "include_superseded": True, "tools": True, "order": order} | extra))
            keep = s.where(rows)
            if parsed is None:
                got = keep.select("id", "ms", F.lit(0.0).alias("score"), F.lit(0.0).alias("rank"))
            else:
                got = _fused(store, query, "any", keep.select("id", "ms"), keep.filter("rank is not null").select("id", "ms", "rank"))
            keys = [F.desc("ms"), F.desc("id")] if order == "newest" else [F.desc("score"), F.asc("rank"), F.asc("id")]
            lanes.append(semantic.placed(got.orderBy(*keys).limit(limit + 1), *keys).select("id", "place"))
            counts[name] = got.count()
        seeds = [r["id"] for r in relations.interleave(lanes, limit).orderBy("place", "lane").collect()]
    finally:
        for df in reversed(kept):
            df.unpersist()
    budget = max(500, min(6000, chars // max(2, 2 * max(1, len(seeds)))))
    opened, left = {}, chars
    # Seeds first, then what they rest on and what replaced them, then the turns beside them.
    linked, beside = [], []
    if seeds:
        about = "id bigint, project string, kind string, session_id string, ts string, evidence_ids string, superseded_by bigint"
        held = docs.filter(F.col("id").isin(seeds)).select(*[x.split()[0] for x in about.split(", ")], F.from_json("evidence_ids", "array<bigint>").alias("_ids")).collect()
        seed_rows = docs.sparkSession.createDataFrame([tuple(r)[:-1] for r in held], about)  # at most `limit`
        rests = [x for r in held if r["kind"] == "statement" for x in r["_ids"] or [] if x is not None]
        if rests:
            linked = [r["id"] for r in relations.evidence(docs.filter(F.col("id").isin(rests)), seed_rows).select("id").distinct().orderBy("id").limit(40).collect()]
        linked += sorted({r["superseded_by"] for r in held} - {None})
        sessions = {r["session_id"] for r in held}
        inside = F.col("session_id").isin(sorted(sessions - {None}))
        near = relations.neighbours_of(seed_rows, docs.filter(inside | F.col("session_id").isNull() if None in sessions else inside)).collect()
        nearest = {r["id"]: (r["previous"], r["next"]) for r in near}
        beside = [x for i in seeds for x in nearest.get(i, ()) if x is not None]
    queue = list(dict.fromkeys([*seeds, *linked, *beside]))[:40]
    bodies = {r["id"]: r for r in store.docs.filter(F.col("id").isin(queue)).select("id", "kind", "ts", "title", "body", filters.speaker().alias("speaker")).collect()} if queue else {}
    for i in queue:
        if left < 500:
            break
        r = bodies.get(i)
        if r is not None:
            part = (r["body"] or "")[: min(budget, left)]
            opened[i] = {"id": i, "kind": r["kind"], "ts": r["ts"], "speaker": r["speaker"], "title": r["title"], "text": part, "seed": i in seeds}
            left -= len(part)
    status = "no_matches" if not seeds else "partial" if any(i not in opened for i in queue) else "ready"
    return {"intent": intent, "topic": topic, "interpretation": note, "counts": counts, "records": list(opened.values()), "unopened": [i for i in queue if i not in opened], "evidence_status": status}
