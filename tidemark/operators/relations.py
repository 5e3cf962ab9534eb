"""Joins and windows over the document table: neighbours, as-of and range joins, evidence, nomination, sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import filters
from tidemark.operators.lifecycle import last_evidence


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, previous, next): the live spoken turns of the same session before and after each."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    return docs.filter(filters.spoken()).select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def neighbours_of(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, previous, next) for rows of any kind: an as-of join on both sides by (ts, id), one pre-ordered union, no pairs.

    Both sides look back, the one for `next` in the reversed order: a frame that ends at the session's end is worked out anew
    for each row, with the square of the session.
    """
    turns = docs.filter(filters.spoken()).select("session_id", "ts", "id", F.lit(0).alias("_a"), F.col("id").alias("_turn"))
    ask = anchors.select("session_id", "ts", "id", F.lit(1).alias("_a"), F.lit(None).cast("bigint").alias("_turn"))
    w = Window.partitionBy("session_id").rowsBetween(Window.unboundedPreceding, -1)
    both = turns.unionByName(ask)
    for name, order in (("previous", F.asc), ("next", F.desc)):
        both = both.withColumn(name, F.last("_turn", True).over(w.orderBy(order("ts"), order("id"), order("_a"))))
    return both.filter("_a = 1").select("id", F.when(F.col("previous") != F.col("id"), F.col("previous")).alias("previous"), F.when(F.col("next") != F.col("id"), F.col("next")).alias("next"))


def turns_before(docs: DataFrame, n: int = 12) -> DataFrame:
    """(id, before): ids of up to n spoken turns before each, oldest first."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(-n, -1)
    return docs.filter(filters.spoken()).select("id", F.collect_list("id").over(w).alias("before"))


def turns_around(anchors: DataFrame, turns: DataFrame, back_ms: int, ahead_ms: int, most: int | None = None) -> DataFrame:
    """(anchor, id): turns (id, project, ms) within [ms - back, ms + ahead] of anchors (anchor, project, ms); the newest `most` of each.

    A range join without a product: time is cut into blocks as long as the window, each anchor looks
    into the blocks its window touches.
    """
    width = back_ms + ahead_ms + 1
    a = anchors.withColumn("_b", F.explode(F.sequence(F.floor((F.col("ms") - back_ms) / width), F.floor((F.col("ms") + ahead_ms) / width))))
    t = turns.select(F.col("id"), F.col("project").alias("_p"), F.col("ms").alias("_ms"), F.floor(F.col("ms") / width).alias("_b"))
    met = a.join(t, (a["_b"] == t["_b"]) & (F.col("project") == F.col("_p"))).filter(F.col("_ms").between(F.col("ms") - back_ms, F.col("ms") + ahead_ms))
    if most is not None:
        w = Window.partitionBy("anchor").orderBy(F.desc("_ms"), F.desc("id"))
        met = met.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return met.select("anchor", "id")


def evidence(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(statement_id, id, ts, place): the rows a statement rests on, of its own project."""
    s = docs if only is None else only
    ids = s.filter("kind = 'statement'").select(F.col("id").alias("statement_id"), F.col("project").alias("_p"), F.explode(F.from_json("evidence_ids", "array<bigint>")).alias("id")).distinct()
    met = ids.join(docs.select("id", "project", "ts"), "id").filter(F.col("project") == F.col("_p"))
    return met.select("statement_id", "id", "ts")


def context_window(docs: DataFrame, anchor: int, before: int, after: int) -> DataFrame:
    """(id, offset): the turns around an anchor in its session, all of them, by place."""
    me = docs.filter(F.col("id") == anchor).select("project", "session_id", F.coalesce("source_client", F.lit("")).alias("_c"))
    turns = docs.filter("kind = 'turn'").withColumn("_c", F.coalesce("source_client", F.lit(""))).join(F.broadcast(me), ["project", "session_id", "_c"], "left_semi")
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    n = turns.select("id", F.row_number().over(w).alias("n"))
    at = n.filter(F.col("id") == anchor).select(F.col("n").alias("at"))
    return n.crossJoin(F.broadcast(at)).select("id", (F.col("n") - F.col("at")).cast("bigint").alias("offset")).filter(F.col("offset").between(-before, after))


# Which outcome of an owner's decision may overturn which.
OVERTURNS = {"rejected": ["approved", "proposed", "completed"], "approved": ["rejected"], "standing": ["standing"]}


#: Newer and older statements that meet in one task, at most.
NEWER, OLDER = 8192, 16384


def nominate(statements: DataFrame, least: float = 0.3, per_newer: int = 3) -> DataFrame:
    """(old_id, new_id, score): older statements that a newer one may replace, by shared title words, at most `per_newer` each.

    Pairs are never rows. Statements are grouped by what may replace what: an overturning outcome with those that it overturns,
    and the sessions of superseded ones. Both sides of a group are dealt to blocks, and every newer block meets every older
    one in a task that counts shared words through its own lists of words (`_block`) and gives its best `per_newer`.
    """
    s = statements.filter("kind = 'statement' and status = 'active' and ts is not null and outcome is not null")
    s = s.select(F.col("id").cast("bigint").alias("id"), "session_id", "ts", "who", "outcome", text.topic_tokens(F.col("title")).alias("w")).filter(F.size("w") > 0)
    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    session = F.concat(F.lit("session "), F.pmod(F.xxhash64("session_id"), F.lit(parts)))  # sessions that share a group don't meet in it
    superseded = F.col("outcome") == "superseded"
    part = lambda group, newer: F.struct(group.alias("g"), F.lit(newer).alias("newer"))
    roles = [F.when(superseded, part(session, False)).otherwise(part(session, True))]
    for new, olds in OVERTURNS.items():
        roles += [F.when((F.col("who") == "owner") & (F.col("outcome") == new), part(F.lit(new), True)), F.when(F.col("outcome").isin(olds), part(F.lit(new), False))]
    s = s.withColumn("_role", F.explode(F.filter(F.array(*roles), lambda r: r.isNotNull()))).select("id", "session_id", "ts", "w", "_role.g", "_role.newer")
    n = s.groupBy("g").agg(F.ceil(F.count_if("newer") / NEWER).alias("_new"), F.ceil(F.count_if(~F.col("newer")) / OLDER).alias("_old")).filter("_new > 0 and _old > 0")  # a few rows
    mine = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks))
    every = lambda blocks: F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)
    s = s.join(F.broadcast(n), "g").withColumn("_nb", F.explode(F.when(F.col("newer"), F.array(mine("_new"))).otherwise(every("_new")))).withColumn("_ob", F.explode(F.when(F.col("newer"), every("_old")).otherwise(F.array(mine("_old")))))
    met = s.select("g", "_nb", "_ob", "newer", "id", "session_id", "ts", "w").groupBy("g", "_nb", "_ob").applyInArrow(_block(least, per_newer), "old_id bigint, new_id bigint, score double")
    w = Window.partitionBy("new_id").orderBy(F.desc("score"), "old_id")
    return met.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_newer).select("old_id", "new_id", "score")


def _block(least: float, per_newer: int):
    """The best older statements of each newer one in a block (newer, id, session_id, ts, w), equal scores by old_id."""
    outcomes = set(OVERTURNS)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        within, apart = key[0].as_py() not in outcomes, key[0].as_py() == "approved"
        lists = t["w"].combine_chunks()
        size, newer, ids = pc.list_value_length(lists).to_numpy(), t["newer"].to_numpy(), t["id"].to_numpy()
        code = lambda x: x.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        word, session = code(lists.flatten()), code(t["session_id"].combine_chunks())
        when = np.unique(np.array(t["ts"].to_pylist(), dtype=object), return_inverse=True)[1]  # str goes by code points, as UTF-8 does
        row, ends = np.repeat(np.arange(len(ids)), size), np.cumsum(size)
        if within:  # a word counts in its own session only
            word = np.unique(session[row] * (word.max() + 1) + word, return_inverse=True)[1]
        old = np.flatnonzero(~newer)
        old = old[np.argsort(ids[old], kind="stable")]
        at = np.full(len(ids), -1)
        at[old] = np.arange(len(old))
        held = np.flatnonzero(at[row] >= 0)
        held = held[np.argsort(word[held], kind="stable")]
        first, place = np.searchsorted(word[held], np.arange(word.max() + 2)), at[row[held]]
        o_id, o_size, o_when, o_session = ids[old], size[old], when[old], session[old]
        # The fewest shared words that reach the score, by the size of the smaller set.
        need = np.array([next(c for c in range(max(0, int(least * m) - 1), m + 2) if c > m or c / m >= least) for m in range(1, size.max() + 1)], dtype=np.int64)
        new = np.flatnonzero(newer)
        out, n = [], 0
        for i in new[np.argsort(size[new], kind="stable")]:
            if n != size[i]:
                n = size[i]
                enough = need[np.minimum(n, o_size) - 1]
            places = np.concatenate([place[first[x] : first[x + 1]] for x in word[ends[i] - n : ends[i]]])
            if not len(places) and least > 0:
                continue
            shared = np.bincount(places, minlength=len(old))
            ok = (shared >= enough) & (o_when < when[i])
            if within:
                ok &= o_session == session[i]
            elif apart:
                ok &= o_session != session[i]
            k = np.flatnonzero(ok)
            k = k[o_id[k] != ids[i]]
            score = shared[k] / np.minimum(n, o_size[k])
            for _ in range(min(per_newer, len(k))):
                b = np.argmax(score)  # the first of equal ones
                out.append((o_id[k[b]], ids[i], score[b]))
                score[b] = -1
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"old_id": pa.array(cols[0], pa.int64()), "new_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def lineage_base(files: DataFrame) -> DataFrame:
    """(path, base_path): a continuation's file and the latest earlier file of the thread it goes on from.

    files: path, thread, base_thread, first_ordinal, cut (ordinal at which it goes on).
    """
    bases = files.select(F.col("path").alias("base_path"), F.col("thread").alias("_t"), F.col("first_ordinal").alias("_o"))
    met = files.filter("base_thread is not null").join(bases, (F.col("base_thread") == F.col("_t")) & (F.col("_o") < F.col("cut")) & (F.col("path") != F.col("base_path")), "left")
    return met.groupBy("path").agg(F.max_by("base_path", F.struct("_o", "base_path")).alias("base_path"))


def covered_sessions(docs: DataFrame) -> DataFrame:
    """(session_id): sessions whose last day has a handoff of the same client (or of none)."""
    last = docs.filter("kind = 'turn' and status = 'active' and session_id is not null").groupBy("session_id").agg(F.max(F.struct("ts", "source_client")).alias("m"))
    last = last.select("session_id", F.substring("m.ts", 1, 10).alias("day"), F.col("m.source_client").alias("client"))
    notes = docs.filter("kind = 'handoff' and status = 'active'").select(F.substring("ts", 1, 10).alias("day"), F.col("source_client").alias("_c")).distinct()
    return last.join(notes, "day").filter(F.col("_c").isNull() | (F.col("_c") == F.col("client"))).select("session_id").distinct()


def twins(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items (session_id, outcome, turn, quote) of which no active or struck statement says the same already, white space and composition aside."""
    known = docs.filter("kind = 'statement' and status in ('active', 'struck')").select("session_id", "outcome", last_evidence().alias("turn"), text.quote_key(F.col("quote")).alias("_q")).filter("_q <> ''")
    return items.withColumn("_q", text.quote_key(F.col("quote"))).join(known, ["session_id", "outcome", "turn", "_q"], "left_anti").drop("_q")


def packed_turns(docs: DataFrame, most: int) -> DataFrame:
    """(session_id, chunk, k, id, n): spoken turns packed in order, a new chunk when the next won't fit.

    The sum starts anew with each chunk, so it is a walk over a session's (ts, id, size) rows, 8 bytes a turn at a time.
    """
    turns = docs.filter(filters.spoken() & F.col("session_id").isNotNull()).select("session_id", "ts", "id", (F.length("body") + 24).alias("n"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"], na_position="first", kind="stable")
        chunk, size, chunks = 0, 0, np.empty(len(pdf), np.int64)
        for i, n in enumerate(pdf["n"].to_numpy()):
            if size and size + n > most:
                chunk, size = chunk + 1, 0
            size += n
            chunks[i] = chunk
        return pd.DataFrame({"session_id": pdf["session_id"].to_numpy(), "chunk": chunks, "k": np.arange(len(pdf)), "id": pdf["id"].to_numpy(), "n": pdf["n"].to_numpy()})

    return turns.groupBy("session_id").applyInPandas(walk, "session_id string, chunk bigint, k bigint, id bigint, n bigint")


def packed_chunks(docs: DataFrame, most: int) -> DataFrame:
    """(session_id, chunk, first_id, last_id, turns, size) of `packed_turns`."""
    return packed_turns(docs, most).groupBy("session_id", "chunk").agg(
        F.min_by("id", "k").alias("first_id"), F.max_by("id", "k").alias("last_id"), F.count("*").alias("turns"), F.sum("n").alias("size")
    )


def presented(docs: DataFrame) -> DataFrame:
    """Statements as they are shown: id, speaker, reported_only, evidence, replacement, quote_kind, authority.

    evidence counts the rows of the own project it rests on; replacement is the own project's row it points to.
    """
    st = docs.filter("kind = 'statement'").select("id", "project", "kind", "role", "source_client", "who", "outcome", "origin", "path", "superseded_by")
    ev = evidence(docs).groupBy("statement_id").agg(F.count("*").alias("_n"))
    rep = docs.select(F.col("id").alias("replacement"), F.col("project").alias("_p"))
    out = st.join(ev, st["id"] == F.col("statement_id"), "left").join(rep, (F.col("superseded_by") == F.col("replacement")) & (st["project"] == F.col("_p")), "left")
    n = F.coalesce("_n", F.lit(0))
    origin, client = F.coalesce("origin", F.lit("")), F.coalesce("source_client", F.lit(""))
    note = (origin == "file") | ((origin == "") & (client == "") & F.coalesce(F.lower("path").endswith(".md"), F.lit(False)) & (n == 0))
    recorded = F.when(F.coalesce(F.col("path").startswith("decide:"), F.lit(False)), "recorded in session").otherwise("extracted later")
    rests = F.when(n > 0, "interpretation of linked conversation").otherwise("no linked conversation evidence available")
    return out.select(
        "id", filters.speaker().alias("speaker"), (~F.col("who").eqNullSafe(F.lit("owner")) & F.col("outcome").eqNullSafe(F.lit("completed"))).alias("reported_only"), n.alias("evidence"), "replacement",
        F.when(note, "memory-note-excerpt").otherwise("recorded-conversation-quote").alias("quote_kind"),
        F.when(note, "imported memory-note summary; excerpt is not a verified owner quotation; no linked conversation evidence").otherwise(F.concat(recorded, F.lit("; "), rests)).alias("authority"),
    )


def interleave(lanes: list[DataFrame], limit: int) -> DataFrame:
    """(id, lane, place): lanes (id, place from 0) taken in turn; a row's first appearance counts."""
    out = None
    for n, df in enumerate(lanes):
        df = df.select("id", F.lit(n).alias("lane"), F.col("place"))
        out = df if out is None else out.unionByName(df)
    first = out.groupBy("id").agg(F.min(F.struct("place", "lane")).alias("m")).select("id", "m.lane", "m.place")
    return first.orderBy("place", "lane").limit(limit)


def without_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of a session that is not among the given ones (session_id); rows without a session are left out, as NOT IN does."""
    return rows.filter("session_id is not null").join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def recent_unread(docs: DataFrame, ledger: DataFrame | None, now_ms: int, days: int = 7) -> DataFrame:
    """Spoken turns of the last days in sessions that no run has read."""
    from tidemark.functions import dates

    ms = dates.event_ms(F.col("ts"))
    rows = docs.filter(filters.spoken() & (ms >= now_ms - days * 86_400_000) & (ms <= now_ms))
    return rows if ledger is None else without_sessions(rows, ledger)


def attributed_sources(sources: DataFrame, docs: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """File records that belong here: some row names the path, or a binding (sha) names the file."""
    by_path = sources.join(docs.select("path"), "path", "left_semi")
    if bindings is None:
        return by_path
    return by_path.unionByName(sources.join(bindings.select("sha"), "sha", "left_semi")).dropDuplicates(["path"])


def questions_of(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(answer_id, question_id): the row that holds an answer's question, found by the hash it was stored under."""
    key = answers.select(F.col("id").alias("answer_id"), F.sha2(F.concat("sha", F.lit("|question")), 256).alias("sha"))
    return key.join(docs.select("sha", F.col("id").alias("question_id")), "sha").select("answer_id", "question_id")


def context_before_chunks(docs: DataFrame, chunks: DataFrame, n: int = 4) -> DataFrame:
    """(session_id, chunk, context): ids of up to n spoken turns before each packed chunk, oldest first."""
    return chunks.join(turns_before(docs, n), F.col("first_id") == F.col("id")).select("session_id", "chunk", F.col("before").alias("context"))
