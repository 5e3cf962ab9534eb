"""One dispatcher over the top-level operations, as text, JSON or JSON-RPC lines."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import fields

from tidemark.functions import dates
from tidemark.operators.filters import Scope
from tidemark.plans import search

_SCOPE = {f.name for f in fields(Scope)}
_DATES = {"on", "since", "until", "before", "after"}
OPERATIONS = {
    "find": {"query", "mode", "limit", "cursor", "chars"}, "read": {"id", "offset", "chars", "before_turns", "after_turns", "session", "page", "size", "newest"},
    "inventory": {"what", "page", "size"}, "recall": {"request", "limit", "chars"},
}


def execute(store: search.Store, op: str, args: dict) -> dict | list:
    """Run one operation; unknown operations and arguments are errors."""
    if op not in OPERATIONS:
        raise ValueError(f"no such operation: {op}")
    scoped = op in ("find", "recall")
    allowed = OPERATIONS[op] | ((_SCOPE | _DATES | {"timezone"}) if scoped else set())
    if bad := sorted(set(args) - allowed):
        raise ValueError(f"{op} does not take {bad[0]}")
    scope = None
    if scoped:
        given = {k: args[k] for k in _SCOPE & set(args)}
        bounds = {k: args[k] for k in _DATES & set(args)}
        if bounds:
            given["lo"], given["hi"] = dates.date_range(args.get("timezone", store.timezone), store.now_ms, **bounds)
        scope = Scope(**given)
    rest = {k: v for k, v in args.items() if k in OPERATIONS[op]}
    if op == "find":
        return search.find(store, scope=scope, **rest)
    if op == "recall":
        return search.recall(store, scope=scope, **rest)
    if op == "inventory":
        return search.overview(store, **rest)
    if ("id" in rest) == ("session" in rest):
        raise ValueError("read takes an id or a session")
    if "session" in rest:
        return search.read_session(store, **{k: v for k, v in rest.items() if k in ("session", "page", "size", "newest")})
    return search.read(store, rest["id"], rest.get("offset", 0), rest.get("chars", 6000), rest.get("before_turns", 0), rest.get("after_turns", 0))


def render(result: dict | list) -> str:
    """A result as text for a terminal."""
    if isinstance(result, list):
        return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in result)
    if "rows" in result or "records" in result:
        rows = result.get("rows", result.get("records"))
        lines = [f"#{r['id']} {(r['ts'] or '')[:10]} {r['kind']} {r['speaker'] or '-'}: {r['title'] or ''}" + ("\n    " + r["text"].replace("\n", "\n    ") if r["text"] else "") for r in rows]
        lines.append(f"Continue with cursor: {result['next']}" if result.get("next") else "End of these results.")
        return "\n".join(lines)
    return str(result.get("text", json.dumps(result, default=str)))


def serve(store: search.Store, lines: Iterable[str]) -> Iterator[str]:
    """JSON-RPC over lines: initialize, tools/list, tools/call."""
    for line in lines:
        if not line.strip():
            continue
        number = None
        try:
            m = json.loads(line)
            number = m.get("id")
            if m.get("method") == "initialize":
                out = {"protocolVersion": m.get("params", {}).get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tidemark", "version": "1"}}
            elif m.get("method") == "tools/list":
                out = {"tools": [{"name": k, "inputSchema": {"type": "object", "properties": {a: {} for a in sorted(v)}}} for k, v in OPERATIONS.items()]}
            elif m.get("method") == "tools/call":
                out = {"content": [{"type": "text", "text": json.dumps(execute(store, m["params"]["name"], m["params"].get("arguments", {})), ensure_ascii=False, default=str)}]}
            elif number is None:
                continue  # a notification
            else:
                raise LookupError(f"no such method: {m.get('method')}")
            yield json.dumps({"jsonrpc": "2.0", "id": number, "result": out}, ensure_ascii=False)
        except Exception as e:
            code = -32601 if isinstance(e, LookupError) else -32602 if isinstance(e, ValueError) else -32603
            yield json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": str(e)[:500]}})
