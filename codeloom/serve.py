"""Tools for agents: JSON-RPC 2.0 requests, a line each, on one stream, and their answers on another.

The methods ``initialize``, ``tools/list``, ``tools/call`` and ``ping`` are those of the public Model Context Protocol.
``explore`` is always there; ``status``, ``reindex`` and ``debug_graph`` are served only if they are asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from codeloom import __version__
from codeloom.plans.engine import Engine

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
TOOLS = {
    "explore": ("Symbols, call paths and blast radius of a query.", {"query": _TEXT, "task": {"enum": ["understand", "impact", "locate", "debug"]}, "max_tokens": {"type": "integer"}, "depth": {"type": "integer"}, "min_confidence": _NUMBER}, ["query"]),
    "status": ("Counts of the index, and whether it is fresh.", {}, []),
    "reindex": ("Build the index anew.", {}, []),
    "debug_graph": ("All nodes, edges and open references of a symbol.", {"symbol": _TEXT}, ["symbol"]),
}


class Server:
    def __init__(self, engine: Engine, tools: list[str], root: str | None = None):
        self.root, self.names = root, [t for t in TOOLS if t == "explore" or t in tools]
        self.calls: dict[str, Callable[..., dict]] = {
            "explore": lambda **k: engine.explore(**k, root=root),
            "status": lambda: engine.status(root),
            "reindex": lambda: engine.build(root) if root else {"error": "no_root", "hint": "serve with --root"},
            "debug_graph": engine.debug_graph,
        }

    def answer(self, request: dict) -> dict | None:
        """The response to a request; None to a notification."""
        if not isinstance(request, dict) or "id" not in request:
            return None
        method, params = request.get("method"), request.get("params") or {}
        out = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": __version__}}}
        if method == "ping":
            return out | {"result": {}}
        if method == "tools/list":
            tools = [{"name": n, "description": TOOLS[n][0], "inputSchema": {"type": "object", "properties": TOOLS[n][1], "required": TOOLS[n][2]}} for n in self.names]
            return out | {"result": {"tools": tools}}
        if method != "tools/call":
            return out | {"error": {"code": -32601, "message": f"unknown method {method}"}}
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in self.names:
            return out | {"error": {"code": -32602, "message": f"unknown tool {name}"}}
        wrong = sorted(set(given) - set(TOOLS[name][1])) + [f"missing {k}" for k in TOOLS[name][2] if k not in given]
        if wrong:
            return out | {"error": {"code": -32602, "message": f"arguments of {name}: {', '.join(wrong)}"}}
        try:
            found, failed = self.calls[name](**given), False
        except Exception as e:  # a tool that fails says so, and the server goes on
            found, failed = {"error": type(e).__name__, "hint": str(e)[:500]}, True
        return out | {"result": {"content": [{"type": "text", "text": json.dumps(found, default=str)}], "isError": failed}}


def serve(engine: Engine, tools: list[str], root: str | None, requests: TextIO, responses: TextIO) -> None:
    server = Server(engine, tools, root)
    for line in requests:
        if not line.strip():
            continue
        try:
            out = server.answer(json.loads(line))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if out is not None:
            responses.write(json.dumps(out) + "\n")
            responses.flush()
