"""The engine as tools of the Model Context Protocol: JSON-RPC over lines of standard input and output, or messages handed in by another transport."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from urllib.parse import unquote

from .facade import Engine
from .plans.querylang import QueryError

# The version of the protocol, and how a document is named.
PROTOCOL, RESOURCE = "2024-11-05", "folioscan://document/"
TEXT, NUMBER, FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def _object(required: tuple[str, ...] = (), **properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


class Tools:
    """What a client may ask of an engine; every answer is plain data, every fault an answer that says so."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.known: dict[str, tuple[str, dict, Callable[..., object]]] = {
            "search_documents": ("Search the indexed documents.", _object(("query",), query=TEXT, formats={"type": "array", "items": TEXT}, limit=NUMBER, cursor=TEXT, search_mode={"enum": ["literal", "expanded", "hybrid"]}, match_case=FLAG, whole_word=FLAG, regex=FLAG), engine.search),
            "get_index_status": ("What is indexed.", _object(), engine.index_status),
            "reindex_directory": ("Compare the folders, or one inside them, with the index.", _object((), folder=TEXT), lambda folder=None: {"started": engine.start_reindex(folder)}),
            "get_match_locations": ("Where a query stands in a document.", _object(("query", "doc_id"), query=TEXT, doc_id=NUMBER, offset=NUMBER, limit=NUMBER, revision=NUMBER), engine.match_locations),
            "get_match_context": ("The text around a location.", _object(("segment_row_id", "start", "end"), segment_row_id=NUMBER, start=NUMBER, end=NUMBER, context=NUMBER, full=FLAG, offset=NUMBER, limit=NUMBER), engine.match_context),
            "get_problem_documents": ("Documents that were not read well.", _object((), offset=NUMBER, limit=NUMBER), engine.problem_documents),
            "reprocess_documents": ("Read files again.", _object((), paths={"type": "array", "items": TEXT}), lambda paths=None: engine.start_reprocess(paths)),
        }

    def call(self, name: str, given: dict) -> dict:
        if name not in self.known:
            return self._said({"error": "unknown_tool"}, True)
        _, shape, run = self.known[name]
        if not isinstance(given, dict) or set(given) - set(shape["properties"]) or set(shape["required"]) - set(given):
            return self._said({"error": "arguments"}, True)
        try:
            return self._said(run(**given))
        except QueryError as e:
            return self._said({"error": e.code}, True)
        except ValueError as e:
            return self._said({"error": "value", "message": str(e)}, True)

    @staticmethod
    def _said(data, wrong: bool = False) -> dict:
        return {"content": [{"type": "text", "text": json.dumps(data, ensure_ascii=False, default=str)}], "isError": wrong}

    def answer(self, message: dict) -> dict | None:
        """The answer to one message; none to a notification."""
        kind, given, number = message.get("method"), message.get("params") or {}, message.get("id")
        if number is None:
            return None
        out = {"jsonrpc": "2.0", "id": number}
        if kind == "initialize":
            return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "folioscan", "version": "1"}}}
        if kind == "ping":
            return out | {"result": {}}
        if kind == "tools/list":
            return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.known.items()]}}
        if kind == "tools/call":
            return out | {"result": self.call(given.get("name", ""), given.get("arguments") or {})}
        if kind == "resources/templates/list":
            return out | {"result": {"resourceTemplates": [{"uriTemplate": RESOURCE + "{path}", "name": "document", "mimeType": "text/markdown"}]}}
        if kind == "resources/read":
            uri = str(given.get("uri", ""))
            text = self.engine.document_text(unquote(uri[len(RESOURCE) :])) if uri.startswith(RESOURCE) else None
            if text is None:
                return out | {"error": {"code": -32002, "message": "no such document"}}
            return out | {"result": {"contents": [{"uri": uri, "mimeType": "text/markdown", "text": text}]}}
        return out | {"error": {"code": -32601, "message": "unknown method"}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout) -> None:
    """Answer messages line by line until the input ends."""
    tools = Tools(engine)
    for line in lines:
        if not line.strip():
            continue
        try:
            said = tools.answer(json.loads(line))
        except json.JSONDecodeError:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if said is not None:
            print(json.dumps(said, ensure_ascii=False), file=out, flush=True)
