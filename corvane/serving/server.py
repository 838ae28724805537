"""JSON-RPC 2.0 over lines of standard input and output, with the tools as its calls."""

from __future__ import annotations

import json
import math
import sys
from typing import Any, TextIO

from corvane.engine import Engine
from corvane.serving.tools import TOOLS, call_tool

PROTOCOL_VERSION = "2024-11-05"
SERVER = {"name": "corvane", "version": "0.1.0"}
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
METHODS = ("initialize", "ping", "tools/list", "tools/call")


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _error(id_: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def _valid_id(id_: Any) -> bool:
    return id_ is None or isinstance(id_, str) or isinstance(id_, (int, float)) and not isinstance(id_, bool) and math.isfinite(id_)


def _check_params(method: str, msg: dict) -> None:
    given, params = "params" in msg, msg.get("params")
    if method not in METHODS:
        return
    if method == "tools/call" and not given:
        raise RpcError(INVALID_PARAMS, "tools/call comes without its params")
    if given and not isinstance(params, dict):
        raise RpcError(INVALID_PARAMS, f"the params of {method} are no object")
    if method == "tools/call":
        if not isinstance(params.get("name"), str):
            raise RpcError(INVALID_PARAMS, "the tool's name must be a string")
        if "arguments" in params and not isinstance(params["arguments"], dict):
            raise RpcError(INVALID_PARAMS, "the tool's arguments are no object")


def _dispatch(method: str, params: dict, engine: Engine) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL_VERSION, "serverInfo": SERVER, "capabilities": {"tools": {}}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": TOOLS}
    if method == "tools/call":
        return {"content": [{"type": "text", "text": call_tool(params["name"], params.get("arguments"), engine)}]}
    raise RpcError(METHOD_NOT_FOUND, f"no such method here: {method}")


def handle(line: str, engine: Engine) -> dict | None:
    """The reply to one line; None for blank lines, notifications and replies of the client."""
    if not line.strip():
        return None
    try:
        msg = json.loads(line)
    except ValueError:
        return _error(None, PARSE_ERROR, "not a line of JSON")
    if not isinstance(msg, dict) or msg.get("jsonrpc") != "2.0":
        return _error(None, INVALID_REQUEST, "not a JSON-RPC 2.0 request")
    if "method" not in msg and ("result" in msg or "error" in msg):
        return None
    if not isinstance(msg.get("method"), str) or "id" in msg and not _valid_id(msg["id"]):
        return _error(None, INVALID_REQUEST, "not a JSON-RPC 2.0 request")
    if "id" not in msg:
        return None
    try:
        _check_params(msg["method"], msg)
        return {"jsonrpc": "2.0", "id": msg["id"], "result": _dispatch(msg["method"], msg.get("params") or {}, engine)}
    except RpcError as e:
        return _error(msg["id"], e.code, str(e))
    except Exception as e:  # noqa: BLE001 - whatever a tool raises is the client's answer
        return _error(msg["id"], INTERNAL, str(e))


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer until the input ends or nobody reads the output."""
    try:
        engine.build_if_missing()
    except Exception as e:  # noqa: BLE001 - the server starts without an index
        print(f"corvane: starting without an index: {e}", file=sys.stderr)
    for line in source:
        reply = handle(line, engine)
        if reply is None:
            continue
        try:
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)
        except BrokenPipeError:
            return
