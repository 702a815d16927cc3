"""The engine over HTTP: POST /query with {"query": ...} or {"table": ..., "rows": [...]}, GET /health and /stats."""

from __future__ import annotations

import argparse
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .session import Engine

# Fixed values of the interface: the port, the paths, the envelope of an answer and the CORS headers.
PORT = 1337
PATHS = {"query": "/query", "health": "/health", "stats": "/stats"}
CORS = (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type"))

#: Bytes of a request at most.
MOST_BYTES = 200 << 20


def envelope(data: object = "", error: str = "") -> dict:
    return {"success": not error, "data": data, "error": error}


def serve(engine: Engine, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever() on it."""
    began = time.time()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: object) -> None:
            pass

        def answer(self, status: int, body: dict | None = None) -> None:
            data = json.dumps(body).encode() if body is not None else b""
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), *CORS):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self.answer(204)

        def do_GET(self) -> None:
            if self.path == PATHS["health"]:
                self.answer(200, {"status": "ok", "uptime_s": round(time.time() - began, 1)})
            elif self.path == PATHS["stats"]:
                self.answer(200, envelope(engine.stats()))
            else:
                self.answer(404, envelope(error="not found"))

        def do_POST(self) -> None:
            if self.path != PATHS["query"]:
                return self.answer(404, envelope(error="not found"))
            n = int(self.headers.get("Content-Length") or 0)
            if n > MOST_BYTES:
                self.close_connection = True
                return self.answer(413, envelope(error="the body is too large"))
            try:
                asked = json.loads(self.rfile.read(n))
                if "query" in asked:
                    data = engine.to_json(asked["query"])
                elif "table" in asked and "rows" in asked:
                    data = json.dumps({"inserted": engine.insert_rows(asked["table"], asked["rows"])})
                else:
                    raise ValueError("query, or table and rows, expected")
            except (ValueError, KeyError, TypeError) as e:
                return self.answer(400, envelope(error=str(e) or type(e).__name__))
            self.answer(200, envelope(data))

    return ThreadingHTTPServer((host, port), Handler)


def options(args: list[str] | None = None) -> argparse.Namespace:
    """--durable: tables must outlive the server, so a root is needed (every change there is on disk before it is
    answered); --memory: they needn't, and what has been read stays in memory. Without either a root makes the difference."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", help="folder of the tables; without it they end with the server")
    p.add_argument("--port", type=int, default=PORT)
    p.add_argument("--host", default="127.0.0.1")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--durable", action="store_true", help="refuse to start without --root")
    mode.add_argument("--memory", action="store_true", help="tables end with the server and are cached in memory")
    found = p.parse_args(args)
    if found.durable and not found.root:
        p.error("--durable needs --root")
    if found.memory and found.root:
        p.error("--memory keeps nothing, so it takes no --root")
    return found


def main() -> None:
    from pyspark.sql import SparkSession

    args = options()
    engine = Engine(SparkSession.builder.appName("brookwell").getOrCreate(), args.root, args.memory)
    try:
        serve(engine, args.port, args.host).serve_forever()
    finally:
        engine.close()


if __name__ == "__main__":
    main()
