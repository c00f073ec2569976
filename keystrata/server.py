"""A thin HTTP front end over a store: put, get, delete, scan, stats, metrics, key rotation, a page."""

from __future__ import annotations

import argparse
import hmac
import json
import os
import secrets
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote_plus, urlsplit

from keystrata.operators.metrics import Observed
from keystrata.schema import DEFAULT_DATA_DIR, DEFAULT_PORT, LATENCY_BUCKETS_MS
from keystrata.sources.store import Store

PAGE = """<!DOCTYPE html><title>keystrata</title><h1>keystrata</h1>
<form onsubmit="go('put');return false"><input id=k placeholder=key> <input id=v placeholder=value> <input id=a placeholder='API key'>
<button>put</button> <button type=button onclick="go('get')">get</button></form><pre id=o></pre>
<script>async function go(w){const q=new URLSearchParams({key:k.value,...(w=='put'?{value:v.value}:{})});
const r=await fetch('/'+w+'?'+q,{headers:{Authorization:'Bearer '+a.value}});o.textContent=await r.text()}</script>"""
ENDPOINTS = ["/put?key&value[&ttl]", "/get?key", "/delete?key", "/scan?from&to", "/stats", "/metrics", "/auth/rotate", "/ui"]


class Auth:
    """One API key of 64 hexadecimal digits, kept in a file that only its owner reads."""

    def __init__(self, folder: str):
        self.file = Path(folder, "auth.key")
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.key = self.file.read_text().strip() if self.file.exists() else self.rotate()

    def rotate(self) -> str:
        """A new key; the old one is invalid at once."""
        self.key = secrets.token_hex(32)
        with os.fdopen(os.open(self.file, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            f.write(self.key)
        return self.key

    def allows(self, header: str | None) -> bool:
        return bool(header) and header.startswith("Bearer ") and hmac.compare_digest(header[7:].encode(), self.key.encode())


def parameters(query: str) -> dict[str, str]:
    """Decoded parameters; the last of equal names wins, pairs without ``=`` or a name are left out."""
    out = {}
    for pair in query.split("&"):
        name, eq, value = pair.partition("=")
        if eq and name:
            out[unquote_plus(name)] = unquote_plus(value)
    return out


class Api:
    """Requests as plain calls: (path, parameters, authorization) to (status, content type, body, headers)."""

    def __init__(self, store: Store, auth: Auth):
        self.store, self.auth, self.lock = store, auth, threading.Lock()
        self.counters = {"writes_total": 0, "reads_total": 0, "deletes_total": 0}
        self.reads = Observed("read_latency_ms", LATENCY_BUCKETS_MS)

    def _need(self, p: dict[str, str], *names: str) -> list[str]:
        for n in names:
            if not p.get(n, "").strip():
                raise ValueError(f"missing parameter: {n}")
        return [p[n] for n in names]

    def handle(self, path: str, p: dict[str, str], authorization: str | None) -> tuple[int, str, str, dict[str, str]]:
        as_json = lambda status, x: (status, "application/json", json.dumps(x, ensure_ascii=False, separators=(",", ":")), {})
        if path == "/metrics":
            return 200, "text/plain; version=0.0.4", "".join(f"# TYPE {k} counter\n{k} {v}\n" for k, v in (self.counters | self.store.counters).items()) + self.reads.text() + self.store.compactions.text(), {}
        if path == "/ui":
            return 200, "text/html", PAGE, {}
        if path not in ("/put", "/get", "/delete", "/scan", "/stats", "/auth/rotate"):
            return as_json(200, {"endpoints": ENDPOINTS})
        if not self.auth.allows(authorization):
            return *as_json(401, {"error": "unauthorized"})[:3], {"WWW-Authenticate": "Bearer"}
        try:
            if path == "/put":
                key, value = self._need(p, "key", "value")
                ttl = int(p["ttl"]) if "ttl" in p else 0
                with self.lock:
                    self.store.put(key, value.encode(), ttl)
                self.counters["writes_total"] += 1
                return as_json(200, {"status": "ok", "key": key} | ({"ttl_seconds": ttl} if ttl > 0 else {}))
            if path == "/get":
                (key,) = self._need(p, "key")
                self.counters["reads_total"] += 1
                began = time.perf_counter()
                value = self.store.get(key)
                self.reads.add((time.perf_counter() - began) * 1000)
                return as_json(404, {"error": "not found or expired"}) if value is None else as_json(200, {"key": key, "value": value.decode(errors="replace")})
            if path == "/delete":
                (key,) = self._need(p, "key")
                with self.lock:
                    self.store.delete(key)
                self.counters["deletes_total"] += 1
                return as_json(200, {"status": "deleted", "key": key})
            if path == "/scan":
                rows = self.store.scan(*self._need(p, "from", "to"))
                return as_json(200, [{"key": r["key"], "value": bytes(r["value"]).decode(errors="replace")} for r in rows.toLocalIterator()])
            if path == "/stats":
                return as_json(200, {"status": "running"})
            return as_json(200, {"key": self.auth.rotate()})
        except ValueError as e:
            return as_json(400, {"error": str(e)})
        except Exception as e:
            return as_json(500, {"error": str(e)})


def serve(store: Store, auth: Auth, port: int = DEFAULT_PORT) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    api = Api(store, auth)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode() if not url.query else ""
            status, kind, text, headers = api.handle(url.path, parameters(url.query or body), self.headers.get("Authorization"))
            data = text.encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(data)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_POST = do_PUT = do_DELETE = do_GET

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = argparse.ArgumentParser(prog="keystrata")
    args.add_argument("--port", type=int, default=DEFAULT_PORT)
    args.add_argument("--data", default=DEFAULT_DATA_DIR)
    args = args.parse_args(argv)
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    server = serve(Store(spark, os.path.abspath(args.data)), Auth(args.data), args.port)
    try:
        server.serve_forever()
    finally:
        server.server_close()


if __name__ == "__main__":
    main()
