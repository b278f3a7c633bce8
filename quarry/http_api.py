"""The HTTP interface: JSON over the standard library's server, one session behind a lock.

    GET  /api/health  /api/config  /api/presets  /api/sample?n=10
    GET  /api/benchmark/queries  /api/benchmark/cached  /api/live/status  /api/live/sample?n=10
    POST /api/config  /api/query {"sql", "aqp_mode"}  /api/presets/run-all  /api/benchmark/run-all {"runs"}
    POST /api/init/dataset {"rows"}  /api/init/engine (or /api/init/aqe)  /api/init/sqlite {"rows"}  /api/live/start {"rows_per_second"}  /api/live/stop
"""

from __future__ import annotations

import dataclasses
import json
import sqlite3
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from quarry.config import Config
from quarry.errors import EngineError, ParseError
from quarry.functions import workloads
from quarry.session import Session
from quarry.sources import generator
from quarry.streaming import ingest


class Api:
    def __init__(self, session: Session):
        self.session, self.lock = session, threading.RLock()
        self.cached: list | None = None
        self.live = None
        self.other: sqlite3.Connection | None = None

    def answer(self, sql: str, mode: str | None = None) -> dict:
        """The query's dictionary and how many milliseconds it took; mode holds for this statement alone."""
        with self.lock:
            before = self.session.mode
            try:
                if mode:
                    self.session.set_aqp_mode(mode)
                began = time.perf_counter()
                found = self.session.query(sql)
                return found | {"ms": round(1000 * (time.perf_counter() - began), 3)}
            finally:
                self.session.mode = before

    def load_other(self, most: int) -> int:
        """The first `most` rows of the table in key order in an SQLite database in memory, to compare answers with."""
        with self.lock:
            store = self.session.store
            names = store.schema.fieldNames()
            self.other = sqlite3.connect(":memory:", check_same_thread=False)
            self.other.execute(f"CREATE TABLE logs ({', '.join(names)})")
            rows = store.rows().orderBy(store.key).limit(most).toLocalIterator()
            self.other.executemany(f"INSERT INTO logs VALUES ({', '.join('?' * len(names))})", (tuple(r) for r in rows))
            return self.other.execute("SELECT COUNT(*) FROM logs").fetchone()[0]

    def plain(self, sql: str) -> dict:
        """SQLite's rows for the statement, and how many milliseconds they took."""
        with self.lock:
            began = time.perf_counter()
            try:
                rows = self.other.execute(sql).fetchall()
            except sqlite3.Error as e:
                return {"error": str(e)}
            return {"rows": rows, "ms": round(1000 * (time.perf_counter() - began), 3)}

    def configure(self, changes: dict) -> dict:
        """New settings for the same store; rows in its buffer stay."""
        known = {f.name for f in dataclasses.fields(Config)}
        if unknown := set(changes) - known:
            raise ParseError(f"unknown settings: {', '.join(sorted(unknown))}")
        with self.lock:
            config = dataclasses.replace(self.session.config, **changes)
            self.session.config = self.session.store.config = config
            return dataclasses.asdict(config)

    def get(self, path: str, args: dict):
        n = int(args.get("n", ["10"])[0])
        match path:
            case "/api/health":
                m = self.session.store.manifest
                return {"status": "ok", "segments": len(m.segments), "deltas": len(m.deltas), "buffered": len(self.session.store.buffer)}
            case "/api/config":
                return dataclasses.asdict(self.session.config)
            case "/api/presets":
                return [dict(zip(("id", "label", "type", "sql"), p)) for p in workloads.PRESETS]
            case "/api/benchmark/queries":
                return [{"name": a, "category": b, "sql": c} for a, b, c in workloads.BENCHMARKS]
            case "/api/benchmark/cached":
                return self.cached or []
            case "/api/sample" | "/api/live/sample":
                return {"rows": self.session.reservoir_sample(n), "total": self.session.reservoir.total}
            case "/api/live/status":
                progress = self.live.lastProgress if self.live else None
                return {"running": bool(self.live and self.live.isActive), "rows": self.session.reservoir.total, "rows_per_second": progress["processedRowsPerSecond"] if progress else 0.0}
        return None

    def post(self, path: str, body: dict):
        match path:
            case "/api/config":
                return self.configure(body)
            case "/api/query":
                found = self.answer(body.get("sql", ""), body.get("aqp_mode"))
                return found | {"sqlite": self.plain(body["sql"])} if self.other else found
            case "/api/presets/run-all":
                return [{"id": k, "label": label, "kind": kind, "sql": sql} | self.answer(sql) for k, label, kind, sql in workloads.PRESETS]
            case "/api/benchmark/run-all":
                runs = max(1, int(body.get("runs", 1)))
                self.cached = [{"name": a, "category": b, "ms": min(self.answer(c)["ms"] for _ in range(runs))} for a, b, c in workloads.BENCHMARKS]
                return self.cached
            case "/api/init/dataset":
                with self.lock:
                    store = self.session.store
                    return {"rows": store.append(generator.rows(self.session.spark, int(body.get("rows", 100_000)), store.schema, store.config.seed))}
            case "/api/init/sqlite":
                return {"rows": self.load_other(int(body.get("rows", 1_000_000)))}
            case "/api/init/engine" | "/api/init/aqe":
                with self.lock:
                    return {"merged": self.session.store.compact(all_deltas=True)}
            case "/api/live/start":
                if not (self.live and self.live.isActive):
                    store = self.session.store
                    stream = ingest.live(self.session.spark, store, int(body.get("rows_per_second", 100)))
                    self.live = ingest.into(store, stream, f"{store.path}/live-checkpoint", self.session.reservoir).start()
                return {"running": True}
            case "/api/live/stop":
                if self.live:
                    self.live.stop()
                return {"running": False}
        return None


def server(session: Session, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    api = Api(session)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handled(self, act) -> None:
            try:
                found = act()
            except (EngineError, ValueError, TypeError) as e:
                return self.reply(400, {"error": type(e).__name__, "message": str(e)})
            self.reply(404, {"error": "NotFound"}) if found is None else self.reply(200, found)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            self.handled(lambda: api.get(url.path, parse_qs(url.query)))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self.handled(lambda: api.post(urlparse(self.path).path, json.loads(raw or b"{}")))

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
