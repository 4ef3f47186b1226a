"""HTTP requests as a source and a sink: POST /request answers with a row for each row of its payload.

Requests that wait together are answered by one Spark job over all their rows.
"""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Pending:
    def __init__(self, rows: list[dict]):
        self.rows, self.done, self.answer, self.failed = rows, threading.Event(), [], False


class RequestServer:
    """Serves ``answer``: requests of ``schema`` plus _request and _row in, the same rows with features out.

    429 beyond ``max_pending`` waiting requests, 400 for another shape, 408
    after ``timeout_s``, 500 where a job failed or lost rows.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, answer: Callable[[DataFrame], DataFrame], port: int = 0, max_pending: int = 100, timeout_s: float = 5.0):
        self.spark, self.schema, self.answer = spark, schema, answer
        self.max_pending, self.timeout_s = max_pending, timeout_s
        self.waiting: deque[_Pending] = deque()
        self.lock, self.stopping = threading.Lock(), False
        server = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def do_POST(self) -> None:
                size = int(self.headers.get("Content-Length", 0))
                status, body = server.handle(self.path, self.rfile.read(size))
                payload = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(payload)))
                self.end_headers()
                self.wfile.write(payload)

        self.http = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.http.server_address[1]
        self.threads = [threading.Thread(target=f, daemon=True) for f in (self.http.serve_forever, self._work)]

    def start(self) -> RequestServer:
        for t in self.threads:
            t.start()
        return self

    def stop(self) -> None:
        self.stopping = True
        self.http.shutdown()
        self.http.server_close()

    def handle(self, path: str, body: bytes) -> tuple[int, dict]:
        if path != "/request":
            return 404, {"error": "not found"}
        try:
            rows = json.loads(body)["data"]["payload"]
            if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
                raise ValueError
            self._typed(rows, 0)
        except (ValueError, KeyError, TypeError):
            return 400, {"error": "expected {\"data\": {\"payload\": [{...}]}} of the declared columns"}
        pending = _Pending(rows)
        with self.lock:
            if len(self.waiting) >= self.max_pending:
                return 429, {"error": "too many requests are waiting"}
            self.waiting.append(pending)
        if not pending.done.wait(self.timeout_s):
            return 408, {"error": "timed out"}
        return (500, {"error": "no answer"}) if pending.failed else (200, {"data": pending.answer})

    def _typed(self, rows: list[dict], request: int) -> list[tuple]:
        out = []
        for n, r in enumerate(rows):
            values = []
            for f in self.schema:
                v = r.get(f.name)
                if v is None and not f.nullable:
                    raise ValueError(f.name)
                if v is not None and isinstance(f.dataType, T.DoubleType):
                    v = float(v)
                elif v is not None and isinstance(f.dataType, (T.LongType, T.IntegerType)) and (isinstance(v, bool) or not isinstance(v, int)):
                    raise ValueError(f.name)
                elif v is not None and isinstance(f.dataType, T.StringType) and not isinstance(v, str):
                    raise ValueError(f.name)
                values.append(v)
            out.append((*values, request, n))
        return out

    def _work(self) -> None:
        wide = T.StructType([*self.schema.fields, T.StructField("_request", T.LongType()), T.StructField("_row", T.LongType())])
        while not self.stopping:
            with self.lock:
                batch = [self.waiting.popleft() for _ in range(len(self.waiting))]
            if not batch:
                time.sleep(0.005)
                continue
            try:
                rows = [r for k, p in enumerate(batch) for r in self._typed(p.rows, k)]
                out = self.answer(self.spark.createDataFrame(rows, wide))
                shown = [c for c in out.columns if c not in ("_request", "_row")]
                for r in out.select("_request", "_row", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("j")).orderBy("_request", "_row").collect():
                    batch[r["_request"]].answer.append(json.loads(r["j"]))
                for p in batch:
                    p.failed = len(p.answer) != len(p.rows)
            except Exception:  # a failed job answers 500; the server goes on
                for p in batch:
                    p.failed = True
            for p in batch:
                p.done.set()
