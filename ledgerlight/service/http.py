"""HTTP over the standard library: upload, jobs with their events, data sets, queries."""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
import shutil
import tempfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from ledgerlight.plans.execute import ask
from ledgerlight.plans.interpret import interpret
from ledgerlight.plans.propose import Missing
from ledgerlight.plans.query import Query, merge
from ledgerlight.plans.verdict import Verdict
from ledgerlight.service.jobs import Jobs, redacted
from ledgerlight.sources import samples
from ledgerlight.sources.files import load
from ledgerlight.sources.store import Store
from ledgerlight.sources.tables import local

#: Largest upload in bytes.
UPLOAD = 500 * 1024 * 1024


class BadUpload(ValueError):
    """An upload without a file; `kind` says why."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def uploaded(kind: str, body: bytes) -> bytes:
    """The file of an upload: the body, or the first part with a file name of one in parts."""
    if kind.lower().startswith("multipart/form-data"):
        whole = email.message_from_bytes(f"Content-Type: {kind}\r\n\r\n".encode() + body, policy=email.policy.HTTP)
        part = next((p for p in whole.walk() if p.get_filename() is not None), None)
        if part is None:
            raise BadUpload("no_file_part", "None of the parts is a file")
        return part.get_payload(decode=True) or b""
    if body[:64].lstrip().startswith(b"--") and b"Content-Disposition" in body[:400]:
        raise BadUpload("looks_like_multipart", "The body is in parts, but its type isn't multipart/form-data")
    return body


def _uploads(store: Store, uploads: str | None) -> Path:
    if not uploads:
        if not local(store.spark):
            raise ValueError("uploads need a folder that all executors share")
        uploads = tempfile.mkdtemp(prefix="uploads-")
    return Path(uploads.removeprefix("file://"))


def serve(store: Store, host: str = "127.0.0.1", port: int = 8000, uploads: str | None = None, provider: Callable[[dict], Any] | None = None, max_upload: int = UPLOAD, min_free: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet. Uploads go to a folder that all executors can read, on a disk of which `min_free`
    bytes stay free. With a provider, queries may be questions in words, and it proposes the roles of columns."""
    jobs, folder = Jobs(), _uploads(store, uploads)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_args) -> None:
            pass

        def _send(self, code: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _fail(self, code: int, kind: str, text: str) -> None:
            self._send(code, {"error": {"kind": kind, "message": redacted(text)}})

        def do_GET(self) -> None:
            parts = self.path.strip("/").split("/")
            if parts == ["health"]:
                self._send(200, {"status": "ok"})
            elif parts == ["datasets"]:
                self._send(200, store.ids())
            elif parts == ["samples"]:
                self._send(200, samples.names())
            elif parts[0] == "samples" and parts[2:] == ["download"] and parts[1] in samples.names():
                data = samples.content(parts[1])
                self.send_response(200)
                self.send_header("Content-Type", "text/csv; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
            elif parts[0] == "datasets" and len(parts) == 2 and parts[1] in store.ids():
                self._send(200, json.loads(store.get(parts[1]).model.to_json()))
            elif parts[0] == "jobs" and len(parts) > 1 and parts[1] in jobs.jobs:
                job = jobs.jobs[parts[1]]
                if parts[2:] == ["stream"]:
                    self.send_response(200)
                    self.send_header("Content-Type", "text/event-stream")
                    self.end_headers()
                    sent = 0
                    while True:
                        over = job.over.wait(0.2)
                        for e in job.events[sent:]:
                            self.wfile.write(f"id: {sent}\ndata: {json.dumps(e)}\n\n".encode())
                            sent += 1
                        if over and sent >= len(job.events):
                            return
                self._send(200, job.view() | ({"result": job.result} if job.state == "done" else {}))
            else:
                self._fail(404, "not_found", "There is nothing here")

        def do_POST(self) -> None:
            parts = self.path.strip("/").split("/")
            size = int(self.headers.get("Content-Length", 0))
            if size > max_upload:
                return self._fail(413, "too_large", f"Uploads end at {max_upload} bytes")
            if parts == ["datasets"] and shutil.disk_usage(folder).free - size < min_free:
                return self._fail(507, "no_space", "There is no room for this upload")
            body = self.rfile.read(size)
            if parts[0] == "samples" and len(parts) == 2:
                if parts[1] not in samples.names():
                    return self._fail(404, "not_found", "There is no such sample")
                parts, body = ["datasets"], samples.content(parts[1])
            elif parts == ["datasets"]:
                try:
                    body = uploaded(self.headers.get("Content-Type", ""), body)
                except BadUpload as e:
                    return self._fail(400, e.kind, str(e))
            if parts == ["datasets"]:
                if not body:
                    return self._fail(400, "empty", "The upload is empty")
                key = self.headers.get("Idempotency-Key") or hashlib.sha256(body).hexdigest()
                name = hashlib.sha256(key.encode()).hexdigest()[:16]
                at = folder / f"{name}.csv"
                at.write_bytes(body)

                def ingest(tell) -> dict:
                    tell("reading")
                    return {"dataset": name, "rows": store.put(name, load(store.spark, str(at)), provider=provider, at=tell).model.row_count}

                return self._send(202, jobs.submit(name, ingest, key).view())
            if parts[0] == "jobs" and parts[2:] == ["cancel"] and parts[1] in jobs.jobs:
                jobs.cancel(parts[1])
                return self._send(202, jobs.jobs[parts[1]].view())
            if parts[0] == "datasets" and parts[2:] == ["query"] and parts[1] in store.ids():
                try:
                    raw = json.loads(body)
                    before, old = raw.pop("previous_job_id", None), None
                    if before is not None:
                        job = jobs.jobs.get(before)
                        if job is None or job.state != "done" or job.dataset != parts[1] or "query" not in (job.result or {}):
                            return self._fail(409, "no_such_query", "The earlier query can't be followed up")
                        old = Query.of(job.result["query"])
                    question = raw.pop("question", None)
                    if question is not None and provider is None:
                        return self._fail(400, "no_provider", "Questions in words need a provider")
                    if question is not None:
                        query = interpret(question, store.get(parts[1]).model, provider, old)
                    else:
                        query = merge(old, raw) if old else Query.of(raw)
                except Missing:
                    return self._fail(400, "no_answer", "The provider has no answer to this question")
                except (TypeError, ValueError, KeyError) as e:
                    return self._fail(400, "bad_query", str(e))

                def answer(tell) -> dict:
                    tell("executing")
                    data = store.get(parts[1])
                    out = ask(data.rows, data.model, query)
                    return {"query": query.to_dict(), "verdict": out.kind} | ({"reason": out.reason, "options": out.options} if isinstance(out, Verdict) else {"answer": out.to_dict()})

                return self._send(202, jobs.submit(parts[1], answer).view())
            return self._fail(404, "not_found", "There is nothing here")

    return ThreadingHTTPServer((host, port), Handler)


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from ledgerlight.settings import provider_of, settings

    s = settings(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    serve(Store(spark, s.root), s.host, s.port, s.uploads, provider_of(s), s.max_upload, s.min_free).serve_forever()


if __name__ == "__main__":
    main()
