"""Jobs in threads: one writer a data set, the same content once, events in order, cancelled at the next stage."""

from __future__ import annotations

import re
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any


class Cancelled(Exception):
    pass


#: Paths of the server don't leave it.
_PATH = re.compile(r"(?:file:|hdfs:|s3a?:)?/{1,3}(?:[\w.+=@%-]+/)+[\w.+=@%-]*")


def redacted(text: str) -> str:
    return _PATH.sub("<path>", text)


@dataclass
class Job:
    id: str
    dataset: str
    state: str = "queued"  # running, done, failed, cancelled
    events: list[str] = field(default_factory=list)
    result: Any = None
    error: str = ""
    stop: threading.Event = field(default_factory=threading.Event)
    over: threading.Event = field(default_factory=threading.Event)

    def view(self) -> dict[str, Any]:
        return {"id": self.id, "dataset": self.dataset, "state": self.state, "events": list(self.events), "error": self.error}


class Jobs:
    def __init__(self, workers: int = 4):
        self.pool = ThreadPoolExecutor(workers)
        self.jobs: dict[str, Job] = {}
        self.known: dict[str, str] = {}
        self.locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)
        self.guard = threading.Lock()

    def submit(self, dataset: str, work: Callable[[Callable[[str], None]], Any], key: str | None = None) -> Job:
        """Runs `work`, which gets a function to tell its stages by; the same key gives the same job unless that failed."""
        with self.guard:
            if key and (old := self.jobs.get(self.known.get(key, ""))) and old.state not in ("failed", "cancelled"):
                return old
            job = Job(uuid.uuid4().hex, dataset)
            self.jobs[job.id] = job
            if key:
                self.known[key] = job.id
        self.pool.submit(self._run, job, work)
        return job

    def _run(self, job: Job, work: Callable[[Callable[[str], None]], Any]) -> None:
        def tell(stage: str) -> None:
            if job.stop.is_set():
                raise Cancelled
            job.events.append(stage)

        try:
            with self.locks[job.dataset]:
                tell("started")
                job.state = "running"
                job.result = work(tell)
                job.state = "done"
        except Cancelled:
            job.state = "cancelled"
        except Exception as e:  # noqa: BLE001
            job.state, job.error = "failed", redacted(str(e).split("\n")[0])
        finally:
            job.events.append(job.state)
            job.over.set()

    def cancel(self, job: str) -> None:
        self.jobs[job].stop.set()
