"""A work queue of files for a handful of workers, delivered at least once.

A job is a file in the queue's folder; its name orders it. Taking a job moves its file to the folder
of the worker, which is atomic in the file system, so no two workers hold one job; acknowledging
removes it. What a dead worker held can be put back. Bulk work goes through ``streaming.jobs``.
"""

from __future__ import annotations

import re
import time
from uuid import uuid4

from pyspark.sql import SparkSession


def queue_name(*parts: str) -> str:
    """Name of a queue, parts joined by colons; ValueError for an empty or unsafe part."""
    for part in parts:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", part) or set(part) == {"."}:
            raise ValueError(f"no name of a queue: {part!r}")
    return ":".join(parts)


def errors_name(name: str) -> str:
    """Name of the queue of a queue's failed jobs."""
    return f"{name}:errors"


class WorkQueue:
    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.name, self.root, self._spark = name, root, spark
        self.folder = f"{root}/{name.replace(':', '/')}/waiting"
        self._system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._system.mkdirs(self._path(self.folder))

    def _held(self, worker: str) -> str:
        return f"{self.root}/{self.name.replace(':', '/')}/held/{queue_name(worker)}"

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._system.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(path) if s.isFile() and s.getPath().getName().endswith(".job"))

    def _read(self, path: str) -> bytes:
        stream = self._system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def put(self, job: bytes) -> "WorkQueue":
        """Adds a job behind all others."""
        name = f"{time.time_ns():020d}-{uuid4().hex}"
        part = self._path(f"{self.folder}/{name}.part")
        stream = self._system.create(part, True)
        stream.write(bytearray(job))
        stream.close()
        self._system.rename(part, self._path(f"{self.folder}/{name}.job"))
        return self

    __lshift__ = put

    def __len__(self) -> int:
        return len(self._names(self.folder))

    def get(self, worker: str, timeout: float = 0.0, step: float = 0.05) -> bytes | None:
        """Moves the oldest job to the worker and returns it; None where none comes within ``timeout``
        seconds. The worker holds it until it is acknowledged."""
        end = time.monotonic() + timeout
        held = self._held(worker)
        self._system.mkdirs(self._path(held))
        while True:
            for name in self._names(self.folder):
                target = f"{held}/{name}"
                try:
                    moved = self._system.rename(self._path(f"{self.folder}/{name}"), self._path(target))
                except Exception:  # another worker was faster
                    moved = False
                if moved:
                    return self._read(target)
            if time.monotonic() >= end:
                return None
            time.sleep(step)

    def pop(self) -> bytes | None:
        """Takes the oldest job away for good."""
        job = self.get("pop")
        if job is not None:
            self.acknowledge("pop", job)
        return job

    def held(self, worker: str) -> list[bytes]:
        """Jobs that the worker has not acknowledged."""
        return [self._read(f"{self._held(worker)}/{name}") for name in self._names(self._held(worker))]

    def acknowledge(self, worker: str, job: bytes) -> bool:
        """Removes a job that the worker holds; whether it held it."""
        return self._drop(self._held(worker), job, 1) > 0

    def _drop(self, folder: str, job: bytes, most: int | None = None) -> int:
        n = 0
        for name in self._names(folder):
            if (most is None or n < most) and self._read(f"{folder}/{name}") == job:
                n += bool(self._system.delete(self._path(f"{folder}/{name}"), False))
        return n

    def remove(self, job: bytes) -> int:
        """Removes all waiting jobs equal to this one; their number."""
        return self._drop(self.folder, job)

    def clear(self) -> None:
        """Removes all waiting jobs."""
        for name in self._names(self.folder):
            self._system.delete(self._path(f"{self.folder}/{name}"), False)

    def transfer(self, other: "WorkQueue") -> bytes | None:
        """Moves the oldest job to the end of another queue of the same root, and returns it."""
        for name in self._names(self.folder):
            target = f"{other.folder}/{time.time_ns():020d}-{uuid4().hex}.job"
            if self._system.rename(self._path(f"{self.folder}/{name}"), self._path(target)):
                return self._read(target)
        return None

    def give_back(self, worker: str) -> int:
        """Puts what a worker holds, dead or alive, back in its old place; the number."""
        names = self._names(self._held(worker))
        return sum(bool(self._system.rename(self._path(f"{self._held(worker)}/{n}"), self._path(f"{self.folder}/{n}"))) for n in names)

    def work(self, worker: str, handle, timeout: float = 0.0) -> tuple[int, int]:
        """Handles jobs until none comes: (done, failed). A job whose handling raises goes to the queue of
        errors; every job is acknowledged after that."""
        errors = WorkQueue(self._spark, self.root, errors_name(self.name))
        done = failed = 0
        while (job := self.get(worker, timeout)) is not None:
            try:
                handle(job)
                done += 1
            except Exception:
                errors.put(job)
                failed += 1
            finally:
                self.acknowledge(worker, job)
        return done, failed
