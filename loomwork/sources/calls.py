"""A log of calls to the outside, written ahead, so that a retried task doesn't repeat them.

A call is named by its correlation id, ``run:position``, and its number within the step.  Before it is
made a line says so; once it is answered, and before anyone sees the answer, a line says that.  A
later attempt of the task reads what earlier ones left and takes the answers from there.  Of a call
that was begun and has no answer nobody knows whether it was made: by default it is made again, else
the row fails.

Each attempt of a task writes a file of its own in a folder that driver and executors share, so that
no two writers meet, and reads those of its own partition only.  A log is one execution's: the same
folder given to another run of the same plan over the same runs resumes that execution, if their
partitions are the same.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark import TaskContext


class UnknownCall(RuntimeError):
    """A call that was begun and has no answer, where such calls aren't made again."""


@dataclass(frozen=True)
class CallLog:
    """Where calls are logged: a folder or URI that pyarrow reaches from every executor."""

    folder: str
    repeat: bool = True  # whether a call without an answer is made again

    def of_task(self, step: str) -> TaskCalls:
        context = TaskContext.get()
        return TaskCalls(self, f"{step}-{context.partitionId() if context else 0}")


class TaskCalls:
    """The log of one attempt of a task: answers of earlier attempts, and a file of its own."""

    def __init__(self, log: CallLog, name: str):
        where, root = fs.FileSystem.from_uri(log.folder) if "://" in log.folder else (fs.LocalFileSystem(), log.folder.removeprefix("file:"))
        self.repeat, self.lock = log.repeat, threading.Lock()
        self.place = f"{root}/{name}"
        where.create_dir(self.place)
        self.answers: dict[str, Any] = {}
        self.begun: set[str] = set()
        for info in where.get_file_info(fs.FileSelector(self.place)):
            with where.open_input_stream(info.path) as f:
                for line in f.read().decode().splitlines(keepends=True):
                    if line.endswith("\n"):  # a task may have died within a line
                        self._take(json.loads(line))
        self.where, self.file, self.number = where, None, 0
        # a local file is flushed line by line; stores that show a file only when it is closed get one a line
        self.appends = isinstance(where, fs.LocalFileSystem)

    def _take(self, entry: dict[str, Any]) -> None:
        self.begun.add(entry["call"])
        if "answer" in entry:
            self.answers[entry["call"]] = entry["answer"]

    def _write(self, entry: dict[str, Any]) -> None:
        line = json.dumps(entry, ensure_ascii=False).encode() + b"\n"
        with self.lock:
            if self.appends:
                if self.file is None:
                    self.file = open(f"{self.place}/{uuid.uuid4().hex}.jsonl", "ab", buffering=0)  # noqa: SIM115  (open as long as the task)
                self.file.write(line)
            else:
                self.number += 1
                with self.where.open_output_stream(f"{self.place}/{uuid.uuid4().hex}-{self.number}.jsonl") as f:
                    f.write(line)

    def once(self, call: str, make: Callable[[], Any]) -> Any:
        """The logged answer of the call, or what ``make`` gives, which is logged; its failures are not."""
        if call in self.answers:
            return self.answers[call]
        if call in self.begun and not self.repeat:
            raise UnknownCall(f"{call} was begun before, and nobody knows whether it was made")
        self._write({"call": call})
        answer = make()
        self._write({"call": call, "answer": answer})
        return answer
