"""Durable replies of model calls, and pacing of the calls of all tasks.

A log is a folder on a file system that all executors see. Every batch of replies becomes one JSON-lines
file, written under a name that readers ignore and then moved, so a file is there whole or not at all.
A task that is retried first reads what earlier attempts of its partition wrote; a later run reads the
whole log as a table. Replies are found by the digest of their prompt.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def prompt_digest(prompt: Column) -> Column:
    return F.sha2(F.coalesce(prompt.cast("string"), F.lit("")).cast("binary"), 256)


@dataclass(frozen=True)
class CallLog:
    """The log at ``path``; ``run`` names the replies of one job."""

    path: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def known(self, spark: SparkSession) -> DataFrame | None:
        """digest, reply of every prompt that some run has a reply for; None before the first."""
        files, path = _folder(self.path)
        if files.get_file_info(path).type.name == "NotFound":
            return None
        logged = spark.read.schema("digest string, reply string").option("recursiveFileLookup", True).json(self.path)
        return logged.groupBy("digest").agg(F.min("reply").alias("reply"))

    def of_partition(self, part: int) -> PartitionLog:
        return PartitionLog(f"{self.path.rstrip('/')}/run={self.run}/part={part}")


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class PartitionLog:
    """What one partition of a run has asked: ``replies`` by digest; ``add`` commits a batch."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.path = _folder(path)
        self.files.create_dir(self.path, recursive=True)
        self.replies: dict[str, str] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.path)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
                with self.files.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        row = json.loads(line)
                        self.replies[row["digest"]] = row["reply"]

    def add(self, replies: dict[str, str]) -> None:
        if not replies:
            return
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.path}/_{name}") as f:
            f.write("".join(json.dumps({"digest": d, "reply": r}) + "\n" for d, r in replies.items()).encode())
        self.files.move(f"{self.path}/_{name}", f"{self.path}/{name}.json")
        self.replies.update(replies)


class Pacer:
    """Lets calls through ``interval`` seconds apart, the first after ``offset``."""

    def __init__(self, interval: float, offset: float = 0.0):
        self.interval, self.next = interval, time.monotonic() + offset

    def wait(self) -> None:
        if self.interval <= 0:
            return
        gap = self.next - time.monotonic()
        if gap > 0:
            time.sleep(gap)
        self.next = max(self.next, time.monotonic()) + self.interval

    @staticmethod
    def of_barrier_task(rate: float) -> Pacer:
        """This task's share of ``rate`` calls a second over all tasks of a barrier stage. The tasks begin
        together, one interval of the common rate apart, so their calls never come closer than it allows."""
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        tasks = len(context.getTaskInfos())
        context.barrier()
        return Pacer(tasks / rate, context.partitionId() / rate)
