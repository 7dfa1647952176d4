"""A sink of event lines for streams, written once for each batch, and counters taken while rows pass."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    """A file that a task wrote aside."""

    name: str
    rows: int


class EventWriter(DataSourceStreamWriter):
    """Tasks write files under `.aside`; a commit moves those of its batch to epoch=<number>, under names that depend on their place in the batch only, and leaves
    a list of them, so that a batch that is committed again replaces itself and a batch that fails leaves nothing that readers see."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Part:
        system, root = _system(self.path)
        name, n = f".aside/{uuid.uuid4().hex}.json", 0
        system.create_dir(f"{root}/.aside", recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        system, root = _system(self.path)
        folder = f"{root}/epoch={batchId}"
        system.create_dir(folder, recursive=True)
        system.delete_dir_contents(folder)
        for i, part in enumerate(x for x in messages if x is not None):
            if part.rows:
                system.move(f"{root}/{part.name}", f"{folder}/part-{i:05d}.json")
            else:
                system.delete_file(f"{root}/{part.name}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        system, root = _system(self.path)
        for part in messages:
            if part is not None:
                system.delete_file(f"{root}/{part.name}")


class EventLog(DataSource):
    """Option path: a folder that all executors reach, as pyarrow names it. Lines are JSON, a folder for each batch."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"])


def counted(requests: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """requests (kind, milliseconds) as they are, and an observation that has their counters once an action has read them: what `views.request_counters` gives, without a pass of its own."""
    seen, search = Observation(name), F.col("kind") == "search"
    n, spent = F.count_if(search), F.sum(F.when(search, F.col("milliseconds")))
    return requests.observe(seen, F.count(F.lit(1)).alias("requests"), n.alias("searches"), F.when(n > 0, F.floor(spent / n)).alias("search_mean_ms")), seen
