"""Publishing rows as messages: each task stages its own, a commit publishes all of a batch at once, or none.

`df.write.format("publish")` and `df.writeStream.format("publish")` send the column `body` (with `topic`, if there is one)
of every row. Tasks hand frames to a transport; the driver commits or aborts the batch when all tasks are done. A transport
is a class that the option `transport` names as `module:class`, or one of the two here:

* `folder` (the default): staged files below the option `path`, published by one small manifest for each batch;
* `socket`: frames to a TCP server at `host` and `port`, which delivers a batch when its commit frame comes.

Delivery is once: a batch whose manifest (or commit) is there already is not published again, and what failed tasks or
earlier attempts staged is never named by a manifest.
"""

from __future__ import annotations

import json
import socket
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged: its name and how many messages."""

    name: str
    messages: int


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


class Folder:
    """Staged files and manifests in a folder that driver and executors share."""

    def __init__(self, options: dict[str, str]):
        self.system, self.path = _file_system(options["path"].rstrip("/"))

    def send(self, name: str, frames: list[str]) -> None:
        self.system.create_dir(f"{self.path}/staged", recursive=True)
        with self.system.open_output_stream(f"{self.path}/staged/{name}") as out:
            out.write("".join(f + "\n" for f in frames).encode())

    def drop(self, name: str) -> None:
        if self.system.get_file_info(f"{self.path}/staged/{name}").type == fs.FileType.File:
            self.system.delete_file(f"{self.path}/staged/{name}")

    def commit(self, batch: str, staged: list[Staged]) -> bool:
        """Publish, by a manifest that is written whole and then moved into place; False if the batch is there already."""
        target = f"{self.path}/published/{batch}.json"
        if self.system.get_file_info(target).type == fs.FileType.File:
            return False
        self.system.create_dir(f"{self.path}/published", recursive=True)
        with self.system.open_output_stream(f"{self.path}/staged/{batch}.json") as out:
            out.write((json.dumps({"batch": batch, "files": [f"staged/{s.name}" for s in staged], "messages": sum(s.messages for s in staged)}) + "\n").encode())
        self.system.move(f"{self.path}/staged/{batch}.json", target)
        return True


class Socket:
    """Frames to a server: each names its batch, task and place, so that the server keeps a frame sent twice once."""

    def __init__(self, options: dict[str, str]):
        self.at = (options["host"], int(options["port"]))

    def _lines(self, frames: list[dict]) -> None:
        with socket.create_connection(self.at, timeout=30) as out:
            out.sendall("".join(json.dumps(f) + "\n" for f in frames).encode())
            out.shutdown(socket.SHUT_WR)
            if out.recv(3) != b"ok\n":
                raise OSError("the server has not taken the frames")

    def send(self, name: str, frames: list[str]) -> None:
        self._lines([{"staged": name, "place": i, "frame": f} for i, f in enumerate(frames)])

    def drop(self, name: str) -> None:
        self._lines([{"drop": name}])

    def commit(self, batch: str, staged: list[Staged]) -> bool:
        self._lines([{"commit": batch, "staged": [s.name for s in staged]}])
        return True


def _transport(options: dict[str, str]):
    kind = options.get("transport", "folder")
    if ":" in kind:
        import importlib

        module, _, name = kind.partition(":")
        return getattr(importlib.import_module(module), name)(options)
    return {"folder": Folder, "socket": Socket}[kind](options)


def _twice(action, *args):
    """Once more after a connection or file error; the second error counts."""
    try:
        return action(*args)
    except OSError:
        return action(*args)


class _Writer:
    """Tasks' part, and the driver's for a batch of that name."""

    def __init__(self, options: dict[str, str]):
        self.options, self.chunk = dict(options), int(options.get("chunk", 10_000))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        transport, name, n, frames = _transport(self.options), uuid.uuid4().hex, 0, []
        names = []

        def flush() -> None:
            names.append(f"{name}-{len(names)}")
            _twice(transport.send, names[-1], frames)
            frames.clear()

        for row in rows:
            own = row.asDict()
            frames.append(json.dumps({"topic": own.get("topic"), "body": own["body"]}, ensure_ascii=False))
            n += 1
            if len(frames) >= self.chunk:
                flush()
        if frames:
            flush()
        return Staged(" ".join(names), n)

    def _staged(self, messages: list) -> list[Staged]:
        return [Staged(name, m.messages if i == 0 else 0) for m in messages if m is not None for i, name in enumerate(m.name.split())]

    def _commit(self, batch: str, messages: list) -> None:
        transport, staged = _transport(self.options), self._staged(messages)
        if not _twice(transport.commit, batch, staged):
            for s in staged:
                _twice(transport.drop, s.name)

    def _abort(self, messages: list) -> None:
        transport = _transport(self.options)
        for s in self._staged(messages):
            _twice(transport.drop, s.name)


class _BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(self.options.get("batch") or uuid.uuid4().hex, messages)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        self._commit(f"{self.options.get('batch', 'batch')}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class PublishSink(DataSource):
    """The data source `publish`: register it with `spark.dataSource.register`."""

    @classmethod
    def name(cls) -> str:
        return "publish"

    def schema(self) -> str:
        return "topic string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802  Spark's name
        return _StreamWriter(self.options)


def published(spark: SparkSession, path: str) -> DataFrame:
    """batch, topic, body of all messages published to a folder: of the files that manifests name, and no others."""
    named = spark.read.schema("batch string, files array<string>").json(f"{path}/published").select("batch", F.explode("files").alias("file"))
    lines = spark.read.text(f"{path}/staged").select(F.from_json("value", "topic string, body string").alias("m"), F.concat(F.lit("staged/"), F.regexp_extract("_metadata.file_name", "([^/]+)$", 1)).alias("file"))
    return lines.join(named, "file").select("batch", "m.topic", "m.body")
