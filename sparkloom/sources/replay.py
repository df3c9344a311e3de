"""A subscriber's log in files: numbered messages that Spark has written in blocks, for the message source to read by number."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages of one block of files.
BLOCK = 1000


def write(messages: DataFrame, folder: str) -> None:
    """messages(number, body) below folder, in blocks of numbers."""
    lines = messages.select(F.to_json(F.struct("number", "body"), {"ignoreNullFields": "false"}).alias("value"), F.floor(F.col("number") / BLOCK).alias("block"))
    lines.write.partitionBy("block").text(folder)


def _lines(folder: str, block: int) -> dict[int, str | None]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    found = {}
    for info in system.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)):
        if info.base_name.startswith("part-"):
            with system.open_input_stream(info.path) as f:
                found |= {m["number"]: m["body"] for m in map(json.loads, f.read().splitlines())}
    return found


def count(folder: str) -> int:
    """One more than the largest number written."""
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    blocks = [int(i.base_name.partition("=")[2]) for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("block=")]
    return max(_lines(folder, max(blocks))) + 1 if blocks else 0


def read(start: int, end: int, folder: str) -> list[str | None]:
    """The messages of these numbers, None where there is none: only the blocks that hold them are read."""
    out: dict[int, str | None] = {}
    for block in range(start // BLOCK, (end - 1) // BLOCK + 1):
        out |= _lines(folder, block)
    return [out.get(i) for i in range(start, end)]
