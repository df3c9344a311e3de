"""Tables in database files (SQLite) that driver and executors share: `spark.read.format("database")` and `df.write.format("database")`.

For tables that no database server holds, where tasks run in other processes than the driver. The option `path` is a folder,
`table` the table's name. Each task inserts its rows into a database file of its own, by statements of `batch` (200) rows in
one transaction; the driver moves the files to `path` when all tasks are done, or drops them if one fails. Reading, each file
is one partition, and the option `query` is what it is asked: the filter and the columns of the SQL are the database's work.

Files go through pyarrow's file systems, so `path` may be any address that those know; a task has the file that it works on
in its temp folder, and removes it. Columns are whole numbers, doubles, texts, truth values or bytes; a double that is no
number is null, as in the database.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import batched

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from . import workbook
from .publisher import _file_system

_KINDS = {T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.BooleanType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _columns(schema: T.StructType) -> str:
    for f in schema.fields:
        if type(f.dataType) not in _KINDS:
            raise ValueError(f"column {f.name}: the database has no {f.dataType.simpleString()}")
    return ", ".join(f"{_quoted(f.name)} {_KINDS[type(f.dataType)]}" for f in schema.fields)


@dataclass
class File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.query = options["path"], options["query"]
        self.truths = [isinstance(f.dataType, T.BooleanType) for f in schema.fields]

    def partitions(self) -> list[File]:
        system, path = _file_system(self.path.rstrip("/"))
        return [File(f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(_Writer.suffix)]

    def read(self, file: File | None) -> Iterator[tuple]:
        if file is None:  # there are no files
            return
        system, _ = _file_system(self.path)
        with tempfile.TemporaryDirectory() as folder:
            own = os.path.join(folder, "own")
            with system.open_input_stream(file.path) as f, open(own, "wb") as out:
                shutil.copyfileobj(f, out, 1 << 20)
            with closing(sqlite3.connect(own)) as base:
                for row in base.execute(self.query):
                    yield tuple(bool(v) if truth and v is not None else v for v, truth in zip(row, self.truths, strict=True))


class _Writer(workbook._Writer):
    """Staged files as workbooks are, of another kind."""

    suffix = ".sqlite"

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        self.made = f"CREATE TABLE {_quoted(options['table'])} ({_columns(schema)})"
        self.insert, self.batch = f"INSERT INTO {_quoted(options['table'])} VALUES ({', '.join('?' * len(schema))})", int(options.get("batch", 200))

    def write(self, iterator: Iterator) -> workbook.Written:
        system, path = _file_system(self.path.rstrip("/"))
        system.create_dir(f"{path}/{self.staged}", recursive=True)
        name = f"{uuid.uuid4().hex}{self.suffix}"
        with tempfile.TemporaryDirectory() as folder:
            own = os.path.join(folder, "own")
            with closing(sqlite3.connect(own)) as base:
                base.execute(self.made)
                for rows in batched(iterator, self.batch):
                    base.executemany(self.insert, rows)
                base.commit()
            with open(own, "rb") as f, system.open_output_stream(f"{path}/{self.staged}/{name}") as out:
                shutil.copyfileobj(f, out, 1 << 20)
        return workbook.Written([name])


class DatabaseSource(DataSource):
    """The data source `database`: register it with `spark.dataSource.register`."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> str:
        raise ValueError("a query's columns go by position: give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def read(spark: SparkSession, path: str, query: str, schema: T.StructType | str) -> DataFrame:
    """What a query finds in a folder's database files, each asked on its own."""
    spark.dataSource.register(DatabaseSource)
    return spark.read.format("database").schema(schema).option("query", query).load(path)


def write(df: DataFrame, path: str, name: str) -> None:
    """Replace a table's rows."""
    df.sparkSession.dataSource.register(DatabaseSource)
    df.write.format("database").option("table", name).mode("overwrite").save(path)
