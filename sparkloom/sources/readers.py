"""Readers: delimited text, JSON bodies and files, XML mappers, file trees, message streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def sheet(spark: SparkSession, path: str, schema: StructType | str, numbers_as_text: bool = True) -> DataFrame:
    """A spreadsheet exported as CSV: header skipped, texts trimmed, wholly blank rows dropped."""
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True)
    return cleaned_rows(rows)


def cleaned_rows(rows: DataFrame) -> DataFrame:
    """Texts trimmed, '' as null, rows without any value dropped."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    return rows.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in texts}).dropna(how="all")


def number_text(c: Column) -> Column:
    """Numbers as a spreadsheet reader shows them in text columns: 123 as 123.0."""
    return c.cast("double").cast("string")


def csv_records(lines: DataFrame, column: str, width: int, key: int) -> DataFrame:
    """Lines as arrays of fields (doubled quotes, empties kept); the header, blank lines, short lines and lines without a key are dropped."""
    fields = csv_fields(F.col(column), width)
    out = lines.where((F.trim(column) != "") & ~F.contains(F.col(column), F.lit("mapper_interface"))).select(fields.alias("fields"))
    return out.where((F.size("fields") >= width) & (F.trim(F.element_at("fields", key + 1)) != ""))


def csv_fields(c: Column, width: int) -> Column:
    """The first `width` fields of a line, by the engine's own CSV parser."""
    schema = ", ".join(f"f{i} string" for i in range(width))
    row = F.from_csv(c, schema, {"escape": '"', "mode": "PERMISSIVE"})
    held = F.size(F.split(F.regexp_replace(c, r'"([^"]|"")*"', ""), ","))
    return F.slice(F.array(*[F.coalesce(row[f"f{i}"], F.lit("")) for i in range(width)]), F.lit(1), F.least(held, F.lit(width)))


def json_body(c: Column, schema: str) -> Column:
    """A JSON text as a struct; null where malformed."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def json_keys(c: Column, path: str) -> Column:
    return F.json_object_keys(F.get_json_object(c, path))


def json_file_lines(spark: SparkSession, path: str, field: str, containing: str) -> DataFrame:
    """One field of a file with a JSON array of objects, where it contains a text."""
    return spark.read.json(path, multiLine=True).select(field).where(F.contains(F.col(field), F.lit(containing)))


def table_by_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.jdbc(url, name, properties=properties)


def source_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """path and whole text of files below root, without build folders."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    files = read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(~F.col("path").rlike(r"/(target|build)/"))


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)


def mapper_statements(c: Column) -> Column:
    """Statements of a mapper in XML: structs of id, kind and folded SQL text."""
    kinds = ["select", "insert", "update", "delete"]
    parts = [F.arrays_zip(F.xpath(c, F.lit(f"/mapper/{k}/@id")).alias("id"), F.transform(F.xpath(c, F.lit(f"/mapper/{k}/text()")), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))).alias("sql"), F.transform(F.xpath(c, F.lit(f"/mapper/{k}/@id")), lambda _, k=k: F.lit(k)).alias("kind")) for k in kinds]
    return F.concat(*parts)


def one_hop(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Neighbours of nodes(node) along edges(type, src, dst) of one type."""
    return edges.where(F.col("type") == kind).join(nodes, F.col("src") == F.col("node")).select("src", "dst")


class MessageSource(DataSource):
    """A stream of text messages from a subscriber that the option `factory` names as `module:function`.

    The function takes (start, end) and returns the messages with those numbers, so that a batch can
    be read again after a failure; `count` is a function that returns how many there are by now. The
    option `spans` (1) is the number of tasks that read a batch, each its own run of numbers; the
    option `argument`, if given, is passed to both functions as their last argument.
    """

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "number long, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _MessageReader(self.options)


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _MessageReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def _named(self, option: str):
        import importlib

        module, _, function = self.options[option].partition(":")
        found = getattr(importlib.import_module(module), function)
        more = [self.options["argument"]] if "argument" in self.options else []
        return lambda *args: found(*args, *more)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": self._named("count")()}

    def partitions(self, start: dict, end: dict) -> list:
        lo, hi = start["at"], end["at"]
        n = max(1, min(int(self.options.get("spans", 1)), hi - lo))
        cuts = [lo + (hi - lo) * k // n for k in range(n + 1)]
        return [_Span(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def read(self, span: _Span):
        for i, body in enumerate(self._named("factory")(span.start, span.end)):
            if body is not None:
                yield span.start + i, body

    def commit(self, end: dict) -> None:
        pass


def selected(messages: DataFrame, topic: str, tags: str = "*") -> DataFrame:
    """messages(topic, tag, ...) of one topic with one of the tags, given as `a || b`; * stands for any tag, none included."""
    wanted = [t.strip() for t in tags.split("||")]
    of_topic = messages.where(F.col("topic") == topic)
    return of_topic if "*" in wanted else of_topic.where(F.col("tag").isin(wanted))


def accepted(frames: DataFrame, column: str, commands: tuple[int, ...] = (200,)) -> DataFrame:
    """cmd and data of text frames with a JSON command among those given; malformed frames are dropped."""
    return frames.select(json_body(F.col(column), "cmd int, data string").alias("_frame")).select("_frame.*").where(F.col("cmd").isin(*commands))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP socket, for development."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
