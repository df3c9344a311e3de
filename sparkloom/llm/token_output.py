"""Token-ID output: documents as token ids in files of Huffman-coded blocks, and back.

Texts are encoded with a public tokenizer and end with an end id. A first pass counts every id over
all documents; the counts give one canonical code. A second pass deals the documents out by ranges
of doc_id, and each task writes one file of blocks (see huffman.py) in ascending order of doc_id.
The manifest, a table with a row for each block, names the files that count: a task that runs twice
leaves a second file that no row names. Reading back opens any block by itself.

Edge cases: a null text is empty and has the end id alone; a null doc_id sorts first; repeated rows
are written one after the other; an empty table gives no files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_folder, drop_stored, new_folder, release, stored
from .huffman import Codebook, code_lengths, pack, unpack

NO_ID = -(1 << 63)
#: Ids after which a block ends with the document at hand, and bytes of text that are encoded at once.
BLOCK_IDS = 1 << 18
#: Signs that often follow a word; each is a run of its own behind letters.
_SIGNS = tuple(".,;:!?")
# Fixed value: how a byte-level tokenizer cuts text into runs that it encodes one by one.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Fixed value: the character by which a byte-level tokenizer writes each byte: printable ones as they are, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512)))
_SPACE = chr(_BYTES[32])

# Fixed value: texts with marks of special tokens, or other white space than single spaces and newlines between words.
_WHOLE = r"<\||^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Whole-text encoding with a cache of the pieces between spaces and newlines.

    A single space between other characters always begins a new piece for a byte-level tokenizer
    whose pieces carry at most one leading space, and a single newline is a piece of its own, so the
    pieces' ids, joined, are the text's ids. Other texts (see `_WHOLE`) are encoded whole. Texts are
    split and their distinct pieces found in Arrow; a text's ids are gathered from those of its pieces.
    """

    def __init__(self, path: str, end_id: int, cache: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end = np.array([end_id], "<u4").tobytes()
        self.cache = cache
        self.known: dict[str, bytes] = {}  # ids of a space and this piece; of pieces that begin with a newline or NUL, without a space
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # ids of runs

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs: the model takes those of Latin letters, spaces and ASCII directly, the rest pass the whole tokenizer."""
        model, ids, ends, far = self.model.tokenize, [], [0], []
        for i, r in enumerate(runs):
            if r.isascii() and r.isprintable():
                ids += [t.id for t in model(r.replace(" ", _SPACE))]
            elif max(r) < "\u0250":
                ids += [t.id for t in model(r.encode().decode("latin-1").translate(_BYTES))]
            else:
                far.append(i)
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        out = [raw[a:b] for a, b in pairwise(ends)]
        for i, x in zip(far, self.whole([runs[i] for i in far]), strict=True):
            out[i] = x
        return out

    def _fill(self, pieces: list[str]) -> None:
        """Ids of new pieces: words of letters, such words with a sign behind them, and others by way of their runs."""
        known, parts = self.known, self.parts
        plain = {p for p in pieces if p.isalpha()}
        signed = [p for p in pieces if p[-1:] in _SIGNS and p[:-1].isalpha()]
        fresh = list(plain.union([p[:-1] for p in signed]).difference(known))
        for a in range(0, len(fresh), 2000):
            some = fresh[a : a + 2000]
            known.update(zip(some, self._runs([" " + w for w in some]), strict=True))
        split = {p: _RUNS.findall(p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p) for p in set(pieces).difference(plain, signed)}
        runs = set(_SIGNS).union(*split.values())
        if len(parts) > self.cache // 4:
            parts.clear()
        absent = list(runs.difference(parts))
        parts.update(zip(absent, self._runs(absent), strict=True))
        known.update((p, known[p[:-1]] + parts[p[-1]]) for p in signed)
        known.update((p, b"".join([parts[r] for r in own])) for p, own in split.items())

    def _blobs(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.cache:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        absent = [i for i, x in enumerate(out) if x is None]
        if absent:
            names = [pieces[i] for i in absent]
            back = list(map(older.get, names))
            known.update((p, x) for p, x in zip(names, back, strict=True) if x is not None)
            self._fill([p for p, x in zip(names, back, strict=True) if x is None])
            for i, p in zip(absent, names, strict=True):
                out[i] = known[p]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; where each text ends)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE)
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lines = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0"), lines, pa.scalar("")), " ")
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        blobs = self._blobs(pieces)
        blobs.append(self.end)
        blobs += self.whole(texts.take(pa.array(apart)).to_pylist()) if len(apart) else []
        at = coded.indices.to_numpy().copy()
        offsets = lists.offsets.to_numpy()
        at[offsets[apart]] = len(pieces) + 1 + np.arange(len(apart))
        at = np.insert(at, offsets[1:], len(pieces))
        starts = np.zeros(len(blobs) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2, out=starts[1:])
        own = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(blobs), "<u4"))).take(pa.array(at))
        ends = own.offsets.to_numpy()
        return own.values.to_numpy()[ends[0] :], ends[offsets[1:] + np.arange(1, len(offsets))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian 32-bit integers."""
        found, ends = self.ids(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(found, ends[:-1])] if texts else []


def _by_bytes(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """(from, length) of slices of about so many bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, b - a
        a = b


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """The worker process's encoder: its cache serves all tasks that the process runs."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _prepared(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _by_task(folder: str, end: str) -> tuple[int, str]:
    """This task's partition and a file name of its own; a second attempt takes another name."""
    task = TaskContext.get()
    return task.partitionId(), f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.{end}"


def _output(path: str):
    system, name = _file_system(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def tokenized(documents: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Encode all documents once, in ascending order of doc_id, into a plain file for each task.

    Returns a row for each file: part, path, and the file's counts of ids.
    """
    narrow = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_list(narrow))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = encoder_of(tokenizer, end_id)
        part, path = _by_task(folder, "ids")
        counts = np.zeros(vocabulary, np.int64)
        sink = writer = None
        for batch in batches:
            for a, n in _by_bytes(batch.column("text")):
                found, ends = encoder.ids(batch.column("text").slice(a, n))
                counts += np.bincount(found, minlength=vocabulary)
                if writer is None:
                    sink = _output(path)
                    writer = pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(found.astype(narrow.to_pandas_dtype())))
                writer.write_batch(pa.record_batch([batch.column("doc_id").slice(a, n), lists], schema=kind))
                del found, ends, lists
                release()
        if writer is not None:
            writer.close()
            sink.close()
            used = np.flatnonzero(counts)
            pairs = pa.StructArray.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pairs)], names=["part", "path", "counts"])

    laid = _prepared(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(laid.mapInArrow(run, "part int, path string, counts array<struct<id:int,n:long>>"), "token-files")


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257) -> tuple[DataFrame, np.ndarray]:
    """Write all documents below folder; returns the manifest (a row for each block) and the code lengths."""
    spark = documents.sparkSession
    plain = tokenized(documents, folder + "-plain", tokenizer, end_id, vocabulary)
    counts = np.zeros(vocabulary, np.int64)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for own in batch.column("counts"):
                total[own.values.field("id").to_numpy()] += own.values.field("n").to_numpy()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    # Global counts: a few tasks add up the files' counts, and at most `vocabulary` sums reach the driver.
    for r in plain.select("counts").repartition(4).mapInArrow(merged, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)
    schema = "part int, block int, path string, at long, bytes long, digest string, docs long, ids long"

    def coded(book: Codebook, part: int, source: str) -> list[tuple]:
        system, name = _file_system(source)
        _, path = _by_task(folder, f"{part:05d}.huf")
        rows: list[tuple] = []
        at = held = 0
        docs: list[int] = []
        own: list[np.ndarray] = []
        with system.open_input_stream(name) as raw, pa.ipc.open_stream(raw) as reader, _output(path) as file:

            def flush() -> None:
                nonlocal at, held
                data = pack(book, np.array(docs, np.int64), np.array([len(x) for x in own]), np.concatenate(own))
                file.write(data)
                rows.append((part, len(rows), path, at, len(data), xxhash.xxh3_128_hexdigest(data), len(docs), held))
                at += len(data)
                held = 0
                docs.clear()
                own.clear()

            for batch in reader:
                ids = batch.column("ids")
                ends = ids.offsets.to_numpy()
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    docs.append(doc)
                    own.append(ids.values[a:b].to_numpy())
                    held += b - a
                    if held >= BLOCK_IDS:
                        flush()
            if docs:
                flush()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                rows = coded(book, row["part"], row["path"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    files = plain.select("part", "path").repartition(max(1, plain.count()), "part")
    manifest = stored(files.mapInArrow(run, schema), "manifest")
    drop_folder(spark, folder + "-plain")
    drop_stored(plain)
    return manifest, lengths


def read(manifest: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(lengths)
    # One row per file goes through one task here, and the blocks of a file through another.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    files = files.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
    blocks = manifest.withColumn("inside", F.coalesce(F.sum("ids").over(before.partitionBy("part").orderBy("block")), F.lit(0)))
    blocks = blocks.join(files, F.col("part") == F.col("_part")).select("path", "at", "bytes", "digest", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _file_system(row["path"])
                with system.open_input_file(name) as f:
                    data = f.read_at(row["bytes"], row["at"])
                if xxhash.xxh3_128_hexdigest(data) != row["digest"]:
                    raise OSError(f"damaged block at {row['at']} of {row['path']}")
                docs, counts, ids = unpack(book, data)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(docs, mask=docs == NO_ID)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + row["start"]), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.repartition(max(1, spark.sparkContext.defaultParallelism) * 4).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder of the shared storage and return what its files hold."""
    manifest, lengths = write(documents, new_folder(documents.sparkSession, "tokens"), tokenizer, end_id)
    return read(manifest, lengths)
