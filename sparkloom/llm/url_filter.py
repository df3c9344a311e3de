"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A rule is a host and a path prefix. The array holds xxhash64 of each rule's `host + path`; a url is
probed with every parent domain of its host that has as many labels as some rule's host and every
prefix of its path that has the length of some rule's path. A hit counts only when the rule's stored full string equals the probe, so
colliding digests do no harm. The longest fitting rule decides; urls without one are allowed.

Edge cases: null urls and urls without `://` have an empty host and path and no rule; rule lists
may be empty; repeated urls give repeated rows; a rule list over `MAX_RULES` is refused, as it is
built in the driver and handed to every executor.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 5_000_000


class DigestArray:
    """Rules as one file image: sorted keys, string offsets, verdicts and strings."""

    def __init__(self, image: bytes):
        self.image = image
        self._open = False

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str, str]]) -> DigestArray:
        """rules: (verdict 'allow' or 'block', host, path prefix); a rule given twice keeps its last verdict."""
        last: dict[str, tuple[str, int]] = {}
        labels: set[int] = set()
        for verdict, host, path in rules:
            last[host.lower() + path] = (verdict, len(host))
            labels.add(host.count(".") + 1)
            if len(last) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
        strings = [r.encode() for r in last]
        keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        order = np.argsort(keys, kind="stable")
        strings = [strings[i] for i in order]
        values = list(last.values())
        allow = np.array([values[i][0] == "allow" for i in order], np.uint8)
        paths = np.unique(np.array([len(s.decode()) - values[i][1] for i, s in zip(order, strings, strict=True)], np.int64))
        offsets = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=offsets[1:])
        head = np.array([len(strings), len(paths), len(labels)], np.int64)
        return cls(b"".join([head.tobytes(), keys[order].tobytes(), offsets.tobytes(), paths.tobytes(), np.array(sorted(labels), np.int64).tobytes(), allow.tobytes(), *strings]))

    def __getstate__(self):
        return {"image": self.image}

    def __setstate__(self, x):
        self.image, self._open = x["image"], False

    def open(self) -> DigestArray:
        """Map the image from a nameless file of the worker's own."""
        if not self._open:
            with tempfile.TemporaryFile() as f:
                f.write(self.image)
                f.flush()
                self._map = mmap.mmap(os.dup(f.fileno()), len(self.image), access=mmap.ACCESS_READ)
            n, p, d = np.frombuffer(self._map, np.int64, 3)
            at = 24
            self.keys = np.frombuffer(self._map, np.uint64, n, at)
            self.offsets = np.frombuffer(self._map, np.int64, n + 1, at + 8 * n)
            self.path_lengths = np.frombuffer(self._map, np.int64, p, at + 16 * n + 8)
            self.label_counts = np.frombuffer(self._map, np.int64, d, at + 16 * n + 8 + 8 * p)
            self.allow = np.frombuffer(self._map, np.uint8, n, at + 16 * n + 8 + 8 * p + 8 * d)
            self.strings_at = int(at + 16 * n + 8 + 8 * p + 8 * d + n)
            self._open = True
        return self

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The number of the rule that equals each probe, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not probes or not len(self.keys):
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, wanted)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # equal digests stand together
                if self.string(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self._map[self.strings_at + int(self.offsets[k]) : self.strings_at + int(self.offsets[k + 1])]

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """The longest fitting rule (host first, then path) and the verdict of each url."""
        probes: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            labels = host.rsplit(".", int(self.label_counts[-1])) if len(self.label_counts) else []
            ends = [path[:k] for k in self.path_lengths[::-1] if k <= len(path)]
            for j in self.label_counts[::-1]:  # longest host first
                if j > len(labels):
                    continue
                domain = ".".join(labels[len(labels) - int(j) :])
                probes += [(domain + e).encode() for e in ends]
                owner += [i] * len(ends)
        rules: list[str | None] = [None] * len(hosts)
        verdicts = ["allow"] * len(hosts)
        found = self.find(probes)
        for k in np.flatnonzero(found >= 0):
            i = owner[k]
            if rules[i] is None:
                rules[i] = probes[k].decode()
                verdicts[i] = "allow" if self.allow[found[k]] else "block"
        return rules, verdicts


def host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path of the url: both empty for null urls and urls without `://`."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page's url."""
    shared = pages.sparkSession.sparkContext.broadcast(DigestArray.build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = shared.value.open()
        for b in batches:
            rules, verdicts = array.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    own = host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).select("page_id", "host", "path")
    return own.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
