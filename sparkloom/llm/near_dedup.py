"""MinHash near-deduplication with an LSH forest.

Documents become sets of word shingles; equal sets are one representative. A representative's
signature of `HASHES` minimum hashes is read in several orders that share no hash in their first
levels; each order, sorted, is one tree of the forest. How many trees and how deep their shared
prefix must be follows from the similarity asked (see `layout`).

Candidates come from the sorted orders. Rows of a tree that share its base prefix are a region.
Regions of up to `BLOCK` rows are compared as a whole; larger ones are cut, in sorted order, into
blocks of neighbours with the longest common prefixes, so that dense regions are read at a greater
depth. Inside a block rows are held against each other by their odd sketches (see `sketch`), which
bound the sets' difference from below, and the block's candidates are confirmed on the full sets:

1. of the pairs that the sketches let pass, a spanning forest of the most alike ones: a family of n
   near copies gives up to n pairs, whatever its number of links;
2. after these links are gathered to components: all pairs that pass, that lie in two components
   and that were not tested before. For regions that were cut, the members with several components
   meet by an exact prefix filter instead: two sets of the similarity asked always share one of the
   rarest `n - ceil(similarity n) + 1` shingles of each. Blocks of a frequent shingle hold a part of
   its members and all that lie outside its most frequent component, so no task gets them all.

No pair is capped or sampled. A pair that no third set links is missed when no tree joins it, with
a chance of at most `MISS` at the similarity asked (4.7e-8 at 0.8); a pair of sets over `SKETCH`
shingles also when its sampled sketches differ by five deviations more than expected (under 2e-6).

Edge cases: null texts and texts without words have an empty set and no links; texts with fewer
words than a shingle have one shingle of all words; a null doc_id is left out of links (it is its
own document with a null component); repeated rows link to each other as equal sets; of rows that
repeat a doc_id with different texts all count for equal sets, and the text with the smallest
digest for links to others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, inner, mix64, release, stored
from .components import components

HASHES = 128
#: Chance of missing a pair of the similarity asked that the forest's layout allows.
MISS = 1e-6
#: Rows of a region that are compared with each other; larger regions are cut.
BLOCK = 2000
#: Bits of a set's odd sketch; larger sets are sampled by hash to at most so many shingles.
SKETCH = 1024
#: Of a large block's row, partners that go into the spanning forest.
BEST = 8
#: Counters of shingles; how often a counter was hit gives the order of the prefix filter, exact counts aren't needed.
COUNTERS = 1 << 18
_SEED = np.random.default_rng(20240229)
_A = (_SEED.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def layout(percent: int) -> tuple[int, int]:
    """(trees, base depth) for a similarity: the deepest base at which all trees together miss a pair by `MISS` at most."""
    share = max(1, percent) / 100
    fits = [d for d in range(1, 9) if (1 - share**d) ** (HASHES // d) <= MISS]
    base = max(fits, default=1)
    return HASHES // base, base


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        acc = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            acc = mix64(acc) + h[k : len(h) - width + 1 + k]
    return np.unique(mix64(acc + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes (uint32) of a non-empty set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        block = x[a : a + 512]
        np.minimum(low, (block[:, None] * _A + _B).min(axis=0), out=low)
    return low


def level(n: np.ndarray) -> np.ndarray:
    """How often sets of n shingles are halved for their sketch."""
    return np.ceil(np.log2(np.maximum(n, SKETCH) / SKETCH)).astype(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """A set's odd sketch: for each of SKETCH buckets, whether it holds an odd number of shingles.

    Bits in which two sketches differ are never more than the shingles in which the sets differ, so
    they prove pairs unlike and never reject a pair of the similarity asked. Sets over SKETCH
    shingles keep those whose hash begins with level() zero bits.
    """
    r = int(level(np.array(len(shingles))))
    h = shingles.astype(np.uint32)
    h = h[h < (1 << 32 - r)] if r else h
    return np.packbits(np.bincount((h << np.uint32(r)) >> np.uint32(22), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_lo and set_hi (a 128-bit digest of the set), sig (minimum hashes) and odd (sketch) of every row."""
    schema = "doc_id long, n_shingles long, set_lo long, set_hi long, sig binary, odd binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width, known)
                rows.append((len(s), *set_digest(s), signature(s).tobytes(), sketch(s)) if len(s) else (0, 0, 0, None, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]], names=["doc_id", "n_shingles", "set_lo", "set_hi", "sig", "odd"])
        known.clear()
        release()

    return _texts(documents).mapInArrow(run, schema)


def representatives(sigs: DataFrame) -> DataFrame:
    """id (smallest doc_id), n, lo, hi, sig, odd of each distinct set; of sets with one id that of the smallest digest."""
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min(F.struct("doc_id", "sig", "odd")).alias("x"))
    return first.select(F.col("x.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("set_lo").alias("lo"), F.col("set_hi").alias("hi"), "x.sig", "x.odd")


def _one_by_id(reps: DataFrame) -> DataFrame:
    """The representatives with one set for each id, which is all of them unless doc_ids repeat with different texts."""
    several = reps.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"))
    if several.isEmpty():
        return reps
    first = reps.groupBy("id").agg(F.min(F.struct("lo", "hi", "n", "sig", "odd")).alias("x"))
    return stored(first.select("id", "x.n", "x.lo", "x.hi", "x.sig", "x.odd"), "representatives")


# The forest


def tree_paths(sigs: np.ndarray, trees: int, base: int) -> np.ndarray:
    """Of each row and tree, as longs: a hash of the base prefix, and four bits of each of the sixteen next levels."""
    order = (np.arange(trees)[:, None] * base + np.arange(base + 16)) % HASHES
    out = np.zeros((len(sigs), trees, 2), np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(trees, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), (len(sigs), trees))
        for d in range(base):
            acc = mix64(acc + sigs[:, order[:, d]] + np.uint64(d + 1))
        out[:, :, 0] = acc
        for d in range(16):
            below = mix64(sigs[:, order[:, base + d]] + np.uint64(d + 1)) >> np.uint64(60)
            out[:, :, 1] |= below << np.uint64(60 - 4 * d)
    return out.view(np.int64)


def forest(reps: DataFrame, trees: int, base: int) -> DataFrame:
    """p (region), block, id and cut of the forest's rows that share their region with others.

    Rows are range-partitioned and sorted by tree order, so that a region of any size spreads over
    tasks. block is 0 in regions of at most BLOCK rows; rows of larger ones, which are cut, get the
    block of their place in sorted order. The small ends of a region that a partition border divides
    are 0 on both sides, so they meet; what fills a partition is cut.
    """

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                paths = tree_paths(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES), trees, base).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(paths[:, 0])), pa.array(np.ascontiguousarray(paths[:, 1])), pa.array(np.repeat(part.column("id").to_numpy(), trees))], names=["p", "path", "id"])

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() + 1
        p, i = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows that wait for the end of their region
        held = 0  # chunks of the waiting region that went out already
        begun = False

        def out(p: np.ndarray, i: np.ndarray, block: int, cut: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), block, np.int64)), pa.array(i), pa.array(np.full(len(p), cut))], names=["p", "block", "id", "cut"])

        for batch in batches:
            p, i = np.concatenate([p, batch.column("p").to_numpy()]), np.concatenate([i, batch.column("id").to_numpy()])
            if not len(p):
                continue
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            sizes = np.diff(starts, append=len(p))
            done = sizes[:-1]
            whole = (done > 1) & (done <= BLOCK)
            if len(done):
                whole[0] = done[0] <= BLOCK and not held and (done[0] > 1 or not begun)
                keep = np.repeat(whole, done)
                if keep.any():
                    yield out(p[: len(keep)][keep], i[: len(keep)][keep], 0, False)
                begun = True
            for k in np.flatnonzero((sizes > BLOCK) | ((np.arange(len(sizes)) == 0) & (held > 0))):
                a, b = int(starts[k]), int(starts[k] + sizes[k])
                last = k == len(sizes) - 1
                held = held if k == 0 else 0
                if last:  # the region may go on: whole chunks only
                    b = a + (b - a - 1) // BLOCK * BLOCK
                for x in range(a, b, BLOCK):
                    yield out(p[x : min(x + BLOCK, b)], i[x : min(x + BLOCK, b)], task << 32 | held, True)
                    held += 1
                if last:
                    starts[k] = b
                else:
                    held = 0
            if len(sizes) > 1 and sizes[-1] <= BLOCK:
                held = 0
            p, i = p[starts[-1] :], i[starts[-1] :]
        if len(p):  # a region that fills its whole partition may go on in several others
            cut = held > 0 or not begun
            yield out(p, i, task << 32 | held if cut else 0, cut)

    laid = reps.select("id", "sig").mapInArrow(grown, "p long, path long, id long").repartitionByRange("p", "path", "id").sortWithinPartitions("p", "path", "id")
    return laid.mapInArrow(regions, "p long, block long, id long, cut boolean")


# Pairs within blocks


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges i-j, given from best to worst, that form a spanning forest of n nodes, the best ones taken."""
    root = np.arange(n)
    live = np.arange(len(i))
    taken = []
    while True:
        x, y = root[i[live]], root[j[live]]
        live = live[x != y]
        if not len(live):
            return np.concatenate(taken) if taken else live
        x, y = root[i[live]], root[j[live]]
        first = np.full(n, len(live))
        np.minimum.at(first, np.concatenate([x, y]), np.tile(np.arange(len(live)), 2))
        pick = np.unique(first[first < len(live)])
        taken.append(live[pick])
        x, y = x[pick], y[pick]
        while True:  # join what was picked
            x, y = root[x], root[y]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]


class _Rows:
    """Rows of some blocks, sorted by block: id, component c, size n, the shingles v that others may share, and sketches."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.key = np.stack([rows["p"].to_numpy(), rows["block"].to_numpy()])
        self.id, self.c, self.n, self.v = (rows[x].to_numpy() for x in ("id", "c", "n", "v"))
        self.odd = np.frombuffer(b"".join(rows["odd"].to_pylist()), np.uint64).reshape(len(self.id), -1)
        self.level = level(self.n)
        self.up = self.down = self.odd[:, :0]
        if (self.level > 0).any():  # what neighbouring levels have in common
            bits = np.unpackbits(self.odd.view(np.uint8), axis=1)
            self.up = np.packbits(bits[:, : SKETCH // 2], axis=1).view(np.uint64)
            self.down = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1).view(np.uint64)

    def ratio(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each pair of rows: how much of the difference allowed their sketches show; over 1 (or infinite) where the pair can't be alike."""
        big, small = np.maximum(self.n[x], self.n[y]), np.minimum(self.n[x], self.n[y])
        total = self.n[x] + self.n[y]
        able = (self.c[x] != self.c[y]) & (100 * small >= self.percent * big) & ((100 + self.percent) * np.minimum(self.v[x], self.v[y]) >= self.percent * total)
        out = np.full(np.broadcast_shapes(np.shape(x), np.shape(y)), np.inf)
        x, y = np.broadcast_to(x, out.shape)[able], np.broadcast_to(y, out.shape)[able]
        if not len(x):
            return out
        r = np.maximum(self.level[x], self.level[y])
        most = (100 - self.percent) / (100 + self.percent) * total[able] / (1 << r)
        most += (r > 0) * (5 * np.sqrt(most) + 1)
        got = np.zeros(len(x))
        near = self.level[x] == self.level[y]
        for a in range(0, len(x), 1 << 16):
            s = slice(a, a + (1 << 16))
            got[s] = np.bitwise_count(self.odd[x[s]] ^ self.odd[y[s]]).sum(axis=1, dtype=np.int64)
        if not near.all():
            swap = self.level[x] > self.level[y]
            low, high = np.where(swap, y, x)[~near], np.where(swap, x, y)[~near]
            far = np.abs(self.level[low] - self.level[high]) > 1
            got[~near] = np.where(far, 0, np.bitwise_count(self.up[low] ^ self.down[high]).sum(axis=1, dtype=np.int64))
        out[able] = got / np.maximum(most, 1e-9)
        return out

    def pairs(self, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, ratio) of the rows of one block that pass; of large blocks, if best, each row's BEST ones."""
        starts = np.flatnonzero(np.concatenate([[True], (self.key[:, 1:] != self.key[:, :-1]).any(axis=0)]))
        sizes = np.diff(starts, append=len(self.id))
        found: list[tuple] = []

        def keep(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
            ok = w <= 1
            found.append((x[ok], y[ok], w[ok]))

        place = np.arange(len(self.id)) - np.repeat(starts, sizes)
        left = np.repeat(sizes, sizes) - place
        few = np.repeat(sizes, sizes) <= 64
        for d in range(1, 64):  # all small blocks at once, by distance
            x = np.flatnonzero(few & (left > d))
            if not len(x):
                break
            keep(x, x + d, self.ratio(x, x + d))
        for a, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
            every = np.arange(a, a + m)
            names, counts = np.unique(self.c[every], return_counts=True)
            probes = every if best else every[self.c[every] != names[counts.argmax()]]
            for k in range(0, len(probes), 128):
                x, y = np.broadcast_arrays(probes[k : k + 128, None], every[None, :])
                w = self.ratio(x, y)
                if best:
                    order = np.argpartition(w, min(BEST, m - 1), axis=1)[:, :BEST]
                    x, y, w = (np.take_along_axis(z, order, axis=1) for z in (x, y, w))
                keep(x.ravel(), y.ravel(), w.ravel())
        return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _candidates(rows: DataFrame, facts: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of different components that sketches let pass in the blocks of rows (p, block, id); best: spanning forests of them.

    facts: id, c, n, v and odd. A block goes to one task and holds at most some thousand rows.
    """
    limit = 20_000

    def judged(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = _Rows(pa.Table.from_batches(tables), percent)
        i, j, w = own.pairs(best)
        if best:
            order = np.argsort(w, kind="stable")
            i, j = i[order], j[order]
            some = spanning(i, j, len(own.id))
            i, j = i[some], j[some]
        a, b = np.maximum(own.id[i], own.id[j]), np.minimum(own.id[i], own.id[j])
        both = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            p, k = batch.column("p").to_numpy(), batch.column("block").to_numpy()
            ends = np.flatnonzero((p[1:] != p[:-1]) | (k[1:] != k[:-1])) + 1
            if waiting and (waiting[-1].column("p")[-1].as_py(), waiting[-1].column("block")[-1].as_py()) != (p[0], k[0]):
                ends = np.concatenate([[0], ends])
            if n + batch.num_rows > limit and len(ends):  # whole blocks go, the last one waits
                end = int(ends[-1])
                waiting.append(batch.slice(0, end))
                yield judged(waiting)
                waiting, n, batch = [], 0, batch.slice(end)
            waiting.append(batch)
            n += batch.num_rows
        if waiting:
            yield judged(waiting)

    laid = rows.join(facts.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id")).select("p", "block", "id", "c", "n", "v", "odd")
    return laid.repartition("p", "block").sortWithinPartitions("p", "block").mapInArrow(run, "a long, b long").distinct()


# Full sets


def shingle_sets(ids: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """id and items (the full set) of ids (id, lo, hi), from the texts.

    A merge join at every size: which side is small changes with the data, and a plan that switches
    would shuffle more than in proportion.
    """
    wanted = ids.select(F.col("id").alias("_id"), "lo", "hi")
    texts = _texts(documents).join(wanted.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        done: set[int] = set()  # rows of one doc_id come to one task
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000).to_pydict()
                names, sets = [], []
                for doc, text, lo, hi in zip(*(part[x] for x in ("doc_id", "text", "lo", "hi")), strict=True):
                    if doc not in done and set_digest(s := shingle_set(text, width, known)) == (lo, hi):
                        done.add(doc)
                        names.append(doc)
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return texts.mapInArrow(run, "id long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("xa"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("xb"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    return both.where(100 * common >= percent * (F.size("xa") + F.size("xb") - common)).select("a", "b")


# Regions that were cut


def _lonely(sets: DataFrame) -> DataFrame:
    """id and u: how many of a set's shingles no other of the sets has. Counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                items = batch.column("items").slice(a, 2000)
                owner = np.repeat(batch.column("id").slice(a, 2000).to_numpy(), items.value_lengths().to_numpy())
                p, first, n = np.unique(items.flatten().to_numpy(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(owner[first]), pa.array(n)], names=["p", "id", "k"])

    one = sets.select("id", "items").mapInArrow(run, "p long, id long, k long").groupBy("p").agg(F.sum("k").alias("k"), F.min("id").alias("id")).where("k = 1")
    return one.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("u"))


def rarest(crowd: DataFrame, percent: int) -> DataFrame:
    """Rows (p, id, c) of crowd (id, c, items): p are the shingles of the set's prefix, rarest first, as long as the filter needs.

    Shingles that only one member has are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            hits += np.bincount(batch.column("items").flatten().to_numpy() % COUNTERS, minlength=COUNTERS)
        used = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(hits[used])], names=["slot", "n"])

    hits = crowd.select("items").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[hits.column("slot").to_numpy()] = hits.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [np.zeros(0, np.int64)], []
            for items in batch.column("items"):
                x = items.values.to_numpy()
                n = often[x % COUNTERS]
                first = np.lexsort((x, n))[: len(x) + percent * len(x) // -100 + 1]
                found.append(x[first][n[first] > 1])
                size.append(len(found[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *[pa.array(np.repeat(batch.column(k).to_numpy(), size)) for k in ("id", "c")]], names=["p", "id", "c"])

    return crowd.select("id", "c", "items").mapInArrow(run, "p long, id long, c long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (p, id, c) with several components for p, as p, block, id: each pair of different components meets in a block of bounded size.

    Of a frequent p each block holds a part of the members, and all blocks hold the members outside
    its most frequent component.
    """
    counts = rows.groupBy("p", "c").agg(F.count("*").alias("k")).groupBy(F.col("p").alias("_p")).agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("top")).where("m > top.k")
    named = rows.join(counts.select("_p", "m", F.col("top.c").alias("most")).hint("merge"), F.col("p") == F.col("_p"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts)
    every = F.when(F.col("c") == F.col("most"), F.array(mine.cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))
    return named.select("p", F.explode(every).alias("block"), "id")


def _crowd(trees: DataFrame, label: DataFrame) -> DataFrame:
    """id and c of the members of cut regions that hold several components."""
    cut = trees.where("cut").select(F.col("p").alias("_p")).distinct()
    inside = trees.join(cut.hint("merge"), F.col("p") == F.col("_p"), "left_semi").select("p", "id")
    named = inside.join(label.select(F.col("node").alias("_n"), "component").hint("merge"), F.col("id") == F.col("_n"), "left").select("p", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select(F.col("p").alias("_p"))
    return named.join(mixed.hint("merge"), F.col("p") == F.col("_p"), "left_semi").select("id", "c").distinct()


def links_of(reps: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the representatives that have links to a smaller one."""
    spark = documents.sparkSession
    facts = reps.select("id", "n", F.col("n").alias("v"), "odd")
    trees = stored(forest(reps, *layout(percent)), "forest")
    pairs = stored(_candidates(trees, facts.withColumn("c", F.col("id")), percent, True), "candidates")
    several = trees.where("cut").select(F.col("p").alias("_p")).distinct()
    crowded = trees.join(several.hint("merge"), F.col("p") == F.col("_p"), "left_semi").select("id")
    asked = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(crowded.select(F.col("id").alias("a"))).distinct()
    sets = stored(shingle_sets(reps.join(asked.hint("merge"), F.col("id") == F.col("a"), "left_semi"), documents, width), "shingle-sets")
    links = stored(confirmed(pairs, sets, percent), "links")
    label = components(links)

    def named(df: DataFrame) -> DataFrame:
        return df.join(label.select(F.col("node").alias("_n"), "component").hint("merge"), F.col("id") == F.col("_n"), "left").withColumn("c", F.coalesce("component", "id")).drop("_n", "component")

    more = _candidates(trees, named(facts), percent, False)
    used = [trees, pairs, sets, links]
    if not trees.where("cut").isEmpty():
        crowd = stored(_crowd(trees, label).join(sets.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id")).select("id", "c", "items"), "forest-crowd")
        prefix = stored(rarest(crowd, percent), "forest-prefixes")
        shared = facts.drop("v").join(_lonely(crowd).hint("merge"), F.col("id") == F.col("_id"), "left").withColumn("v", F.col("n") - F.coalesce("u", F.lit(0))).drop("_id", "u")
        more = more.unionByName(_candidates(in_blocks(prefix), named(shared), percent, False)).distinct()
        used += [crowd, prefix]
    tested = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    more = stored(more.join(tested.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "candidates")
    again = stored(confirmed(more, sets, percent), "links")
    if not again.isEmpty():
        before = label
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(again))
        used.append(before)
    drop_stored(*used, more, again)
    return label


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row."""
    sigs = stored(signatures(documents, width), "signatures")
    classes = stored(representatives(sigs), "representatives")
    reps = _one_by_id(classes)
    label = links_of(reps, documents, width, percent)
    # One row for each distinct set; the join's sides are plain exchanges, so that a set with very many copies can be split.
    found = classes.select("id", F.col("n").alias("_n"), "lo", "hi").join(label.hint("merge"), F.col("id") == F.col("node"), "left").select("lo", "hi", "_n", F.coalesce("component", "id").alias("class_id"))
    joined = sigs.select("doc_id", "n_shingles", "set_lo", "set_hi").join(found.hint("merge"), (F.col("lo") == F.col("set_lo")) & (F.col("hi") == F.col("set_hi")) & (F.col("n_shingles") == F.col("_n")), "left")
    found = joined.withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("class_id", "doc_id")))
    found = stored(found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-duplicates")
    drop_stored(sigs, classes, label, *([reps] if reps is not classes else []))
    return found


def deduplicate(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are their component's smallest doc_id, one row of each, with the columns given.

    Documents without words and rows without a doc_id are kept; of rows that repeat a doc_id the first by content stays.
    """
    key, names = inner("key"), documents.columns
    kept = near_duplicates(documents, width, percent).where("kept").select(F.col("doc_id").alias(key)).distinct()
    whole = documents.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")
    several = documents.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(inner("n"))).where((F.col(inner("n")) > 1) & F.col(key).isNotNull()).select(key)
    if several.isEmpty():
        return whole
    once = whole.join(several, F.col("doc_id") == F.col(key), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    again = whole.join(several, F.col("doc_id") == F.col(key), "left_semi").groupBy(F.col("doc_id").alias(key)).agg(F.min_by(row, F.to_json(row)).alias(inner("row")))
    return once.unionByName(again.select(F.col(inner("row")).alias("x")).select("x.*"))
