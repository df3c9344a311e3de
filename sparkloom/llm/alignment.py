"""Alignment of two tokenizers: groups of tokens between shared byte offsets, links within groups, and their counts.

Python only encodes: it gives each text's ids and the byte offsets at which its tokens end, for both
tokenizers. All else is Spark's array functions: the shared ends (`array_intersect`) cut the text
into groups, `transform` takes the ids of each from slices, and every pair of ids of one
group is a link. A pair's count is the number of documents that hold it.

A document's work is linear in its tokens: shared ends find their tokens by sorting them into the
other ends, not by searching. Counts are matched by a broadcast of the frequent pairs, at most
HEAVY of them, and by a shuffle of the rest, whose keys are rare by definition.

Edge cases: texts that are null or empty, or whose tokens' bytes differ from a space and the text
(such as a text with U+2581), have no tokens, zeros and an empty digest. Every row is a document of
its own, whatever its doc_id (null and repeated ids, repeated rows); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, release, stored
from .token_output import _WHOLE, Encoder, _by_bytes

#: Pairs that are broadcast at most, the most frequent ones: some 10 MB.
HEAVY = 200_000
#: A link is one number: the first id times this, plus the second.
_SHIFT = 1 << 32


class PairEncoder:
    """Ids of texts, each behind a space, by a byte-level BPE (first) and by a piece BPE with byte fallback (second).

    Both tokenizers begin a new token at a space behind another character and before a newline, so the
    ids of the pieces between these, joined, are the text's ids; distinct pieces are encoded once a
    batch and cached. Texts with other white space (see `_WHOLE`) are encoded whole.
    """

    def __init__(self, first: str, second: str, cache: int = 150_000):
        from sentencepiece import SentencePieceProcessor

        self.first = Encoder(first, 0, cache)
        self.first.tokenizer.encode_special_tokens = True
        names = self.first.tokenizer.get_vocab()
        self.first_bytes = np.ones(max(names.values()) + 1, np.int64)
        self.first_bytes[list(names.values())] = list(map(len, names))  # each character of an entry stands for one byte
        self.second = SentencePieceProcessor(model_file=second)
        vocabulary = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in vocabulary):
            raise ValueError("a piece goes on behind a space or holds a newline: texts can't be cut into pieces there")
        self.raw = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(vocabulary)]
        self.second_bytes = np.array(list(map(len, self.raw)), np.int64)
        self.space = self.second.piece_to_id("▁")
        self.cache = cache
        self.known: dict[str, bytes | None] = {}

    def _same(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.raw.__getitem__, ids)) == text.encode()

    def _second(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces, those that begin a line without a space, others behind one; None if their bytes differ from the piece's."""
        if len(self.known) > self.cache:
            self.known = {}
        known = self.known
        fresh = [p for p in pieces if p not in known]
        found = self.second.encode(fresh, num_threads=1)
        spaced = [p if p[:1] == "\n" else " " + p for p in fresh]
        for i, p in enumerate(fresh):
            if p[:1] == "\n":
                found[i] = found[i][1:] if found[i][:1] == [self.space] else []
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        ends = 4 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        raw, at = ids.tobytes(), [0, *ends.tolist()]
        blobs: list[bytes | None] = [raw[x:y] for x, y in pairwise(at)]
        # All bytes at once: equal texts with equal cuts are equal pieces.
        sizes = np.concatenate([[0], np.cumsum(self.second_bytes[ids])])[ends >> 2]
        wanted = "".join(spaced).encode()
        if not (np.array_equal(sizes, np.cumsum([len(p.encode()) for p in spaced])) and b"".join(map(self.raw.__getitem__, ids.tolist())) == wanted):
            blobs = [x if self._same(own, p) else None for x, own, p in zip(blobs, found, spaced, strict=True)]
        known.update(zip(fresh, blobs, strict=True))
        return [known[p] for p in pieces]

    def ids(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer: ids of all texts one after the other, and where each text's begin and end (one more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _WHOLE)
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        offsets = lists.offsets.to_numpy()
        second = self._second(pieces)
        first = self.first._blobs([p if p else "\0" for p in pieces])
        whole = texts.take(pa.array(apart)).to_pylist() if len(apart) else []
        more = self.second.encode(whole, num_threads=1) if whole else []
        more = [np.array(x, "<u4").tobytes() if self._same(x, " " + t) else None for x, t in zip(more, whole, strict=True)]
        # A text without tokens is one of no pieces: an empty one, or one with a piece that doesn't come back.
        bad = np.array([x is None for x in second + more] + [False])
        empty = len(bad) - 1
        at = coded.indices.to_numpy().copy()
        at[offsets[apart]] = len(pieces) + np.arange(len(apart))
        gone = np.add.reduceat(bad[at], offsets[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        gone |= (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        at[np.repeat(gone, np.diff(offsets))] = empty
        out = []
        for blobs in (first + (self.first.whole([" " + t for t in whole]) if whole else []), [x or b"" for x in second + more]):
            blobs.append(b"")
            starts = np.zeros(len(blobs) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2, out=starts[1:])
            own = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(blobs), "<u4"))).take(pa.array(at))
            ends = own.offsets.to_numpy()
            out.append((own.values.to_numpy()[ends[0] : ends[-1]], ends[offsets] - ends[0]))
        return out[0], out[1]


_ENCODERS: dict[tuple[str, str], PairEncoder] = {}


def _encoder(first: str, second: str) -> PairEncoder:
    """The worker process's encoder: its caches serve all tasks that the process runs."""
    if (first, second) not in _ENCODERS:
        _ENCODERS[first, second] = PairEncoder(first, second)
    return _ENCODERS[first, second]


def _lists(values: np.ndarray, ends: np.ndarray, kind: type = np.int32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(kind)))


def _inside(lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums of the tokens' bytes, from 0 in each text."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))


def tokens(documents: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id with the ids of both tokenizers (a, b) and twice the byte offsets at which they end (a_end, b_end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(first, second)
        for batch in batches:
            for at, n in _by_bytes(batch.column("text"), 2_000_000):
                columns = [batch.column("doc_id").slice(at, n)]
                for (ids, ends), sizes in zip(encoder.ids(batch.column("text").slice(at, n)), (encoder.first_bytes, encoder.second_bytes), strict=True):
                    columns += [_lists(ids, ends), _lists(2 * _inside(sizes[ids], ends), ends, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "a_end", "b", "b_end"])
        release()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a array<int>, a_end array<long>, b array<int>, b_end array<long>")


def _last(ends: Column, cuts: Column) -> Column:
    """For each cut the index of the token that ends there.

    Cuts are sorted in among the ends that are no cut: before cut g stand g cuts and the other tokens up to it, and each of
    these cuts is a token too, so its place is the index of its token.
    """
    marks = F.sort_array(F.concat(F.array_except(ends, cuts), F.transform(cuts, lambda c: c + 1)))
    return F.array_compact(F.transform(marks, lambda v, i: F.when(v.bitwiseAND(1) == 1, i)))


def aligned(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, texts (each group's ids, `a1,a2|b1`), links (first id * 2^32 + second id)."""
    cut = tokens.withColumn("cuts", F.array_intersect("a_end", "b_end"))
    placed = cut.withColumns({"la": _last(F.col("a_end"), F.col("cuts")), "lb": _last(F.col("b_end"), F.col("cuts"))})
    # Each group's last tokens (la, lb) and those of the group before (pa, pb); the lists of those before are longer by one.
    spans = F.arrays_zip("la", "lb", F.array_prepend("la", F.lit(-1)).alias("pa"), F.array_prepend("lb", F.lit(-1)).alias("pb"))
    at = placed.withColumns({"spans": F.slice(spans, F.lit(1), F.size("cuts")), "first": F.col("a").cast("array<long>"), "a_text": F.col("a").cast("array<string>"), "b_text": F.col("b").cast("array<string>")})

    def group(z: Column) -> Column:
        pick = lambda column, before, last: F.slice(column, before + 2, last - before)
        link = lambda x, y: F.shiftleft(x, 32) + y
        text = F.concat(F.array_join(pick("a_text", z["pa"], z["la"]), ","), F.lit("|"), F.array_join(pick("b_text", z["pb"], z["lb"]), ","))
        links = F.flatten(F.transform(pick("first", z["pa"], z["la"]), lambda x: F.transform(pick("b", z["pb"], z["lb"]), lambda y: link(x, y))))
        # Most groups are of one token each: no lists are made for those.
        one_text = F.concat(F.get("a_text", z["la"]), F.lit("|"), F.get("b_text", z["lb"]))
        one_link = F.array(link(F.get("first", z["la"]), F.get("b", z["lb"])))
        alone = (z["la"] - z["pa"] == 1) & (z["lb"] - z["pb"] == 1)
        return F.when(alone, F.struct(one_text.alias("text"), one_link.alias("links"))).otherwise(F.struct(text.alias("text"), links.alias("links")))

    found = at.select("doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_a"), ("b", "n_b"), ("cuts", "n_groups"))], F.transform("spans", group).alias("own"))
    pairs = F.aggregate("own.links", F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return found.select("doc_id", "n_a", "n_b", "n_groups", pairs.alias("n_links"), F.col("own.text").alias("texts"), F.flatten("own.links").alias("links"))


def digest(texts: str) -> Column:
    """sha256 of the groups as one text, `a1,a2|b1;a3|b2,b3`; an empty text where there are none."""
    return F.when(F.size(texts) > 0, F.sha2(F.array_join(texts, ";"), 256)).otherwise(F.lit(""))


def pair_counts(links: DataFrame) -> DataFrame:
    """link, n (documents that hold it), best (whether n is the highest of its first id), from rows with an array `links`."""
    counts = stored(links.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count("*").alias("n")), "link-counts")
    first = F.shiftright("link", 32)
    # A row for each first id: at most as many as the tokenizer has entries.
    top = counts.groupBy(first.alias("first")).agg(F.max("n").alias("top"))
    found = counts.withColumn("first", first).join(F.broadcast(top), "first").select("link", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    out = stored(found, "link-scores")
    drop_stored(counts)
    return out


def _scores(links: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum: sums over each row's links."""
    held = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("all")).first()
    each = links.select("row", F.explode("links").alias("link"))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    if held["pairs"] <= HEAVY:
        return each.join(F.broadcast(counts), "link").groupBy("row").agg(*sums)
    least = held["all"] // HEAVY + 1  # no more than HEAVY pairs are in so many documents
    heavy, light = F.broadcast(counts.where(F.col("n") >= least)), counts.where(F.col("n") < least)
    often = each.join(heavy, "link").groupBy("row").agg(*sums)
    rare = each.join(heavy, "link", "left_anti").groupBy("row", "link").agg(F.count("*").alias("times")).join(light, "link")
    rare = rare.select("row", (F.col("best") * F.col("times")).alias("best"), (F.col("n") * F.col("times")).alias("n")).groupBy("row").agg(*sums)
    return often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(documents: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    first: a byte-level BPE file for the tokenizers library; second: a sentencepiece model that adds a space.
    """
    rows = aligned(tokens(documents, first, second)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest("texts").alias("groups_sha256"), "links")
    kept = stored(rows.withColumn("row", F.monotonically_increasing_id()), "links")
    scores = _scores(kept, pair_counts(kept))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.drop("links").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
