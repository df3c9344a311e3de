"""Canonical length-limited Huffman codes for token ids, with block encoding and table-driven decoding.

Code lengths come from global counts by package-merge; codes are canonical, so the lengths alone
name the code. A block holds whole documents and, every `LANE` ids, a checkpoint with its bit
offset: blocks decode without each other, and within a block all checkpoints decode side by side.
"""

from __future__ import annotations

import struct

import numpy as np

LANE = 256
PIECE = 1 << 14
_HEAD = struct.Struct("<4sIQQI")
_MAGIC = b"HUFB"


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that never occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, []
    for _ in range(limit):
        kinds.append(None)
        # Merge the leaves with packages of two neighbours of the level before.
        if len(kinds) > 1:
            packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaves, packages])
            rank = np.argsort(both, kind="stable")
            kinds[-1] = rank < n
            level = both[rank]
        else:
            kinds[-1] = np.ones(n, bool)
    need = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        taken = int(is_leaf[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes and the decoding table of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        self.width = int(self.lengths.max()) if len(used) else 1
        if self.width > 24:
            raise ValueError("codes over 24 bits")
        order = used[np.lexsort((used, self.lengths[used]))]
        own = self.lengths[order].astype(np.int64)
        spans = np.left_shift(1, self.width - own)
        firsts = np.cumsum(spans) - spans
        if len(own) and firsts[-1] + spans[-1] > 1 << self.width:
            raise ValueError("lengths are no prefix code")
        self.wide = self.lengths.astype(np.int64)
        self.codes = np.zeros(len(self.lengths), np.int64)
        self.codes[order] = firsts >> (self.width - own)
        # Entry: id and code length of the code that begins a window of `width` bits.
        self.table = np.zeros(1 << self.width, np.int64)
        self.table[: int(spans.sum())] = np.repeat(order << 5 | own, spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(payload of big-endian 32-bit units, bit offset of every LANE-th id, bits)."""
        sizes = np.bincount(ids, minlength=len(self.lengths))
        if (self.lengths[: len(sizes)][sizes[: len(self.lengths)] > 0] == 0).any() or len(sizes) > len(self.lengths):
            raise ValueError("an id has no code")
        bits = int((sizes * self.lengths).sum())
        units = np.zeros(bits // 32 + 2)  # sums of disjoint bits below 2^32: exact in doubles
        marks = np.empty(-(-len(ids) // LANE), "<u8")
        begin = 0
        for a in range(0, len(ids), PIECE):  # pieces that stay in the processor's cache
            part = ids[a : a + PIECE]
            own = self.wide[part]
            ends = np.cumsum(own)
            ends += begin
            starts = ends - own
            begin = int(ends[-1])
            marks[a // LANE : a // LANE + -(-len(part) // LANE)] = starts[::LANE]
            value = self.codes[part] << (63 - own - (starts & 31))  # the code in 63 bits from its unit's first bit on
            unit = starts >> 5
            base = int(unit[0])
            unit -= base
            high = np.bincount(unit, weights=value >> 31)
            units[base : base + len(high)] += high
            low = np.bincount(unit, weights=(value & 0x7FFFFFFF) << 1)
            units[base + 1 : base + 1 + len(low)] += low
        return units.astype(np.uint32).astype(">u4"), marks, bits

    def decode(self, payload: np.ndarray, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; all lanes advance one id at a time."""
        if not n:
            return np.zeros(0, np.int64)
        units = payload.astype(np.uint64)
        pairs = (units[:-1] << np.uint64(32)) | units[1:]
        at = checkpoints.astype(np.int64)
        lanes = len(at)
        out = np.zeros((LANE, lanes), np.int64)
        mask, shift = np.uint64((1 << self.width) - 1), 64 - self.width
        tail = n - (lanes - 1) * LANE
        for step in range(LANE):
            if step == tail:
                lanes -= 1
                at = at[:lanes]
            if not lanes:
                break
            entry = self.table[((pairs[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)]
            out[step, :lanes] = entry >> 5
            at = at + (entry & 31)
        return out.T.reshape(-1)[:n]


def pack(book: Codebook, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: head, doc_ids, ids per document, checkpoints, payload."""
    payload, marks, bits = book.encode(ids)
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), bits, len(marks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), marks.tobytes(), payload.tobytes()])


def unpack(book: Codebook, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a block."""
    magic, docs, n, bits, marks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    checkpoints = np.frombuffer(data, "<u8", marks, at + 16 * docs)
    payload = np.frombuffer(data, ">u4", bits // 32 + 2, at + 16 * docs + 8 * marks)
    return doc_ids, counts, book.decode(payload, checkpoints, n)
