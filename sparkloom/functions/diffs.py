"""Shortest line scripts between two texts, applied and shown as hunks.

The script comes from the greedy search for a middle snake from both ends, halved again and again, so it takes memory linear
in the lines and time linear in lines x edits; lines that only one side has are set aside first, as no script can keep them.
Python finds the script in Arrow batches; applying it is array functions.

Lines are what stands between newlines, so an empty (or null) text is one empty line. Of several shortest scripts, the one
found is a function of the two texts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of changed lines in order: `removed` lines of the first text from index `at` on give way to `added`.
SCRIPT = "array<struct<at int, removed int, added array<string>>>"
_SCRIPT = pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("added", pa.list_(pa.string()))]))
#: Lines of both texts that a worker holds as Python's objects at once, about; a longer pair is held alone.
HELD = 20_000


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def _furthest(reach: dict[int, int], k: int, n: int, m: int) -> int:
    """The furthest index on diagonal k by one more edit than in `reach`, or -1 if none stays inside n x m."""
    best = reach[k - 1] + 1 if reach.get(k - 1, n) < n else -1
    down = reach.get(k + 1, -1)
    return down if down > best and down - k <= m else best


def _middle(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Where a middle snake of a shortest script begins (in a and in b), and its length."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}  # furthest index on each diagonal, from the beginning and from the end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            start = x = _furthest(ahead, k, n, m)
            if x < 0:
                ahead.pop(k, None)
                continue
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            # With an odd difference the two searches meet in a forward step.
            if delta & 1 and abs(delta - k) < d and x + back.get(delta - k, -n - 1) >= n:
                return start, start - k, x - start
        for k in range(-d, d + 1, 2):
            start = x = _furthest(back, k, n, m)
            if x < 0:
                back.pop(k, None)
                continue
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta & 1 and abs(delta - k) <= d and x + ahead.get(delta - k, -n - 1) >= n:
                return n - x, m - x + k, x - start
    raise AssertionError("the searches meet by then")


def matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, ascending."""
    in_a, in_b = set(a), set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    x, y = [a[i] for i in at_a], [b[j] for j in at_b]
    found, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and x[lo] == y[low]:
            found.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and x[hi - 1] == y[high - 1]:
            hi, high = hi - 1, high - 1
            found.append((hi, high))
        if lo < hi and low < high:
            i, j, n = _middle(x[lo:hi], y[low:high])
            found += [(lo + i + k, low + j + k) for k in range(n)]
            todo += [(lo, lo + i, low, low + j), (lo + i + n, hi, low + j + n, high)]
    return sorted((at_a[i], at_b[j]) for i, j in found)


def changes(a: Sequence, b: Sequence) -> list[tuple[int, int, list]]:
    """(at, removed, added) of each run of changes, as in SCRIPT."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x - i, list(b[j:y])))
        i, j = x + 1, y + 1
    return out


def _span(start: int, n: int) -> str:
    return f"{start + (n > 0)}" if n == 1 else f"{start + (n > 0)},{n}"


def hunks(a: Sequence[str], b: Sequence[str], context: int) -> list[str]:
    """Unified diff lines: changes nearer than twice the context share a hunk."""
    groups: list[list] = []
    for change in changes(a, b):
        if groups and change[0] - sum(groups[-1][-1][:2]) <= 2 * context:
            groups[-1].append(change)
        else:
            groups.append([change])
    out, shift = [], 0
    for group in groups:
        lo, hi = max(0, group[0][0] - context), min(len(a), sum(group[-1][:2]) + context)
        grown = sum(len(added) - removed for _, removed, added in group)
        out.append(f"@@ -{_span(lo, hi - lo)} +{_span(lo + shift, hi - lo + grown)} @@")
        at = lo
        for first, removed, added in group:
            out += [" " + x for x in a[at:first]] + ["-" + x for x in a[first : first + removed]] + ["+" + x for x in added]
            at = first + removed
        out += [" " + x for x in a[at:hi]]
        shift += grown
    return out


def scripts(x: pa.Array, y: pa.Array) -> pa.Array:
    """A shortest SCRIPT for each pair of arrays of lines; only those of about HELD lines at once are Python's objects."""
    out, start = [], 0
    past = np.cumsum([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (x, y)], axis=1).sum(axis=0)
    while start < len(past):
        n = max(1, int(np.searchsorted(past, (past[start - 1] if start else 0) + HELD, "right")) - start)
        pairs = zip(x.slice(start, n).to_pylist(), y.slice(start, n).to_pylist(), strict=True)
        out.append(pa.array([[{"at": i, "removed": r, "added": new} for i, r, new in changes(a, b)] for a, b in pairs], _SCRIPT))
        start += n
    pa.default_memory_pool().release_unused()  # what earlier batches took: workers live on
    return pa.concat_arrays(out) if out else pa.array([], _SCRIPT)


def edit_script(before: Column, after: Column) -> Column:
    """A shortest SCRIPT from one array of lines to another."""

    @F.arrow_udf(SCRIPT)
    def script(x: pa.Array, y: pa.Array) -> pa.Array:
        return scripts(x, y)

    return script(before, after)


def patched(before: Column, script: Column) -> Column:
    """The lines that a script makes of the lines it was found for."""
    end = lambda s: s["at"] + s["removed"]
    past = F.concat(F.array(F.lit(0)), F.transform(script, end))  # where each run's unchanged lines begin
    runs = F.transform(script, lambda s, i: F.concat(F.slice(before, F.get(past, i) + 1, s["at"] - F.get(past, i)), s["added"]))
    last = F.element_at(past, -1)
    return F.concat(F.flatten(runs), F.slice(before, last + 1, F.size(before) - last))


def line_diff(before: Column, after: Column, context: int = 3) -> Column:
    """Changed lines of two texts with lines of context, as unified diff lines."""

    @F.pandas_udf("array<string>")
    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([hunks(list(a), list(b), context) for a, b in zip(x, y, strict=True)])

    return diff(lines(before), lines(after))
