"""Unified diffs of suggested fixes, by an edit script in linear space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, fenced_code, range_anchored, split_lines

#: Unchanged lines around a hunk.
CONTEXT = 3


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """A run of equal items (x, y, u, v: from a[x] and b[y] to a[u] and b[v]) in the middle of a shortest edit script.

    Furthest paths from both ends, diagonal by diagonal, until they overlap: only the last
    frontier of each is kept.
    """
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while 0 <= y and x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while 0 <= y and x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("the paths always meet")


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if k < 0:  # a finished run
            out += [(i + t, j + t) for t in range(m)]
            continue
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        tail = 0
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m, tail = j - 1, m - 1, tail + 1
        if tail:
            todo.append((j, m, -1, tail))
        if i < j and k < m:
            x, y, u, v = _middle(a[i:j], b[k:m])
            todo.append((i + u, j, k + v, m))
            todo.append((i + x, k + y, -1, u - x))
            todo.append((i, i + x, k, k + y))
    return out


def unified(old: list[str], new: list[str], path: str, first: int = 1) -> str:
    """The diff of two lists of lines (each with its end) whose first line is line ``first`` of the file; empty if they are equal."""
    same = [(-1, -1), *matches(old, new), (len(old), len(new))]
    changes = [(i + 1, u, k + 1, v) for (i, k), (u, v) in zip(same, same[1:]) if u - i > 1 or v - k > 1]
    hunks: list[list[tuple[int, int, int, int]]] = []
    for c in changes:
        # Hunks whose unchanged lines would meet are one.
        if hunks and c[0] - hunks[-1][-1][1] <= 2 * CONTEXT:
            hunks[-1].append(c)
        else:
            hunks.append([c])
    out = [f"--- a/{path}\n", f"+++ b/{path}\n"] if hunks else []
    for h in hunks:
        lead, trail = min(CONTEXT, h[0][0]), min(CONTEXT, len(old) - h[-1][1])
        i, j, k, m = h[0][0] - lead, h[-1][1] + trail, h[0][2] - lead, h[-1][3] + trail
        out.append(f"@@ -{_span(i + first, j - i)} +{_span(k + first, m - k)} @@\n")
        at = i
        for a, b, c, d in h:
            out += [f" {x}" for x in old[at:a]] + [f"-{x}" for x in old[a:b]] + [f"+{x}" for x in new[c:d]]
            at = b
        out += [f" {x}" for x in old[at:j]]
    return "".join(out)


def _span(start: int, n: int) -> str:
    """Line and number of lines; an empty span is told by the line before it."""
    return f"{start}" if n == 1 else f"{start - (n == 0)},{n}"


def patches(findings: DataFrame, files: DataFrame, keys: list[str], scan: str = "scan_id", index: str = "finding_index", path: str = "path", content: str = "content") -> DataFrame:
    """keys, name, patch of the findings whose fix is a code block for lines that the file has.

    findings: scan, index, affected_file, affected_lines, suggested_fix; a path is once in
    ``files``.  The name is <scan>_<index>_<file>.patch.  A fix without code, a bad range, or a
    file that isn't there gives no row, a fix that changes nothing an empty patch.  Only the
    lines around the range go to Python, so a file costs its own length once a finding.
    """
    start, end = range_anchored(F.col("affected_lines"))
    f = files.select(F.col(path).alias("affected_file"), split_lines(F.col(content)).alias("__sl_lines"))
    wanted = findings.select(*keys, F.col(scan).alias("__sl_scan"), F.col(index).alias("__sl_index"), "affected_file", start.alias("__sl_s"), end.alias("__sl_e"), fenced_code(F.col("suggested_fix")).alias("__sl_code"))
    wanted = wanted.filter("__sl_code IS NOT NULL AND __sl_s >= 1 AND __sl_s <= __sl_e")
    met = wanted.join(f, "affected_file").filter("__sl_e <= size(__sl_lines)")
    s, e = F.col("__sl_s").cast("int"), F.col("__sl_e").cast("int")
    cut = lambda a, n: F.slice("__sl_lines", a, n)
    lead = F.least(s - 1, F.lit(CONTEXT))
    name = F.concat_ws("_", F.col("__sl_scan").cast("string"), F.col("__sl_index").cast("string"), F.concat(basename(F.col("affected_file")), F.lit(".patch")))
    told = met.select(*keys, name.alias("name"), F.col("affected_file").alias("file"), (s - lead).alias("first"), cut(s - lead, lead).alias("before"), cut(s, e - s + 1).alias("old"), cut(e + 1, F.lit(CONTEXT)).alias("after"), split_lines(F.col("__sl_code")).alias("new"))
    n = len(keys)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in told.schema[:n]) + ", name string, patch string"
    return told.mapInArrow(lambda it: _diffs(it, n), schema)


def _diffs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for file, first, before, old, after, new in zip(*(b.column(i).to_pylist() for i in range(n + 1, n + 7))):
            before, old, after, new = ([f"{x}\n" for x in lines or []] for lines in (before, old, after, new))
            out.append(unified(before + old + after, before + new + after, file, first))
        yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(out, pa.string())], b.schema.names[: n + 1] + ["patch"])
