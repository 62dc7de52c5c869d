"""Diffs: line numbers of patches, whole-PR diffs, ranges and overlaps.

A patch is in one row already, so it is parsed there, by a small line counter in Arrow batches: nothing is shuffled, and
rows that share a key, or have none, don't mix.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..tables import append_columns

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NAME = r'(?:{0}/(.*)|("{0}/(?:[^"\\]|\\.)*"))'
GIT = re.compile("^diff --git " + _NAME.format("a").replace("(.*)", "(.*?)") + " " + _NAME.format("b") + "$")
SAME = re.compile("^diff --git a/(.*) b/\\1$")
MOVED = re.compile(r"^(?:rename|copy) (from|to) (.*)$")
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
ESCAPED = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}
PARSED = "added_lines array<int>, removed_lines array<int>, added_ranges array<struct<start:int,end:int>>"


def ranges_from_lines(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Distinct lines of a key -> contiguous ranges (keys, start, end)."""
    numbered = lines.select(*keys, line).where(F.col(line).isNotNull()).distinct()
    island = numbered.withColumn("__g", F.col(line) - F.row_number().over(W.partitionBy(*keys).orderBy(line)))
    return island.groupBy(*keys, "__g").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("__g")


def contiguous(lines: Column) -> Column:
    """Sorted distinct lines as an array of ranges (start, end)."""
    begins = F.filter(lines, lambda x, i: F.coalesce(F.get(lines, i - 1) < x - 1, F.lit(True)))
    ends = F.filter(lines, lambda x, i: F.coalesce(F.get(lines, i + 1) > x + 1, F.lit(True)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def changed_ranges(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, added_ranges) of a table of lines, one row a key: a set of lines for each file, combined before the one shuffle."""
    found = lines.where(F.col(line).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(line)).alias("__lines"))
    return found.select(*keys, contiguous(F.col("__lines")).alias("added_ranges"))


def touches(ranges: Column, start: Column, end: Column) -> Column:
    """Whether start..end overlaps a range of the array; false for null or none."""
    return F.coalesce(F.exists(ranges, lambda r: (end >= r["start"]) & (start <= r["end"])), F.lit(False))


def contains_line(ranges: Column, line: Column) -> Column:
    return touches(ranges, line, line)


class Counted:
    """Old and new line numbers over the lines of one file's hunks."""

    def __init__(self) -> None:
        self.added: list[int] = []
        self.removed: list[int] = []
        self.inside = False
        self.old = self.new = self.old_left = self.new_left = 0

    def take(self, line: str) -> None:
        kind = line[:1] or " "
        if kind == "@" and (hunk := HUNK.match(line)):
            self.inside = True
            self.old, self.new = int(hunk[1]), int(hunk[3])
            self.old_left, self.new_left = (int(x) if x is not None else 1 for x in (hunk[2], hunk[4]))
        elif not self.inside:
            return
        elif kind == "+":
            self.added.append(self.new)
            self.new += 1
            self.new_left -= 1
        elif kind == "-":
            self.removed.append(self.old)
            self.old += 1
            self.old_left -= 1
        elif kind == " ":
            self.new += 1
            self.new_left -= 1
            self.old += 1
            self.old_left -= 1

    def row(self) -> tuple[list[int], list[int]]:
        return sorted(set(self.added)), sorted(set(self.removed))


def _offsets(lists: list[list]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())


def _numbers(lists: list[list[int]]) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(lists), pa.array([n for x in lists for n in x], pa.int32()))


def _ranges(lists: list[list[int]]) -> pa.Array:
    """Sorted lines as ranges, for all lists at once: one begins at each list's first line and after each gap."""
    ends = np.cumsum([len(x) for x in lists])
    flat = np.array([n for x in lists for n in x], np.int64)
    begins = np.ones(len(flat), bool)
    begins[1:] = flat[1:] != flat[:-1] + 1
    begins[[e for e in ends if e < len(flat)]] = True
    closes = np.append(begins[1:], True)[: len(flat)]
    count = np.concatenate([[0], np.cumsum(begins)])
    spans = pa.StructArray.from_arrays([pa.array(flat[begins], pa.int32()), pa.array(flat[closes], pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(count[np.concatenate([[0], ends]).astype(int)], pa.int32()), spans)


def _columns(rows: list[tuple[list[int], list[int]]]) -> list[pa.Array]:
    """The PARSED columns of (added, removed) lines."""
    added, removed = [r[0] for r in rows], [r[1] for r in rows]
    return [_numbers(added), _numbers(removed), _ranges(added)]


def _lines(text: str) -> list[str]:
    return text.removesuffix("\n").split("\n")


def _patch(patch: str | None) -> tuple[list[int], list[int]]:
    counted = Counted()
    for line in _lines(patch or ""):
        counted.take(line)
    return counted.row()


def parse_file_patches(files: DataFrame, patch: str = "patch", keep: list[str] | None = None) -> DataFrame:
    """Every file (or its columns to `keep`) with added_lines, removed_lines and added_ranges; empty arrays for null, or where there are no hunks.

    Numbers count from the hunk headers' starts, whatever lengths the headers state.
    """
    return append_columns(files, patch, PARSED, lambda patches: _columns([_patch(p) for p in patches]), keep=keep)


def patch_line_numbers(files: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """(keys, side, line) for the added and removed lines of each file's patch; none for null or no hunks."""
    parsed = parse_file_patches(files, patch, keep=keys)
    side = lambda name: F.transform(f"{name}_lines", lambda x: F.struct(F.lit(name).alias("side"), x.alias("line")))
    return parsed.select(*keys, F.inline(F.concat(side("added"), side("removed"))))


def unquoted(name: str) -> str:
    """A file name as git writes it: in double quotes with C escapes if it has special characters."""
    if len(name) < 2 or name[0] != '"' or name[-1] != '"':
        return name
    plain = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPED.get(m[1], m[1]), name[1:-1].encode())
    return plain.decode("utf-8", "replace")


def _name(line: str, prefix: str) -> str:
    return unquoted(line[4:].partition("\t")[0]).removeprefix(prefix)


def _git_names(line: str) -> tuple[str | None, str | None]:
    """Both names of a `diff --git` line; unless they are the same, ` b/` may be part of either, and other lines tell."""
    if same := SAME.match(line):
        return same[1], same[1]
    if names := GIT.match(line):
        old, old_quoted, new, new_quoted = names.groups()
        return old if old is not None else unquoted(old_quoted).removeprefix("a/"), new if new is not None else unquoted(new_quoted).removeprefix("b/")
    return None, None


File = tuple[str, str, tuple[list[int], list[int]]]


def _files(diff: str | None) -> list[File]:
    """The files of a whole diff, the last of each path.

    In a git diff only `diff --git` begins a file. In a plain one a `---`, `+++` pair does, unless the hunk that it
    stands in still lacks an old and a new line, which the pair then is.
    """
    found: dict[str, File] = {}
    lines = _lines(diff or "")
    git, old, new = False, None, None
    counted: Counted | None = None

    def close() -> None:
        if counted is not None and old is not None and new is not None:
            status = "added" if old == "/dev/null" else "removed" if new == "/dev/null" else "renamed" if old != new else "modified"
            path = old if new == "/dev/null" else new
            found.pop(path, None)
            found[path] = (path, status, counted.row())

    for i, line in enumerate(lines):
        kind = line[:1]
        if kind == "d" and line.startswith("diff --git "):
            close()
            git, counted, (old, new) = True, Counted(), _git_names(line)
        elif kind == "-" and not git and line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ ") and not (counted is not None and counted.inside and counted.old_left > 0 and counted.new_left > 0):
            close()
            counted, old, new = Counted(), _name(line, "a/"), _name(lines[i + 1], "b/")
        elif counted is None:
            continue
        elif kind in "rc" and not counted.inside and (moved := MOVED.match(line)):
            old, new = (unquoted(moved[2]), new) if moved[1] == "from" else (old, unquoted(moved[2]))
        elif kind == "-" and not counted.inside and line.startswith("--- "):
            old = _name(line, "a/")
        elif kind == "+" and not counted.inside and line.startswith("+++ "):
            new = _name(line, "b/")
        else:
            counted.take(line)
    close()
    return list(found.values())


def parse_unified_diffs(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """Whole diffs -> one row a file: keys, path, status, added_lines, removed_lines, added_ranges. The last of a path wins."""
    kind = f"files array<struct<path:string,status:string,{PARSED.replace(' array', ':array').replace(', ', ',')}>>"

    def parse(texts: list[str | None]) -> list[pa.Array]:
        found = [_files(x) for x in texts]
        flat = [f for x in found for f in x]
        fields = [pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string()), *_columns([f[2] for f in flat])]
        return [pa.ListArray.from_arrays(_offsets(found), pa.StructArray.from_arrays(fields, ["path", "status", "added_lines", "removed_lines", "added_ranges"]))]

    return append_columns(diffs, diff, kind, parse, keep=keys).select(*keys, F.inline("files"))
