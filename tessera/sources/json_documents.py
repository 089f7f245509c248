"""Single JSON documents, read and written in parallel.

Reading: the document is split at closing braces by Spark's splittable text source, so its blocks are read by as many tasks, on
any file system. A block alone does not tell whether it begins inside a string, nor how deep. A first pass therefore reduces each
block, for both cases, to what it leaves open (whether a string is open at its end, how many brackets it closes, which it opens);
these reductions, one row per block, are chained on the driver. With its true start every block then cuts out its elements; an
element that goes over block ends is put together from its parts.

Writing: rows are written as text in their final order, the lengths of the parts give each its place in the file, and the tasks
write their parts there, at once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import stored

_ESCAPE = re.compile(r"\\.", re.S)
_OTHER = re.compile(r"[^][{}]+")
_GAP = re.compile(r'"((?:[^"\\]|\\.)*)"\s*(:?)|[][{}]|"', re.S)
#: Elements that a task holds at a time.
ROWS = 4096
_PART = "path string, block long, seq long, kind string, key string, text string"


def _reduced(closed: int, opened: str, brackets: str) -> tuple[int, str]:
    """(brackets closed that were open before, brackets left open) after more brackets."""
    was = None
    while was != brackets:
        was, brackets = brackets, brackets.replace("[]", "").replace("{}", "")
    for b in brackets:
        if b in "[{":
            opened += b
        elif opened:
            opened = opened[:-1]
        else:
            closed += 1
    return closed, opened


class _Open:
    """What a text leaves open, for a start outside (0) and inside (1) a string."""

    def __init__(self) -> None:
        self.inside, self.closed, self.opened = [False, True], [0, 0], ["", ""]

    def add(self, segment: str, brace: bool) -> None:
        parts = (_ESCAPE.sub("", segment) if "\\" in segment else segment).split('"')
        for s in (0, 1):
            out = _OTHER.sub("", "".join(parts[int(self.inside[s]) :: 2]))
            self.inside[s] ^= len(parts) % 2 == 0
            self.closed[s], self.opened[s] = _reduced(self.closed[s], self.opened[s], out + ("}" if brace and not self.inside[s] else ""))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, size, value): the document's segments in order; every one but a file's last ended at a closing brace."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for b in batches:
        for p, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield (p, k), v


def _starts(segments: DataFrame) -> dict[tuple[str, int], tuple[bool, str, bool]]:
    """(inside a string, open brackets, whether the file's last block) at each block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], _Open] = {}
        for at, value in _runs(batches):
            found.setdefault(at, _Open()).add(value, True)
        rows = [(p, b, s, o.inside[s], o.closed[s], o.opened[s]) for (p, b), o in found.items() for s in (0, 1)]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "block", "start", "inside", "closed", "opened"])

    kept = segments.mapInArrow(run, "path string, block long, start int, inside boolean, closed long, opened string").collect()  # two rows per block
    step = {(r.path, r.block, bool(r.start)): r for r in kept}
    out: dict[tuple[str, int], tuple[bool, str, bool]] = {}
    for path in sorted({r.path for r in kept}):
        inside, stack = False, ""
        blocks = sorted({r.block for r in kept if r.path == path})
        for b in blocks:
            out[path, b] = (inside, stack, b == blocks[-1])
            r = step[path, b, inside]
            if b == blocks[-1]:  # its last segment was counted with a brace, which a file that ends otherwise does not have
                if r.inside or r.opened or r.closed - len(stack) not in (0, 1):
                    raise ValueError(f"{path} is no whole JSON document")
                break
            inside, stack = r.inside, stack[: len(stack) - r.closed] + r.opened
    return out


class _Cutter:
    """Cuts a block's elements out, from its true start on. Elements are the objects of a top-level array or of the arrays of a
    top-level object (whose keys hold no closing brace)."""

    def __init__(self, inside: bool, stack: str) -> None:
        self.inside, self.stack, self.key, self.rows = inside, stack, None, []
        self.cur: list[str] | None = [] if stack.startswith(("[{", "{[{")) else None
        self.begun = False

    def _level(self) -> str:
        return "[" if self.stack.startswith("[") else "{["

    def add(self, segment: str, brace: bool) -> None:
        if self.cur is None:
            segment = self._gap(segment)
            if self.cur is None:
                if brace and not self.inside:
                    self.stack = self.stack[:-1]
                return
        self.cur.append(segment)
        parts = (_ESCAPE.sub("", segment) if "\\" in segment else segment).split('"')
        out = _OTHER.sub("", "".join(parts[int(self.inside) :: 2]))
        self.inside ^= len(parts) % 2 == 0
        closed, opened = _reduced(0, "", out + ("}" if brace and not self.inside else ""))
        self.stack = self.stack[: len(self.stack) - closed] + opened
        if brace:
            self.cur.append("}")
        if self.stack == self._level():
            self.rows.append(("e" if self.begun else "h", self.key if self.begun else None, "".join(self.cur)))
            self.cur = None

    def _gap(self, segment: str) -> str:
        """Follows what stands between elements; gives what is left from an element's start on."""
        at = 0
        if self.inside:  # a string of no element goes on
            end = re.match(r'(?:[^"\\]|\\.)*"', segment, re.S)
            if end is None:
                return ""
            self.inside, at = False, end.end()
        while m := _GAP.search(segment, at):
            at, mark = m.end(), m[0]
            if mark == '"':
                self.inside = True
                return ""
            if mark[0] == '"':
                if m[2] and self.stack == "{":
                    self.key = json.loads(f'"{m[1]}"')
            elif mark in "]}":
                self.stack = self.stack[:-1]
            elif mark == "{" and self.stack and self.stack == self._level():
                self.cur, self.begun = [], True
                return segment[m.start() :]
            else:
                self.stack += mark
        return ""

    def done(self) -> list[tuple[str, str | None, str]]:
        if self.cur is not None:
            self.rows.append(("t" if self.begun else "m", self.key if self.begun else None, "".join(self.cur)))
        return self.rows


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[bool, str, bool]]) -> Iterator[pa.RecordBatch]:
    """Rows of _PART of the blocks' segments, at most ROWS and the block's last ones at a time."""

    def out(at: tuple[str, int], first: int, rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*at, first + i, *r) for i, r in enumerate(rows)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["path", "block", "seq", "kind", "key", "text"])

    at, held, cutter, given = None, None, None, 0
    for here, value in _runs(batches):
        if here != at:
            if at is not None:
                cutter.add(held, not starts[at][2])
                yield out(at, given, [*cutter.done(), ("k", cutter.key, None)])
            at, held, cutter, given = here, None, _Cutter(*starts[here][:2]), 0
        if held is not None:
            cutter.add(held, True)
            if len(cutter.rows) >= ROWS:
                yield out(at, given, cutter.rows)
                given, cutter.rows = given + len(cutter.rows), []
        held = value
    if at is not None:
        cutter.add(held, not starts[at][2])
        yield out(at, given, [*cutter.done(), ("k", cutter.key, None)])


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, block, seq, element): the objects in a document's arrays as JSON text, key null in a top-level array; (block,
    seq) is their order. Kept as a table, so that several tables of one document parse it once."""
    segments = _blocks(spark, path)
    starts = _starts(segments)

    parts = stored(segments.mapInArrow(lambda batches: _cut(batches, starts), _PART), "json-parts")
    along = Window.partitionBy("path").orderBy("block")  # a row per block
    keys = parts.where("kind = 'k'").select("path", "block", F.last("key", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_key"))
    named = parts.where("kind in ('e', 't')").join(keys, ["path", "block"]).withColumn("key", F.coalesce("key", "_key")).drop("_key")
    # of an element over block ends: its first part, whole blocks, its last part
    pieces = named.where("kind = 't'").unionByName(parts.where("kind in ('h', 'm')"))
    group = F.max(F.when(F.col("kind") == "t", F.col("block"))).over(Window.partitionBy("path").orderBy("block", "seq"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "")
    first = lambda c: F.max(F.when(F.col("kind") == "t", F.col(c))).alias(c)
    joined = pieces.withColumn("_g", group).groupBy("path", "_g").agg(first("key"), first("block"), first("seq"), text.alias("element")).drop("_g")
    return named.where("kind = 'e'").select("path", "key", "block", "seq", F.col("text").alias("element")).unionByName(joined.select("path", "key", "block", "seq", "element"))


def written(path: str, parts: list[tuple[str, DataFrame, str]]) -> None:
    """Writes path (a mounted folder's file): per part its opening text, its rows as JSON objects with commas between, and its
    closing text. Rows are in the order of their partitions; every task writes its own place in the file."""
    aside, at, jobs = f"{path}.tmp", 0, []
    for before, rows, after in parts:
        lines = stored(rows.select(F.to_json(F.struct("*")).alias("j")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "json-lines")
        sizes = sorted((r["_p"], r["n"]) for r in lines.groupBy("_p").agg(F.sum(F.octet_length("j") + 1).alias("n")).collect())
        jobs.append((at, before.encode(), None, None))
        at += len(before.encode())
        offsets = {}
        for k, (p, n) in enumerate(sizes):
            offsets[p] = (at, k == len(sizes) - 1)
            at += n - (k == len(sizes) - 1)  # no comma after the last row
        jobs.append((at, after.encode(), lines, offsets))
        at += len(after.encode())
    with open(aside, "wb") as f:
        f.truncate(at)
        for where, text, *_ in jobs:
            f.seek(where)
            f.write(text)
    for _, _, lines, offsets in jobs:
        if offsets:
            _fill(lines, aside, offsets)
    os.replace(aside, path)


def _fill(lines: DataFrame, path: str, offsets: dict[int, tuple[int, bool]]) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, 0
        with open(path, "r+b") as f:
            for b in batches:
                for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if p != part:
                        part, place = p, offsets[p][0]
                        first = True
                        f.seek(place)
                    f.write((b"" if first else b",") + text.encode())
                    first = False
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["done"])

    sorted_ = lines.repartition(F.col("_p")).sortWithinPartitions("_p", "_i").select("_p", "j")
    sorted_.mapInArrow(run, "done int").count()
    with open(path, "r+b") as f:  # the commas between parts
        for start, _ in sorted(offsets.values())[1:]:
            f.seek(start - 1)
            f.write(b",")
