"""Reading big files in byte ranges when the meaning of a range depends on what
stands before it (S1, S4, S7), and row numbers without a sort (S2, S3, S6, F15).

Spark's text source cuts a file at any separator byte into ranges (blocks) that
different tasks read. Whether a block begins inside a string or a quoted field, and
at which depth, is not known there, so a first pass scans each block for *both*
start states and reports what it does to either. The reports, one per block as the
file listing has one, are composed in file order on the driver; that fixes every
block's start state and how many elements begin before it. The second pass cuts the
elements; those that cross blocks are joined from their parts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from auditframe.session import cut_lineage

_PARTS = "file string, number bigint, block bigint, whole boolean, text string"


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """The text of files between separators, in file order within a block."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, block, pieces): consecutive pieces of a block; a block may come in several runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = set()
        for i in (0, 1):
            ends.update(pc.run_end_encode(batch.column(i)).run_ends.to_pylist())
        values, a = batch.column(2).cast(pa.large_binary()), 0
        for b in sorted(ends):
            yield batch.column(0)[a].as_py(), batch.column(1)[a].as_py(), values.slice(a, b - a).to_pylist()
            a = b


@dataclass
class _Effect:
    """What a block does to a start state: the state it ends in, the change of
    depth, and how many element ends it has at each depth relative to its start."""

    inside: bool
    depth: int = 0
    ends: Counter = field(default_factory=Counter)


@dataclass(frozen=True)
class _Start:
    """The state a block begins in, and the elements that end before it."""

    inside: bool
    depth: int
    number: int


class JsonScan:
    """Elements of a top-level JSON array; the separator is the comma."""

    separator = ","
    _escape = re.compile(rb"\\.", re.DOTALL)

    def joined(self, pieces: list[bytes], opens_file: bool) -> bytes:
        """Each piece but a file's first follows a comma."""
        return (b"" if opens_file else b",") + b",".join(pieces)

    def _marks(self, data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, those outside strings), escapes blanked."""
        raw = np.frombuffer(self._escape.sub(b"  ", data), np.uint8)
        within = (np.cumsum(raw == 0x22) & 1).astype(bool)
        return raw, within == inside

    def feed(self, effect: _Effect, data: bytes) -> None:
        raw, outside = self._marks(data, effect.inside)
        depth = effect.depth + self._depths(raw, outside)
        commas = depth[(raw == 0x2C) & outside]
        for d, n in zip(*np.unique(commas, return_counts=True), strict=True):
            effect.ends[int(d)] += int(n)
        if len(raw):
            effect.depth = int(depth[-1])
            effect.inside ^= bool((raw == 0x22).sum() & 1)

    @staticmethod
    def _depths(raw: np.ndarray, outside: np.ndarray) -> np.ndarray:
        opens = (raw == 0x5B) | (raw == 0x7B)
        closes = (raw == 0x5D) | (raw == 0x7D)
        return np.cumsum(np.where(outside, opens.astype(np.int64) - closes, 0))

    #: Element ends of a block that begins at depth d are its commas at relative depth 1 - d.
    def ended(self, effect: _Effect, start: _Start) -> int:
        return effect.ends[1 - start.depth]

    def check_end(self, file: str, last: _Start) -> None:
        if last.inside or last.depth:
            raise ValueError(f"unterminated JSON array in {file}")

    def cut(self, state: list, data: bytes) -> tuple[list[bytes], bytes]:
        """(texts that end in ``data``, the rest); ``state`` is [inside, depth, begun, closed]."""
        raw, outside = self._marks(data, state[0])
        depth = state[1] + self._depths(raw, outside)
        a, out = 0, []
        if not state[2]:
            text = data.removeprefix(b"\xef\xbb\xbf")
            head = len(data) - len(text.lstrip())
            if head < len(data):
                if data[head:head + 1] != b"[":
                    raise ValueError("the file must hold a JSON array")
                state[2], a = True, head + 1
            else:
                a = len(data)
        at = np.flatnonzero((((raw == 0x2C) & (depth == 1)) | ((raw == 0x5D) & (depth == 0))) & outside)
        for i in at.tolist():
            if state[3]:
                break
            if i >= a:
                out.append(data[a:i])
                a = i + 1
                state[3] = raw[i] == 0x5D
        if len(raw):
            state[0] ^= bool((raw == 0x22).sum() & 1)
            state[1] = int(depth[-1])
        if state[3]:
            if data[a:].strip():
                raise ValueError("unexpected content after the JSON array")
            return out, b""
        return out, data[a:]


class CsvScan:
    """Records of a CSV file whose quoted fields may hold line breaks; the
    separator is the line feed, a quote in a quoted field is doubled."""

    separator = "\n"
    _quoted = re.compile(rb'(?:[^"]|"")*')

    def joined(self, pieces: list[bytes], opens_file: bool) -> list[bytes]:
        return pieces

    def _after(self, line: bytes, inside: bool) -> bool:
        """Whether a line that begins inside a quoted field or not ends in one."""
        if b'"' not in line:
            return inside
        at = 0
        while True:
            if not inside:
                if not line.startswith(b'"', at):
                    at = line.find(b",", at) + 1
                    if not at:
                        return False
                    continue
                at += 1
            at = self._quoted.match(line, at).end()
            if at >= len(line):
                return True
            inside = False
            at = line.find(b",", at + 1) + 1
            if not at:
                return False

    def feed(self, effect: _Effect, lines: list[bytes]) -> None:
        for line in lines:
            before = effect.inside
            effect.inside = self._after(line, before)
            if not effect.inside and (before or line.rstrip(b"\r")):
                effect.ends[0] += 1

    def ended(self, effect: _Effect, start: _Start) -> int:
        return effect.ends[0]

    def check_end(self, file: str, last: _Start) -> None:
        """An open quote at the end closes with the file, as CSV readers take it."""

    def cut(self, state: list, lines: list[bytes]) -> tuple[list[bytes], bytes]:
        """A text that goes on with what was cut before begins with the line feed."""
        out, held = [], None
        for line in lines:
            before = state[0]
            state[0] = self._after(line, before)
            line = line if held is None and not before else (b"\n" + line if held is None else held + b"\n" + line)
            if state[0]:
                held = line
            else:
                held = None
                if before or line.rstrip(b"\r"):
                    out.append(line)
        return out, held or b""


def block_effects(pieces: DataFrame, scan) -> DataFrame:
    """(file, block, per start state: inside, depth, depths, counts)."""
    names = ["file", "block"] + [f"{n}{s}" for s in (0, 1) for n in ("inside", "depth", "depths", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, effects = None, []

        def report() -> pa.RecordBatch:
            row = [[key[0]], [key[1]]]
            for e in effects:
                row += [[e.inside], [e.depth], [list(e.ends)], [list(e.ends.values())]]
            kinds = [pa.string(), pa.int64()] + [pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for file, block, found in _runs(batches):
            opens = False
            if (file, block) != key:
                if key:
                    yield report()
                key, effects, opens = (file, block), [_Effect(False), _Effect(True)], block == 0
            for e in effects:
                scan.feed(e, scan.joined(found, opens))
        if key:
            yield report()

    states = ", ".join(f"inside{s} boolean, depth{s} bigint, depths{s} array<bigint>, counts{s} array<bigint>" for s in (0, 1))
    return pieces.mapInArrow(run, f"file string, block bigint, {states}")


def block_starts(effects: DataFrame, scan) -> dict[tuple[str, int], _Start]:
    """The start state of every block: the effects composed in file order. One row
    per block reaches the driver, which holds the list of blocks anyway."""
    files = defaultdict(list)
    for r in effects.collect():
        files[r["file"]].append(r)
    out = {}
    for file, rows in files.items():
        state = _Start(False, 0, 0)
        for r in sorted(rows, key=lambda r: r["block"]):
            out[file, r["block"]] = state
            s = int(state.inside)
            effect = _Effect(r[f"inside{s}"], r[f"depth{s}"], Counter(dict(zip(r[f"depths{s}"], r[f"counts{s}"], strict=True))))
            state = _Start(effect.inside, state.depth + effect.depth, state.number + scan.ended(effect, state))
        scan.check_end(file, state)
    return out


def cut_parts(pieces: DataFrame, scan, starts: dict[tuple[str, int], _Start]) -> DataFrame:
    """(file, number, block, whole, text): elements, or their parts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, number, begun_here = None, [], b"", 0, False

        def rows(items: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
            n = len(items)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * n), pa.array([i for i, _, _ in items], pa.int64()), pa.array([key[1]] * n, pa.int64()),
                pa.array([w for _, w, _ in items], pa.bool_()), pa.array([t for _, _, t in items], pa.binary()).cast(pa.string())],
                names=["file", "number", "block", "whole", "text"])

        for file, block, found in _runs(batches):
            opens = False
            if (file, block) != key:
                if key and held:
                    yield rows([(number, False, held)])
                key, start, opens = (file, block), starts[file, block], block == 0
                state = [start.inside, start.depth, start.depth > 0 or start.number > 0, block > 0 and start.depth == 0 and start.number > 0]
                held, number, begun_here = b"", start.number, opens or isinstance(scan, CsvScan) and not start.inside
            texts, rest = scan.cut(state, scan.joined(found, opens))
            items = []
            for text in texts:
                items.append((number, begun_here, held + text))
                held, begun_here = b"", True
                number += 1
            if rest:
                held = held + rest
            if items:
                yield rows(items)
        if key and held:
            yield rows([(number, False, held)])

    return pieces.mapInArrow(run, _PARTS)


def elements(spark: SparkSession, path: str | list[str], scan) -> DataFrame:
    """(file, number, text): the elements of files in byte ranges, numbered from 0
    per file. Written once; only parts of elements that cross blocks are grouped."""
    pieces = _pieces(spark, path, scan.separator)
    starts = block_starts(block_effects(pieces, scan), scan)
    parts = cut_lineage(cut_parts(pieces, scan, starts))
    crossing = parts.where("not whole").groupBy("file", "number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    return parts.where("whole").select("file", "number", "text").unionByName(crossing)


def json_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts of the elements of JSON array files. Blank: only an empty array's."""
    return elements(spark, path, JsonScan()).where((F.col("number") > 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts of the records of CSV files, the header first; blank lines are none."""
    return elements(spark, path, CsvScan())


def numbered_rows(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """``df``, a file scan, with row numbers in (file, position) order.

    No row is sorted or shuffled: rows are counted per (file, block), the counts
    added up over the blocks (one small row each, broadcast like the file listing),
    and a row's place in its block is added. Both reads plan the same file
    partitions; a row that finds itself in another partition fails the job."""
    at = {"_fp": F.col("_metadata.file_path"), "_fb": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    counts = df.select(*[c.alias(k) for k, c in at.items()]).groupBy("_fp", "_fb").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts).select("_fp", "_fb", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    tagged = df.select("*", *[c.alias(k) for k, c in at.items()])
    moved = F.shiftright("_id", 33) != F.shiftright("_first", 33)
    number = F.when(moved, F.raise_error(F.lit("the file scan was planned anew")).cast("bigint")).otherwise(F.col("_off") + F.col("_id") - F.col("_first") + start)
    return tagged.join(F.broadcast(offsets), ["_fp", "_fb"]).withColumn(name, number.cast("bigint")).drop("_fp", "_fb", "_id", "_first", "_off")


def parquet_rows(spark: SparkSession, path: str | list[str], start: int, end: int | None, name: str) -> DataFrame:
    """Rows ``start``..``end`` (from 1, both included) of Parquet files in (file, row
    index) order. Rows are counted per file without reading a column (footers),
    and only the files that hold such rows are read, with bounds on the row index."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
    begin, chosen = 0, []
    for r in sorted(files, key=lambda r: r["file"]):
        if begin + r["count"] >= start and (end is None or begin < end):
            chosen.append((r["file"], begin))
        begin += r["count"]
    schema = spark.read.parquet(path).schema
    if not chosen:
        return spark.createDataFrame([], schema.add(name, LongType()))
    rows = spark.read.schema(schema).parquet(*[f for f, _ in chosen])
    offsets = spark.createDataFrame(chosen, "_fp string, _off bigint")
    numbered = rows.select("*", F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.row_index").alias("_ri")).join(F.broadcast(offsets), "_fp")
    numbered = numbered.withColumn(name, F.col("_off") + F.col("_ri") + 1).drop("_fp", "_off", "_ri")
    inside = F.col(name) >= start
    return numbered.where(inside if end is None else inside & (F.col(name) <= end))
