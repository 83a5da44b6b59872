"""Operator 6: byte-level BPE over overlapping chunks, and decoding.

A long text is dealt out as chunks of characters that overlap. Each chunk is
pre-tokenised from its own first character, which need not be a boundary of the
whole text; pre-tokens depend only on what follows their first character, so
once a chunk has a boundary that its (correct) left neighbour also has, all
later ones are boundaries of the whole text. The chunks are cut there and the
pieces are encoded in parallel. A chunk without a common boundary in the overlap
joins its left neighbour's piece, and so do all that follow it in that text.
Only boundaries behind a non-white character are used: white space at the end of
a piece would be split differently from the same white space before a word.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.bpe import rank_encoder, rank_tokens
from auditframe.llm.common import Scratch, arrow_map

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
_WHITE_CHAR = regex.compile(r"\p{White_Space}")
_RESULT = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@functools.cache
def _compiled(pattern: str) -> regex.Pattern:
    # this library counts the control characters 0x1C-0x1F as white, the tokenizer's does not
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, pattern: str, is_end: bool) -> np.ndarray:
    """Starts of the pre-tokens of a chunk read from its first character. If the
    text goes on behind the chunk, the last two are left out: their pre-tokens
    may differ when what follows is known."""
    starts = np.array([m.start() for m in _compiled(pattern).finditer(text)], np.int64)
    return starts if is_end else starts[:-2]


def stitch_points(text: str, pattern: str, is_end: bool) -> np.ndarray:
    """The boundaries of a chunk behind a non-white character of it."""
    return np.array([p for p in boundaries(text, pattern, is_end).tolist() if p and not _WHITE_CHAR.match(text, p - 1)], np.int64)


def decode(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(rank_tokens(path).__getitem__, ids.tolist()))


class _Digests:
    """Running digests of a document's ids and decoded bytes."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes, path: str) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.text.update(decode(np.frombuffer(ids, "<u4"), path))

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _short_and_chunks(docs: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """Texts of one chunk: encoded (``chunk`` null). Longer ones: a row per chunk."""
    schema = [("row", pa.string()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
              ("chunk", pa.int32()), ("begin", pa.int64()), ("is_end", pa.bool_()), ("text", pa.string())]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode, rows = rank_encoder(path, pattern), []
        for key, i, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            text = text or ""
            if len(text) <= size + overlap:
                d = _Digests()
                d.add(encode(text), path)
                rows.append((key, i, *d.row(), None, None, None, None))
            else:
                starts = range(0, len(text) - overlap, size)
                rows += [(key, i, None, None, None, k, a, a + size + overlap >= len(text), text[a:a + size + overlap]) for k, a in enumerate(starts)]
        yield _batch(rows, schema)

    # repeated ids: a long text is known by its id and digest
    key = F.when(F.length("text") > size + overlap, F.sha2(F.encode("text", "UTF-8"), 256))
    return arrow_map(
        docs.select(key.alias("row"), "id", "text"), run,
        f"row string, {_RESULT}, chunk int, begin bigint, is_end boolean, text string")


def _cuts(chunks: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """(row, id, chunk, cut, piece): where each chunk takes over from its left
    neighbour (null: it does not), and the chunk its piece begins with."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        heads, tails = [], []
        for begin, is_end, text in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
            at = stitch_points(text, pattern, is_end)
            heads.append((at[at < overlap] + begin).tolist())
            tails.append((at[at >= size] + begin).tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, kind), pa.array(tails, kind)], names=["row", "id", "chunk", "head", "tail"])

    edges = arrow_map(chunks.select("row", "id", "chunk", "begin", "is_end", "text"), run,
                      "row string, id bigint, chunk int, head array<bigint>, tail array<bigint>")
    in_text = Window.partitionBy("row", "id").orderBy("chunk")
    cut = F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(in_text))))
    lost = F.min(F.when(F.col("cut").isNull(), F.col("chunk"))).over(Window.partitionBy("row", "id"))
    return (
        edges.withColumn("cut", cut).withColumn("lost", lost)
        .withColumn("piece", F.when(F.col("chunk") >= F.col("lost"), F.col("lost") - 1).otherwise(F.col("chunk")))
        .withColumn("cut", F.when(F.col("piece") == F.col("chunk"), F.col("cut")))
        .withColumn("next_cut", F.lead("cut").over(in_text)).select("row", "id", "chunk", "cut", "next_cut", "piece")
    )


def _encoded_pieces(chunks: DataFrame, cuts: DataFrame, path: str, pattern: str, size: int) -> DataFrame:
    """(row, id, piece, ids): pieces encoded in parallel; a piece of several
    chunks is put together first."""
    schema = [("row", pa.string()), ("id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key, parts = rank_encoder(path, pattern), None, []
        for batch in batches:
            rows = []
            for row, i, piece, begin, is_end, cut, next_cut, text in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if (row, i, piece) != key:
                    if parts:
                        rows.append((*key, encode("".join(parts))))
                    key, parts = (row, i, piece), []
                # up to the next chunk's cut; where it has none, up to its begin
                stop = len(text) if is_end else size if next_cut is None else next_cut - begin
                parts.append(text[0 if cut is None else cut - begin:stop])
            if rows:
                yield _batch(rows, schema)
        if parts:
            yield _batch([(*key, encode("".join(parts)))], schema)

    placed = chunks.select("row", "id", "chunk", "begin", "is_end", "text").join(
        cuts.withColumnsRenamed({"row": "_row", "id": "_id", "chunk": "_chunk"}),
        (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("chunk") == F.col("_chunk")))
    ordered = placed.select("row", "id", "piece", "begin", "is_end", "cut", "next_cut", "text").repartition("row", "id", "piece")
    return ordered.sortWithinPartitions("row", "id", "piece", "begin").mapInArrow(run, "row string, id bigint, piece int, ids binary")


def _joined(pieces: DataFrame, path: str) -> DataFrame:
    """One result per long text from its pieces in order, as a stream."""
    schema = [("row", pa.string()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digests = None
        for batch in batches:
            rows = []
            for row, i, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (row, i) != key:
                    if digests:
                        rows.append((*key, *digests.row()))
                    key, digests = (row, i), _Digests()
                digests.add(ids, path)
            if rows:
                yield _batch(rows, schema)
        if digests:
            yield _batch([(*key, *digests.row())], schema)

    return pieces.repartition("row", "id").sortWithinPartitions("row", "id", "piece").mapInArrow(run, f"row string, {_RESULT}")


def encode_decode(
    scratch: Scratch, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row.

    Null text is empty. Rows that repeat an id are encoded each; of rows that
    repeat id and text, long texts are encoded once and listed as often. Extra
    columns are ignored; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = scratch.write(_short_and_chunks(rows, path, pattern, chunk_chars, overlap_chars))
    short = first.where("chunk is null").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    chunks = first.where("chunk is not null")
    listed = chunks.where("chunk = 0").groupBy("row", "id").count()
    once = chunks.dropDuplicates(["row", "id", "chunk"])
    cuts = scratch.write(_cuts(once, pattern, chunk_chars, overlap_chars))
    long = _joined(_encoded_pieces(once, cuts, path, pattern, chunk_chars), path)
    times = listed.withColumnsRenamed({"row": "_row", "id": "_id"})
    again = long.join(times, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).withColumn(
        "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))))
    return short.unionByName(again.select(*short.columns))
