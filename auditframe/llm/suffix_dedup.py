"""Operator 12: removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``LEAST`` bytes that also starts anywhere else
goes. Such a string is called a window here.

*Sampling.* A window's anchor is its gram of ``GRAM`` bytes with the smallest
hash (the last one on ties), so equal windows have their anchor at the same
offset and under the same key (the gram's hash). Windows whose key occurs once in
all texts cannot repeat; the other keys decide which anchors are sampled.

*Shard transforms.* Each task sorts the suffixes that begin at its sampled anchors
(as far as their windows reach, 400 bytes at most) and keeps, in that order, the
text in front of each suffix, as far as its windows reach: a Burrows-Wheeler
transform of the sampled suffixes, whose symbols are the stretches before them.

*Merge.* The transforms of all shards meet per bucket of keys. Their rows are
interleaved by iterative refinement: at first all rows form one block; every round
splits the blocks by the next symbol (8 bytes), keeping the order of the rows of a
shard. A block whose rows come from one shard is settled, since that shard has
sorted it; so is a block of one row. Where a block splits, the common prefix of
the two rows next to the split becomes known. No suffix is sorted again.

*Repeated intervals.* A window that starts x bytes before its anchor repeats if
another row shares LEAST - x bytes behind the anchor and x bytes before it. The
first is an interval of common prefixes of at least LEAST - x; the second is found
by x backward steps: each orders the rows anew, stably, by the next byte in front.
Rows whose bytes in front are unique leave the search.

A key with more than ``HOT`` anchors is not merged in one task: its windows are
compared by 128-bit fingerprints, counted within a task first. A window that
repeats at once at a small distance (as in a line of dashes) is settled where it is
read, and only the last of such a chain is sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map
from auditframe.llm.textscan import _BYTE, _power_tables, mix64, text_slices

LEAST = 400
GRAM = 64
#: Rows that a task collects for a shard transform, by bytes of context.
SHARD_BYTES = 32 << 20
#: Sampled suffixes of a bucket, on average, and the fewest buckets.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 64
#: Anchors of a key beyond which its windows are compared by fingerprints.
HOT = 50_000
#: Windows of such keys that a task compares at once.
HOT_WINDOWS = 1 << 20
#: Longer texts are searched for anchors in slices; places in a slice fit in its bits.
_SLICE_BITS = 18
_PLACE = np.uint64((1 << _SLICE_BITS) - 1)


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    up, down = _power_tables(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * down[:len(raw)], out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * up[:len(raw) - size + 1])


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def find_anchors(raw: np.ndarray, offs: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, key, settled) of a slice of texts
    ``offs``; places count from the slice's begin. ``settled``: distance at which
    these windows repeat at once, else 0."""
    none = np.zeros(0, np.int64)
    if len(raw) < least:
        return none, none, none, none, none.astype(np.uint64), none
    hashes = _gram_hashes(raw, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    at = _PLACE - (_window_min((hashes & ~_PLACE) | (_PLACE - places), least - gram + 1) & _PLACE)
    length = np.maximum(np.diff(offs) - least + 1, 0)
    row = np.repeat(np.arange(len(length)), length)
    start = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + offs[:-1][row]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none
    at = at[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    row, at, lo, hi = row[first], at[first], start[first], start[last]
    key = hashes[at]
    settled = np.zeros(len(at), np.int64)
    for j in np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1])).tolist():
        d = int(at[j + 1] - at[j])
        a, b = int(lo[j]), int(hi[j]) + least
        if b + d <= offs[row[j] + 1] and np.array_equal(raw[a:b], raw[a + d:b + d]):
            settled[j] = d
    return row, at, lo, hi, key, settled


def _slices(raw: np.ndarray, offs: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Slices that hold every window once: (bytes, row offsets, place of their begin)."""
    size = 1 << _SLICE_BITS
    if len(raw) <= size:
        yield raw, offs, 0
        return
    for a in range(0, len(raw) - least + 1, size - least + 1):
        part = raw[a:a + size]
        yield part, np.array([0, len(part)]), a


def _joined(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of ascending begin, those of a row that touch or overlap joined."""
    if not len(lo):
        return lo, hi, row
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.concatenate([[True], (lo[1:] > reach[:-1]) | (row[1:] != row[:-1])]))
    return lo[first], reach[np.append(first[1:], len(lo)) - 1], row[first]


def anchors(texts: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(tid, key, at, lo, hi) of (tid, text): windows lo..hi have their anchor at
    ``at``. Rows with a null key: bytes lo..hi-1 repeat at a small distance."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin, raw, offs in text_slices(batch.column(1)):
            for part, bounds, base in _slices(raw, offs, least):
                row, at, lo, hi, key, settled = find_anchors(part, bounds, least, gram)
                if not len(row):
                    continue
                near = settled > 0
                low, high, owner = _joined(lo[near], hi[near] + settled[near] + least, row[near])
                row, at, lo, hi, key = (np.concatenate(c) for c in (
                    (row[~near], owner), (at[~near], low), (lo[~near], low), (hi[~near], high), (key[~near], np.zeros(len(low), np.uint64))))
                doc = bounds[row] if len(bounds) > 2 else np.zeros(len(row), np.int64) - base
                keys = pa.array(key.view(np.int64), mask=np.arange(len(row)) >= len(row) - len(low))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(begin + row)), keys, pa.array(at - doc), pa.array(lo - doc), pa.array(hi - doc)],
                    names=["tid", "key", "at", "lo", "hi"])

    return arrow_map(texts.select("tid", "text"), run, "tid bigint, key bigint, at bigint, lo bigint, hi bigint")


class Rows:
    """Rows of transforms: sampled suffixes with the text before them. ``context``
    is the text of the row's windows, its anchor ``left`` bytes from the begin;
    ``near``: the smallest distance of a window's start from the anchor; ``lcp``: bytes
    shared with the row before it in its shard (0 under another key)."""

    FIELDS = (("key", "<u8"), ("tid", "<i8"), ("at", "<i8"), ("left", "<u2"), ("near", "<u2"), ("size", "<u2"), ("lcp", "<u2"))

    def __init__(self, columns: dict[str, np.ndarray], contexts: list[bytes], least: int):
        self.__dict__.update(columns)
        self.contexts, self.least, self.n = contexts, least, len(contexts)

    def symbols(self) -> np.ndarray:
        """The suffixes as rows of big-endian 8-byte symbols, the key first."""
        width = -(-self.least // 8) * 8
        data = b"".join(c[k:].ljust(width, b"\0") for c, k in zip(self.contexts, self.left.tolist(), strict=True))
        return np.concatenate([self.key.astype(np.uint64)[:, None], np.frombuffer(data, ">u8").reshape(self.n, -1).astype(np.uint64)], axis=1)

    def before(self) -> np.ndarray:
        """The bytes in front of the anchors, nearest first."""
        width = max(int(self.left.max(initial=0)), 1)
        data = b"".join(c[:k][::-1].ljust(width, b"\0") for c, k in zip(self.contexts, self.left.tolist(), strict=True))
        return np.frombuffer(data, np.uint8).reshape(self.n, width)

    def pick(self, order: np.ndarray, lcp: np.ndarray) -> Rows:
        columns = {name: getattr(self, name)[order] for name, _ in self.FIELDS if name != "lcp"}
        return Rows({**columns, "lcp": lcp}, [self.contexts[i] for i in order.tolist()], self.least)


def refine(symbols: np.ndarray, shard: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefixes) of rows that stand shard by shard, each shard
    sorted by ``symbols`` with ``lcp`` between its neighbours.

    Each round splits the blocks that are still mixed by one more symbol."""
    n = len(shard)
    order, out = np.arange(n), np.full(n, least, np.int64)
    opens = np.zeros(n + 1, bool)
    opens[[0, n]] = True
    active, block = np.arange(n), np.zeros(n, np.int64)
    for h in range(symbols.shape[1]):
        if len(active) < 2:
            break
        rows = order[active]
        symbol = symbols[rows, h]
        place = np.lexsort((symbol, block))
        rows, symbol = rows[place], symbol[place]
        order[active] = rows
        split = np.flatnonzero((symbol[1:] != symbol[:-1]) & (block[1:] == block[:-1])) + 1
        at = active[split]
        opens[at] = True
        if h:
            differ = symbol[split] ^ symbol[split - 1]
            same = np.zeros(len(split), np.int64)
            for byte in range(7):
                same += differ < np.uint64(1) << np.uint64(56 - 8 * byte)
            out[at] = np.minimum(8 * (h - 1) + same, least)
        else:
            out[at] = 0
        begins = opens[active]
        block = np.maximum.accumulate(np.where(begins, active, 0))
        mixed = np.zeros(n, bool)
        mixed[block[1:][(shard[rows[1:]] != shard[rows[:-1]]) & ~begins[1:]]] = True
        keep = mixed[block]
        rest = ~keep & ~begins
        out[active[rest]] = lcp[rows[rest]]
        active, block = active[keep], block[keep]
    out[0] = 0
    return order, out


def repeated_windows(rows: Rows, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, nearest, farthest distance before the anchor) of the runs of window
    starts that repeat, of sorted rows with their common prefixes."""
    n, before = rows.n, rows.before() if rows.n else None
    left, near = rows.left.astype(np.int64), rows.near.astype(np.int64)
    begin, last = np.zeros(n, np.int64), np.full(n, -2, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.arange(n)
    group = np.cumsum(lcp == 0)
    for x in range(int(left.max(initial=-1)) + 1):
        if x:
            deep = left[alive] >= x
            alive, group = alive[deep], group[deep]
            step = group * 256 + before[alive, x - 1]
            place = np.argsort(step, kind="stable")
            alive, step = alive[place], step[place]
            new = np.ones(len(alive), bool)
            new[1:] = step[1:] != step[:-1]
            group = np.cumsum(new)
        else:
            new = np.ones(n, bool)
            new[1:] = group[1:] != group[:-1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        if alone.any():
            alive, group = alive[~alone], group[~alone]
        if not len(alive):
            break
        here = near[alive] <= x
        row, own = alive[here], group[here]
        interval = np.cumsum(lcp < rows.least - x)[row]
        pair = np.flatnonzero((own[1:] == own[:-1]) & (interval[1:] == interval[:-1]))
        found = np.zeros(len(row), bool)
        found[pair] = found[pair + 1] = True
        found = row[found]
        fresh = found[last[found] != x - 1]
        closed = fresh[last[fresh] >= 0]
        out.append((closed, begin[closed], last[closed]))
        begin[fresh] = x
        last[found] = x
    closed = np.flatnonzero(last >= 0)
    out.append((closed, begin[closed], last[closed]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _sampled(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(text, tid, key, at, lo, hi) of the sampled anchors of (text, sampled)."""
    lists = batch.column(1)
    columns = [c.to_numpy().tolist() for c in lists.flatten().flatten()]
    offsets = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    for i, text in enumerate(batch.column(0).cast(pa.large_binary())):
        text = text.as_py()
        for j in range(offsets[i], offsets[i + 1]):
            yield (text, *(c[j] for c in columns))


_SHARD_SCHEMA = "bucket bigint, n bigint, " + ", ".join(f"{name} binary" for name, _ in Rows.FIELDS) + ", context binary"


def shard_transforms(rows: DataFrame, buckets: int, least: int) -> DataFrame:
    """Transforms of (text, sampled array<struct<tid, key, at, lo, hi>>), a row per bucket and shard."""

    def shard(fields: list[tuple], contexts: list[bytes]) -> pa.RecordBatch:
        columns = {name: np.array(v) for name, v in zip(("key", "tid", "at", "left", "near"), zip(*fields), strict=True)}
        columns["key"] = columns["key"].astype(np.int64).view(np.uint64)
        columns["size"] = np.array([len(c) for c in contexts])
        columns["lcp"] = np.zeros(len(contexts), np.int64)
        given = Rows(columns, contexts, least)
        order, lcp = refine(given.symbols(), np.arange(given.n), columns["lcp"], least)
        rows = given.pick(order, lcp)
        # keys are the first symbol: a bucket's rows keep their order
        bucket = (rows.key % np.uint64(buckets)).astype(np.int64)
        place = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], bucket[place][1:] != bucket[place][:-1], [True]]))
        arrays: list[list] = [[] for _ in range(len(Rows.FIELDS) + 3)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = place[a:b]
            values = [int(bucket[part[0]]), b - a, *(getattr(rows, name)[part].astype(kind).tobytes() for name, kind in Rows.FIELDS)]
            for array, value in zip(arrays, [*values, b"".join(rows.contexts[i] for i in part.tolist())], strict=True):
                array.append(value)
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (len(Rows.FIELDS) + 1)
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["bucket", "n", *(f for f, _ in Rows.FIELDS), "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, contexts, size = [], [], 0
        for batch in batches:
            for text, tid, key, at, lo, hi in _sampled(batch):
                context = text[lo:hi + least]
                fields.append((key, tid, at, at - lo, at - hi))
                contexts.append(context)
                size += len(context)
                if size >= SHARD_BYTES:
                    yield shard(fields, contexts)
                    fields, contexts, size = [], [], 0
        if contexts:
            yield shard(fields, contexts)

    return rows.select("text", "sampled").mapInArrow(run, _SHARD_SCHEMA)


def merge_shards(table: pa.Table, least: int) -> tuple[Rows, np.ndarray]:
    """The rows of all shards in merged order, and their common prefixes."""
    columns = {
        name: np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name)]) for name, kind in Rows.FIELDS}
    contexts = []
    for blob, sizes in zip(table.column("context"), table.column("size"), strict=True):
        data, end = blob.as_py(), 0
        for k in np.frombuffer(sizes.as_buffer(), "<u2").tolist():
            contexts.append(data[end:end + k])
            end += k
    given = Rows(columns, contexts, least)
    shard = np.repeat(np.arange(table.num_rows), table.column("n").to_numpy())
    order, lcp = refine(given.symbols(), shard, columns["lcp"].astype(np.int64), least)
    return given.pick(order, lcp), lcp


def merged_intervals(transforms: DataFrame, least: int) -> DataFrame:
    """(tid, lo, hi): bytes lo..hi-1 are covered by repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        rows, lcp = merge_shards(table, least)
        row, nearest, farthest = repeated_windows(rows, lcp)
        at = rows.at[row]
        return pa.table({"tid": pa.array(rows.tid[row]), "lo": pa.array(at - farthest), "hi": pa.array(at - nearest + least)})

    return transforms.groupBy("bucket").applyInArrow(run, "tid bigint, lo bigint, hi bigint")


def _fingerprints(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    one = _gram_hashes(raw, size)
    return one, mix64(_gram_hashes(raw ^ np.uint8(0xA5), size) * np.uint64(0x9FB2_1C65_1E98_DF25))


def hot_windows(rows: DataFrame, least: int) -> DataFrame:
    """Windows of (text, sampled): (f1, f2, n, tid, lo, hi). Fingerprints that a
    task meets again within ``HOT_WINDOWS`` windows are settled there (listed once
    with n = 2, their places with null fingerprints)."""

    def settle(one: np.ndarray, two: np.ndarray, tids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        place = np.lexsort((two, one))
        a, b = one[place], two[place]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        first = place[new]
        many = np.zeros(len(one), bool)
        many[place] = np.repeat(count > 1, count)
        tid, lo = tids[many], starts[many]
        order = np.lexsort((lo, tid))
        tid, lo = tid[order], lo[order]
        begins = np.flatnonzero(np.concatenate([np.ones(min(len(lo), 1), bool), (lo[1:] != lo[:-1] + 1) | (tid[1:] != tid[:-1])]))
        ends = np.append(begins[1:], len(lo)) - 1 if len(lo) else begins
        zero = np.zeros(len(begins), np.int64)
        null = np.arange(len(first) + len(begins)) >= len(first)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([one[first].view(np.int64), zero]), mask=null),
            pa.array(np.concatenate([two[first].view(np.int64), zero]), mask=null),
            pa.array(np.concatenate([np.minimum(count, 2), zero])),
            pa.array(np.concatenate([tids[first], tid[begins]])), pa.array(np.concatenate([starts[first], lo[begins]])),
            pa.array(np.concatenate([starts[first], lo[ends]]) + least)], names=["f1", "f2", "n", "tid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for text, tid, _, _, lo, hi in _sampled(batch):
                one, two = _fingerprints(np.frombuffer(text[lo:hi + least], np.uint8), least)
                held.append((one, two, np.full(len(one), tid), lo + np.arange(len(one))))
                size += len(one)
                if size >= HOT_WINDOWS:
                    yield settle(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield settle(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("text", "sampled").mapInArrow(run, "f1 bigint, f2 bigint, n bigint, tid bigint, lo bigint, hi bigint")


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def repeated_intervals(scratch: Scratch, texts: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(tid, lo, hi) over (tid, text), distinct texts: the bytes that repeated
    windows cover. Intervals of a text may touch or overlap."""
    found = scratch.write(anchors(texts, least, gram))
    repeated = scratch.write(found.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = repeated.agg(F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0)).alias("plain"), F.count_if(F.col("n") > hot).alias("hot")).first()
    buckets = max(LEAST_BUCKETS, total["plain"] // BUCKET_ROWS)

    def with_texts(keys: DataFrame) -> DataFrame:
        sampled = found.join(keys.select("key"), "key").groupBy("tid").agg(F.collect_list(F.struct("tid", "key", "at", "lo", "hi")).alias("sampled"))
        return texts.select("tid", "text").join(sampled, "tid").select("text", "sampled")

    out = found.where("key is null").select("tid", "lo", "hi")
    out = out.unionByName(merged_intervals(shard_transforms(with_texts(repeated.where(F.col("n") <= hot)), buckets, least), least))
    if total["hot"]:
        windows = scratch.write(hot_windows(with_texts(repeated.where(F.col("n") > hot)), least))
        known = windows.where("f1 is not null")
        shared = known.groupBy("f1", "f2").agg(F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
        out = out.unionByName(windows.where("f1 is null").select("tid", "lo", "hi"))
        out = out.unionByName(known.join(shared, ["f1", "f2"]).select("tid", "lo", "hi"))
    return scratch.write(out)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes of intervals that may touch or overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT,
) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) per row of ``docs``: ``spans`` are the
    maximal removed runs (begin, end) in the text's UTF-8 bytes, ``kept_sha256``
    the digest of the remaining bytes.

    Null text is empty. Texts shorter than ``least`` keep every byte. Texts that
    stand in several rows lose every byte and take part once, in the name of all;
    rows that repeat or miss an id are treated one by one. Extra columns are
    ignored; an empty table gives an empty result. ``gram`` must be less than ``least``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    distinct = (
        rows.where(F.octet_length("text") >= least).groupBy(_digest(F.col("text")).alias("digest"))
        .agg(F.count("*").alias("copies"), F.first("text").alias("text")))
    texts = scratch.write(distinct.select(F.monotonically_increasing_id().alias("tid"), "digest", "copies", "text"))
    intervals = repeated_intervals(scratch, texts, least, gram, hot)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed, spans, kept = [], [], []
        for body, given in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            body, found = body.as_py(), merge_spans([(s["lo"], s["hi"]) for s in given.as_py()])
            rest = without(body, found)
            removed.append(len(body) - len(rest))
            spans.append([{"begin": a, "end": b} for a, b in found])
            kept.append(hashlib.sha256(rest).hexdigest())
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept)], names=["digest", "n_removed", "spans", "kept_sha256"])

    lists = intervals.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    single = texts.where("copies = 1").select("tid", "digest", "text").join(lists, "tid").select("digest", "text", "found")
    schema = "digest binary, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept_sha256 string"
    cut_texts = arrow_map(single, cut, schema)
    whole = F.octet_length("text").cast("bigint")
    keyed = rows.select("id", whole.alias("n_bytes"), F.when(whole >= least, _digest(F.col("text"))).alias("digest"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    repeats = texts.where("copies > 1").select("digest", F.lit(True).alias("repeated"))
    known = cut_texts.withColumn("repeated", F.lit(False)).unionByName(repeats, allowMissingColumns=True)
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))
    repeated = F.coalesce("repeated", F.lit(False))
    return keyed.join(known, "digest", "left").select(
        "id", "n_bytes",
        F.when(repeated, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(repeated, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(repeated, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def remove_repeats(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "kept", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) and, as binary column ``name``, the bytes
    that remain: a cut need not fall between characters. Null text leaves null. A
    name that ``docs`` has already gets underscores behind it."""
    while name in docs.columns:
        name += "_"
    numbered = scratch.write(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"), F.col(text_col).cast("string").alias("text")))
    spans = repeated_spans(scratch, numbered, "number", "text", **options).select("id", "spans")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = []
        for body, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            body = body.as_py()
            kept.append(None if body is None else without(body, [(s["begin"], s["end"]) for s in found.as_py()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["row", name])

    joined = numbered.join(spans, numbered["number"] == spans["id"]).select("row", "text", "spans")
    schema = joined.select("row").schema.add(name, "binary")
    return arrow_map(joined, cut, schema).select("row.*", name)
