"""Operator 3: sharding over fixed virtual slots [DataFrame functions only].

Every record hashes to one of thousands of virtual slots by its id and the CRC of
its text; the slot never changes. Where many rows repeat both (null ids with one
text, say), a slot would hold more than a shard's fair part: the rows of such heavy
slots are dealt once more, by their written position as well. Bytes are summed per slot, and a versioned table maps slots to
shards. Version 0 deals the slots round; a rebalancing writes the next version,
in which only slots move that their shard has no room for. The map has one row
per slot and version, whatever the data's size, and its edit is one aggregate
over that many entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch

SHARDS = 24
VIRTUAL_SLOTS = 4096
#: Bytes that every record takes beside its text.
RECORD_BYTES = 8
#: A slot is heavy when it holds more than this part of a shard's mean load.
HEAVY_PART = 4


def virtual_slot(*keys: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """(id, size, text_crc32, vslot, position) per row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    crc = F.crc32(raw)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(raw) + F.lit(RECORD_BYTES)).cast("bigint").alias("size"),
        crc.alias("text_crc32"), virtual_slot(F.col(id_col), crc, slots=slots).alias("vslot"), F.monotonically_increasing_id().alias("position"))


def spread_heavy(rows: DataFrame, loads: DataFrame, shards: int, slots: int) -> DataFrame:
    """``rows`` (written, so positions are fixed) with the rows of heavy slots dealt
    by position too. There are fewer than ``shards * HEAVY_PART`` heavy slots."""
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    heavy = loads.withColumn("most", mean / F.lit(HEAVY_PART)).where("bytes > most and records > 1").select("vslot", F.lit(True).alias("heavy"))
    again = virtual_slot(F.col("id"), F.col("text_crc32"), F.col("position"), slots=slots)
    return rows.join(F.broadcast(heavy), "vslot", "left").select(
        "id", "size", "text_crc32", F.when(F.col("heavy"), again).otherwise(F.col("vslot")).alias("vslot"))


def slot_bytes(rows: DataFrame, slots: int) -> DataFrame:
    """(vslot, bytes, records) for every slot, also empty ones."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").na.fill(0, ["bytes", "records"])


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: (version, vslot, shard, bytes, records)."""
    return loads.select(F.lit(0).alias("version"), "vslot", F.pmod("vslot", F.lit(shards)).alias("shard"), "bytes", "records")


def rebalanced(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map. A shard keeps its slots, largest first, up to
    the mean load; the others move, largest first, each to the shard that is
    lightest at that moment. One entry per virtual slot is ordered and folded."""
    mean = F.ceil(F.sum("bytes").over(Window.partitionBy()) / F.lit(shards))
    big_first = [F.desc("bytes"), F.asc("vslot")]
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*big_first)) <= F.col("mean")
    marked = current.withColumn("mean", mean).withColumn("stays", kept)
    # one row: the loads that stay and the slots that move
    state = marked.agg(
        F.array(*[F.struct(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes")).otherwise(0)).alias("load"), F.lit(s).alias("shard"))
                  for s in range(shards)]).alias("loads"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot")))).alias("movers"))

    def move(state: Column, slot: Column) -> Column:
        to = F.array_min(state["loads"])
        grown = F.transform(state["loads"], lambda x: F.struct(
            F.when(x["shard"] == to["shard"], x["load"] - slot["less"]).otherwise(x["load"]).alias("load"), x["shard"].alias("shard")))
        return F.struct(grown.alias("loads"), F.concat(state["moved"], F.array(F.struct(slot["vslot"].alias("vslot"), to["shard"].alias("to")))).alias("moved"))

    nothing = F.expr("cast(array() as array<struct<vslot:int,to:int>>)")
    moved = state.select(
        F.explode(F.aggregate("movers", F.struct(F.col("loads"), nothing.alias("moved")), move)["moved"]).alias("m")).select("m.*")
    return marked.join(moved, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"), "bytes", "records")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(id, size, text_crc32, shard, slot, vslot): ``rows`` at their places by one
    version of a map (its latest where it holds several)."""
    newest = slot_map.withColumn("newest", F.max("version").over(Window.partitionBy())).where("version = newest").select("vslot", "shard")
    counts = rows.groupBy("vslot").agg(F.count("*").alias("records"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = newest.join(counts, "vslot", "left").select(
        "vslot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("vslot").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(placed), "vslot")
        .select("id", "size", "text_crc32", "shard", (F.col("place") + F.col("skipped")).alias("slot"), "vslot"))


def shard_with_map(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
    slots: int = VIRTUAL_SLOTS, slot_map: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(placed rows, the map's versions (version, vslot, shard, bytes, records)).

    Without ``slot_map`` version 0 deals the slots round and version 1 rebalances
    them by their bytes. A stored map, edited or not, is followed as it is; pass its
    latest version through ``rebalanced`` to move slots."""
    rows = scratch.write(records(docs, id_col, text_col, slots))
    rows = scratch.write(spread_heavy(rows, slot_bytes(rows, slots), shards, slots))
    if slot_map is None:
        zero = scratch.write(first_map(slot_bytes(rows, slots), shards))
        slot_map = zero.unionByName(scratch.write(rebalanced(zero, shards)))
    return place(rows, slot_map), slot_map


def shard(
    scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
    slots: int = VIRTUAL_SLOTS, slot_map: DataFrame | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, vslot) per row: ``slot`` is the row's
    place in its shard, gapless from 0 (virtual slots of a shard in order, ids
    in order within a virtual slot).

    Law: bytes, also where ids repeat or are null. Null text: no bytes, crc of the
    empty string. Rows that repeat an id each have a place of their own. Extra
    columns are ignored; an empty table gives an empty result."""
    return shard_with_map(scratch, docs, id_col, text_col, shards, slots, slot_map)[0]
