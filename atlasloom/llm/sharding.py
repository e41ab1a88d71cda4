r"""Sharding through fixed virtual slots, in DataFrame and SQL functions only.

A record's hash puts it into one of `n_slots` virtual slots, for ever. Bytes and rows are summed per slot (at most
`n_slots` rows, so this is all that is ever packed, broadcast or stored as the map). A fold over the slots, largest
first, gives each to the lightest shard; the result is stored as a versioned slot-to-shard map. Rebalancing edits the
map: it moves whole slots out of overfull shards into the emptiest ones, and writes the next version.

Defined cases: a null text has size 1; rows with a null key are spread by their text; repeated rows and repeated keys
each take a slot position of their own (equal rows are interchangeable); an empty table gives an empty result and a
map in which every slot is empty; further columns are ignored by `assigned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasloom.llm import common

SLOTS = 4096


def record_slot(n_slots: int, key: str = "doc_id", text: str = "text") -> Column:
    """Hash of the record: copies of a text under other keys, and one key with many texts, spread over the slots."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, vslot) without the text."""
    t = common.text_or_empty(text)
    return docs.select(F.col(key), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), record_slot(n_slots, key, text).alias("vslot"))


def slot_totals(rows: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(vslot, rows, bytes) of all slots, empty ones too."""
    found = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(found), "vslot", "left").select("vslot", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("rows", "bytes")])


def _folded(totals: DataFrame, start: str, step: str) -> DataFrame:
    """Folds over the slots, largest first; the one row that holds them has `n_slots` entries, a fixed bound."""
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("bytes", (-F.col("vslot")).alias("k"), "rows", "shard")), asc=False).alias("s"))
    out = listed.select(F.expr(f"aggregate(s, named_struct('load', {start}, 'out', CAST(array() AS ARRAY<STRUCT<vslot: INT, shard: INT, rows: BIGINT, bytes: BIGINT>>)), {step}, _a -> _a.out)").alias("out"))
    return out.select(F.explode("out").alias("o")).select("o.*")


def packed(totals: DataFrame, n_shards: int) -> DataFrame:
    """Longest first into the lightest shard: (vslot, shard, rows, bytes)."""
    put = "named_struct('load', transform(_a.load, (_l, _i) -> IF(_i = _to, _l + _x.bytes, _l)), 'out', concat(_a.out, array(named_struct('vslot', CAST(-_x.k AS INT), 'shard', _to, 'rows', _x.rows, 'bytes', _x.bytes))))"
    lightest = "CAST(array_position(_a.load, array_min(_a.load)) - 1 AS INT)"
    return _folded(totals.withColumn("shard", F.lit(None).cast("int")), f"transform(sequence(1, {n_shards}), _i -> 0L)", f"(_a, _x) -> transform(array({lightest}), _to -> {put})[0]")


def rebalanced(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The map for `n_shards`: slots leave shards above the new mean for the lightest shard, where that helps; all else stays.

    With more shards than before, the old shards only give; with fewer, slots of the shards that go are all moved.
    """
    listed = slot_map.agg(F.collect_list(F.struct("shard", "bytes")).alias("s"), F.sum("bytes").alias("total"))
    loads = listed.select(F.expr(f"transform(sequence(0, {n_shards - 1}), _i -> coalesce(aggregate(s, 0L, (_t, _x) -> _t + IF(_x.shard = _i, _x.bytes, 0L)), 0L))").alias("load"), (F.coalesce("total", F.lit(0)) / n_shards).alias("mean"))
    rows = slot_map.agg(F.sort_array(F.collect_list(F.struct("bytes", (-F.col("vslot")).alias("k"), "rows", "shard")), asc=False).alias("s"))
    lightest = "CAST(array_position(_a.load, array_min(_a.load)) - 1 AS INT)"
    goes = f"(_x.shard >= {n_shards} OR (_x.bytes > 0 AND _a.load[_x.shard] - _x.bytes >= mean AND array_min(_a.load) + _x.bytes <= mean * 1.0001 + 1))"
    step = f"(_a, _x) -> transform(array(IF({goes}, {lightest}, _x.shard)), _to -> named_struct('load', transform(_a.load, (_l, _i) -> _l + IF(_i = _to, _x.bytes, 0L) - IF(_i = _x.shard, _x.bytes, 0L)), 'out', concat(_a.out, array(named_struct('vslot', CAST(-_x.k AS INT), 'shard', _to, 'rows', _x.rows, 'bytes', _x.bytes)))))[0]"
    out = rows.crossJoin(F.broadcast(loads)).select(F.expr(f"aggregate(s, named_struct('load', load, 'out', CAST(array() AS ARRAY<STRUCT<vslot: INT, shard: INT, rows: BIGINT, bytes: BIGINT>>)), {step}, _a -> _a.out)").alias("out"))
    return out.select(F.explode("out").alias("o")).select("o.*")


class SlotMaps:
    """Versions of the slot-to-shard map under one path; a version is never overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, slot_map: DataFrame, version: int, n_shards: int) -> DataFrame:
        slot_map.withColumn("n_shards", F.lit(n_shards)).coalesce(1).write.parquet(f"{self.path}/version={version:06d}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version:06d}")


def assigned(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot, vslot, next_shard): `slot` counts a shard's rows from 0 without a gap, `next_shard` holds after adding a shard.

    A shard's rows are numbered slot by slot: rows of all its earlier slots, then the place within the slot. Only keys,
    sizes and checksums are shuffled, by slot.
    """
    maps = SlotMaps(docs.sparkSession, path or common.fresh_path(docs.sparkSession, "slot-map"))
    rows = sized(docs, n_slots, key, text)
    first = maps.store(packed(slot_totals(rows, n_slots), n_shards), 1, n_shards)
    second = maps.store(rebalanced(first.drop("n_shards"), n_shards + 1), 2, n_shards + 1)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = first.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")).join(second.select("vslot", F.col("shard").alias("next_shard")), "vslot")
    place = Window.partitionBy("vslot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return rows.withColumn("_place", F.row_number().over(place)).join(F.broadcast(slots), "vslot").select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"), "vslot", "next_shard")
