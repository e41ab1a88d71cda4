"""Event-time windows and stateful operators; the window functions serve batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "object_id bigint, state string, sightings int, misses int"


def _time(time: str):
    """Windows need an instant; a wall-clock time counts as UTC."""
    return F.col(time).cast("timestamp")


def _late(rows: DataFrame, time: str, watermark: str | None) -> DataFrame:
    rows = rows.withColumn("_at", _time(time))
    return rows.withWatermark("_at", watermark) if watermark else rows


def _open(rows: DataFrame, window, by: list[str], value: str | None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return rows.groupBy(window.alias("_w"), *by).agg(*aggs).select(F.col("_w.start").cast("timestamp_ntz").alias("start"), F.col("_w.end").cast("timestamp_ntz").alias("until"), *by, "n", *(["total"] if value else []))


def tumbling(rows: DataFrame, size: str, by: str = "event_type", time: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    return _open(_late(rows, time, watermark), F.window("_at", size), [by], value)


def sliding(rows: DataFrame, size: str, slide: str, by: str = "event_type", time: str = "ts", watermark: str | None = None) -> DataFrame:
    return _open(_late(rows, time, watermark), F.window("_at", size, slide), [by], None)


def session(rows: DataFrame, gap: str, by: str = "user_id", time: str = "ts", watermark: str | None = None) -> DataFrame:
    out = _open(_late(rows, time, watermark), F.session_window("_at", gap), [by], None)
    return out.select(by, "start", "until", "n")


def deduplicated(rows: DataFrame, keys: list[str], time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark."""
    return rows.withColumn("_at", _time(time)).withWatermark("_at", watermark).dropDuplicatesWithinWatermark(keys).drop("_at")


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """confirmed from two sightings; struck after two misses in a row, for one round, then removed."""
    now, seen, missed = state.get if state.exists else ("pending", 0, 0)
    rows = sorted((r for b in batches for r in b[["order", "seen"]].itertuples(index=False, name=None)), key=lambda r: r[0])
    for _, hit in rows:
        if now == "removed":
            break
        if hit:
            seen, missed = seen + 1, 0
            now = "confirmed" if seen >= 2 else "pending"
        else:
            missed += 1
            now = "removed" if now == "struck" else "struck" if missed >= 2 else now
    state.update((now, seen, missed))
    yield pd.DataFrame({"object_id": [key[0]], "state": [now], "sightings": [seen], "misses": [missed]})


def lifecycle(observations: DataFrame) -> DataFrame:
    """Object states of a stream of (object_id, order, seen), kept per object: the newest state after each batch."""
    return observations.groupBy("object_id").applyInPandasWithState(_advance, STATE, "state string, sightings int, misses int", "update", "NoTimeout")


def upsert_latest(stream: DataFrame, path: str, key: str, order: str):
    """Writes a stream's newest row per key: each batch merges with what is there and goes to the next version; the pointer is written last."""
    from atlasloom.sources.versions import VersionStore

    store = VersionStore(stream.sparkSession, path)

    def merge(batch: DataFrame, _epoch: int) -> None:
        names = batch.columns
        rows = batch if store.latest() is None else store.read().select(*names).unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_r")).select("_r.*")
        store.commit(newest, kind="update")

    return stream.writeStream.foreachBatch(merge).outputMode("update")
