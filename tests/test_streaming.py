"""Streams give what batches give."""

from pyspark.sql import functions as F

from atlasloom.sources.versions import VersionStore
from atlasloom.streaming import events as S


def drained(query):
    query.processAllAvailable()
    query.stop()


def source(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    return table, spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")


def test_tumbling(spark, sf, tmp_path):
    table, stream = source(spark, sf, tmp_path)
    drained(S.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", f"{tmp_path}/c").start())
    key = lambda d: {(r.start, r.event_type, r.n) for r in d.collect()}
    assert key(spark.table("tumbling")) == key(S.tumbling(table, "1 hour"))


def test_deduplication(spark, sf, tmp_path):
    table, stream = source(spark, sf, tmp_path)
    drained(S.deduplicated(stream, ["user_id", "event_type"], watermark="4000 days").writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c").start())
    assert spark.table("firsts").count() == table.select("user_id", "event_type").distinct().count()


def test_lifecycle(spark, tmp_path):
    rows = [(1, 1, True), (1, 2, True), (2, 1, True), (2, 2, True), (2, 3, False), (2, 4, False), (3, 1, True), (3, 2, False), (3, 3, False), (3, 4, False)]
    spark.createDataFrame(rows, "object_id long, order long, seen boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("object_id long, order long, seen boolean").parquet(f"{tmp_path}/in")
    drained(S.lifecycle(stream).writeStream.outputMode("update").format("memory").queryName("lives").option("checkpointLocation", f"{tmp_path}/c").start())
    assert {r.object_id: r.state for r in spark.table("lives").collect()} == {1: "confirmed", 2: "struck", 3: "removed"}


def test_upsert(spark, sf, tmp_path):
    table, stream = source(spark, sf, tmp_path)
    drained(S.upsert_latest(stream, f"file://{tmp_path}/map", "user_id", "event_id").option("checkpointLocation", f"{tmp_path}/c").start())
    got = {r.user_id: r.event_id for r in VersionStore(spark, f"file://{tmp_path}/map").read().collect()}
    assert got == {r.user_id: r.e for r in table.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
