"""Scans of record files: episodes, floor plans, targets, vocabularies, calibrations, jobs. All go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasloom.functions.text import normalize_label

ROBOT = "t double, base_x double, base_y double, base_z double, base_yaw double, cam_x double, cam_y double, cam_z double"
JOB = "id string, map string, state string, created double, started double, ended double, timings map<string, double>"
ACTIVE = ("queued", "registering", "fusing")
TARGET = "map<string, struct<op: string, value: double, between: array<double>, info: boolean, parts: map<string, struct<op: string, value: double>>>>"


def episode(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lines of mixed types of one JSONL file by type: meta and objects as JSON texts, robot as a typed track."""
    lines = spark.read.text(path).select("value", F.get_json_object("value", "$.type").alias("type"))
    of = lambda kind: lines.where(F.col("type") == kind)
    return {"meta": of("meta").select("value"), "objects": of("objects").select("value"), "robot": of("robot").select(F.from_json("value", ROBOT, {"mode": "FAILFAST"}).alias("r")).select("r.*")}


def sidecars(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Per-frame JSON files under an explicit schema; a file that lacks a required key raises an error that names key and file."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    for key in required:
        rows = rows.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"missing key {key} in "), F.col("file")))))
    return rows


def floor_plan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rooms with polygons, walls and doors of a nested house file."""
    point = "struct<x: double, z: double>"
    house = spark.read.schema(f"rooms array<struct<id: string, floorPolygon: array<{point}>>>, walls array<struct<id: string, polygon: array<{point}>>>, doors array<struct<id: string, holePolygon: array<{point}>>>").option("multiLine", True).json(path)
    each = lambda field: house.select(F.explode(field).alias("e")).select("e.*")
    polygon = lambda c: F.transform(c, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("y")))
    ends = lambda d, c: d.select("id", F.col(c)[0]["x"].alias("ax"), F.col(c)[0]["z"].alias("ay"), F.element_at(c, -1)["x"].alias("bx"), F.element_at(c, -1)["z"].alias("by"))
    return {"rooms": each("rooms").select("id", polygon("floorPolygon").alias("polygon")), "walls": ends(each("walls"), "polygon"), "doors": ends(each("doors"), "holePolygon")}


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets as a long table: metric_id, part, op, target, lo, hi, info."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", TARGET)).alias("metric_id", "t"))
    parts = F.when(F.col("t.parts").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("part"), F.col("t.op").alias("op"), F.col("t.value").alias("value")))).otherwise(F.transform(F.map_entries("t.parts"), lambda e: F.struct(e["key"].alias("part"), e["value"]["op"].alias("op"), e["value"]["value"].alias("value"))))
    rows = rows.select("metric_id", F.col("t.between").alias("b"), F.coalesce("t.info", F.lit(False)).alias("info"), F.explode(parts).alias("p"))
    return rows.select("metric_id", "p.part", F.when(F.col("b").isNotNull(), "between").otherwise(F.col("p.op")).alias("op"), F.col("p.value").alias("target"), F.get("b", F.lit(0)).alias("lo"), F.get("b", F.lit(1)).alias("hi"), "info")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """`label = prompt` lines in file order, comments and empty lines left out; the first line of a label wins."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where("value RLIKE '^\\\\s*[^#\\\\s]'")
    pair = F.split("value", r"\s*=\s*", 2)
    rows = lines.select("at", F.trim(pair[0]).alias("label"), F.coalesce(F.trim(F.get(pair, F.lit(1))), F.trim(pair[0])).alias("prompt"))
    first = rows.groupBy(normalize_label("label").alias("key")).agg(F.min_by(F.struct("at", "label", "prompt"), "at").alias("r"))
    return first.select("key", "r.label", "r.prompt", "r.at")


def first_source(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """The candidate of the highest priority (the lowest number) per key."""
    w = Window.partitionBy(key).orderBy(priority)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recovered_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records; what was active when the service stopped has failed."""
    rows = spark.read.schema(JOB).json(path)
    return rows.withColumn("state", F.when(F.col("state").isin(*ACTIVE), "failed").otherwise(F.col("state")))


def images(spark: SparkSession, path: str, suffixes: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Names and sizes of images of accepted suffixes; the content column is pruned unless it is asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffixes).load(path)


def merged_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet of several ages: columns that older files lack are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
