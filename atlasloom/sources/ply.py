"""Point tables in PLY files: binary little-endian and ASCII."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scalar types of the format (fixed values).
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLUMNS = "x double, y double, z double, r int, g int, b int, label int, nx double, ny double, nz double"
NAMES = {"red": "r", "green": "g", "blue": "b"}


def header(data: bytes) -> tuple[str, int, list[tuple[str, str]], list[str], int]:
    """Format, vertex count, properties, comments, and where the vertices begin."""
    end = data.index(b"end_header") + len(b"end_header")
    end = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, n, properties, comments, vertex = "", 0, [], [], False
    for line in lines[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "comment":
            comments.append(line[8:].strip())
        elif words[0] == "element":
            vertex = words[1] == "vertex"
            n = int(words[2]) if vertex else n
        elif words[0] == "property" and vertex:
            properties.append((NAMES.get(words[2], words[2]), TYPES[words[1]]))
    if kind not in ("binary_little_endian", "ascii"):
        raise ValueError(f"unsupported format {kind}")
    return kind, n, properties, comments, end


def vertices(data: bytes) -> np.ndarray:
    kind, n, properties, _, at = header(data)
    record = np.dtype([(name, f"<{t}") for name, t in properties])
    if kind == "ascii":
        rows = [tuple(line.split()) for line in data[at:].decode("ascii").splitlines()[:n]]
        return np.array(rows, record) if rows else np.empty(0, record)
    if len(data) - at < n * record.itemsize:
        raise ValueError("file ends before its last vertex")
    return np.frombuffer(data, record, n, at)


def _parse(chunk: int):
    def run(batches):
        fields = [f.split() for f in COLUMNS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vertices(content.as_py())
                for k in range(0, len(v), chunk):
                    part = v[k : k + chunk]
                    kind = {"double": (np.float64, pa.float64()), "int": (np.int32, pa.int32())}
                    arrays = [pa.array(part[n].astype(kind[t][0]), kind[t][1]) if n in v.dtype.names else pa.nulls(len(part), kind[t][1]) for n, t in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(k, k + len(part))), *arrays], names=["path", "rid", *[n for n, _ in fields]])

    return run


def read(spark: SparkSession, path: str, chunk: int = 100_000) -> DataFrame:
    """Vertices of all files of a path, with the file and the row's number in it; absent properties are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content")
    return files.mapInArrow(_parse(chunk), f"path string, rid bigint, {COLUMNS}")


def encoded(points: np.ndarray, comments: tuple[str, ...] = ()) -> bytes:
    """A structured array as binary PLY."""
    names = {"f4": "float", "f8": "double", "u1": "uchar", "i4": "int", "u2": "ushort", "i2": "short", "u4": "uint", "i1": "char"}
    out = {v: k for k, v in NAMES.items()}
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments], f"element vertex {len(points)}", *[f"property {names[points.dtype[n].str[1:]]} {out.get(n, n)}" for n in points.dtype.names], "end_header"]
    return ("\n".join(lines) + "\n").encode("ascii") + points.tobytes()


def _render(comments: tuple[str, ...]):
    record = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("label", "<i4")]

    def run(batches):
        parts = []
        for batch in batches:
            v = np.empty(len(batch), record)
            for name, _ in record:
                v[name] = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            parts.append(v)
        if parts:
            v = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), pa.array([encoded(v, comments)], pa.binary())], names=["n", "content"])

    return run


def write(points: DataFrame, comments: tuple[str, ...] = ()) -> DataFrame:
    """One PLY file's bytes for each partition: (n, content). Where they go is the caller's choice of sink."""
    cols = [F.col(c).cast("double" if c in "xyz" else "int").alias(c) for c in ("x", "y", "z", "r", "g", "b", "label")]
    return points.select(*cols).mapInArrow(_render(comments), "n bigint, content binary")
