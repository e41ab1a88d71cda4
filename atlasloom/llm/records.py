r"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is framed as

    length of the payload, u64 | masked crc32 of those 8 bytes, u32 | payload | masked crc32 of the payload, u32

all little-endian, with mask(c) = rotate right by 15 bits, plus 0xa282ead8 (fixed values). The payload holds the
number of ids (u32), the bytes of an id (u32: 2 where the vocabulary has at most 65536 ids, else 4) and the ids.
Documents are range-partitioned and sorted by key, so a file holds consecutive documents in ascending order and file
numbers ascend too. Every task attempt writes a file of a name of its own in the shared folder; only files that the
index names count, and the index is written through Spark's commit protocol, so attempts that were lost or ran twice
leave nothing behind that anyone reads. The index (key, file, offset, length, tokens) is what shuffled reads use.

Defined cases: a null text encodes as empty (the end id alone); a null key sorts first; equal keys are ordered by
text; repeated rows get a record each; an empty table writes an index without rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasloom.llm import bpe, common

#: Bytes before, after and at the start of a payload.
HEAD, TAIL, META = 12, 4, 8
READ_BYTES = 16 << 20
GROUP_CHARACTERS = 2 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: bytes, width: int) -> bytes:
    payload = struct.pack("<II", len(ids) // width, width) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0) -> tuple[np.ndarray, int]:
    """Ids of the record at a place, and the place after it; raises on a wrong checksum."""
    size = bytes(data[at : at + 8])
    length, check = struct.unpack_from("<QI", data, at)
    end = at + HEAD + length
    if check != masked(size):
        raise ValueError(f"length checksum differs at {at}")
    payload = bytes(data[at + HEAD : end])
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"payload checksum differs at {at}")
    n, width = struct.unpack_from("<II", payload)
    return np.frombuffer(payload, f"<u{width}", n, META), end + TAIL


def grouped(texts: pa.Array, most: int = GROUP_CHARACTERS):
    """Texts, nulls empty, in groups of some megabytes."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def opened(uri: str):
    """File system and path of a URI, on whatever shared store it is."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Writes files and index under `path` and returns the index: (key, part, ordinal, file, offset, length, part_start, n_tokens)."""
    spark = docs.sparkSession
    common.ship(spark)

    def encode(batches):
        from pyspark import TaskContext

        encoder, part = bpe.encoder(tokenizer_path), TaskContext.get().partitionId()
        width, end = encoder.type.itemsize, np.array([end_id], encoder.type).tobytes()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        store, where = opened(path)
        out, offset, start, ordinal = None, 0, 0, 0
        try:
            for batch in batches:
                sizes, counts = [], []
                out = out or store.open_output_stream(f"{where}/{name}")
                for ids in (i for group in grouped(batch.column(1)) for i in encoder.encode_many(group)):
                    record = frame(ids + end, width)
                    out.write(record)
                    sizes.append(len(record))
                    counts.append((len(record) - HEAD - TAIL - META) // width)
                n = len(sizes)
                lengths, tokens = np.array(sizes, np.int64), np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(ordinal, ordinal + n)), pa.array([name] * n, pa.string()), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(start + np.cumsum(tokens) - tokens), pa.array(tokens)],
                    names=[key, "part", "ordinal", "file", "offset", "length", "part_start", "n_tokens"],
                )
                offset, start, ordinal = offset + int(lengths.sum()), start + int(tokens.sum()), ordinal + n
        finally:
            if out:
                out.close()

    store, where = opened(path)
    store.create_dir(where, recursive=True)
    rows = docs.select(F.col(key), F.col(text).alias("_text")).repartitionByRange(files or common.partitions(spark), F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col("_text").asc_nulls_first())
    kind = rows.schema[key].dataType.simpleString()
    rows.mapInArrow(common.lean(encode), f"`{key}` {kind}, part int, ordinal bigint, file string, offset bigint, length bigint, part_start bigint, n_tokens bigint").write.parquet(f"{path}/index")
    return index(spark, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def starts(found: DataFrame) -> DataFrame:
    """The index with `start`: ids of all documents before. Only one row of each file meets in the running sum."""
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return found.join(before, "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def read(found: DataFrame, path: str, digest: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The records that an index names, in any order and from any subset of it: (keep..., ids), or their count and crc32 with `digest`.

    Neighbouring records of a file are read at once, up to 16 MB.
    """
    common.ship(found.sparkSession)

    def load(batches):
        files: dict[str, object] = {}
        store, where = opened(path)
        for batch in batches:
            names, offsets, lengths = (batch.column(k) for k in range(3))
            names, offsets, lengths = names.to_pylist(), offsets.to_numpy(), lengths.to_numpy()
            got, k = [], 0
            while k < len(names):
                end = k + 1
                while end < len(names) and names[end] == names[k] and offsets[end] == offsets[end - 1] + lengths[end - 1] and offsets[end] + lengths[end] - offsets[k] <= READ_BYTES:
                    end += 1
                if names[k] not in files:
                    for f in files.values():
                        f.close()
                    files = {names[k]: store.open_input_file(f"{where}/{names[k]}")}
                data = files[names[k]].read_at(int(offsets[end - 1] + lengths[end - 1] - offsets[k]), int(offsets[k]))
                at = 0
                for _ in range(k, end):
                    ids, at = unframe(data, at)
                    got.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())) if digest else ids)
                k = end
            values = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())] if digest else [pa.array(got, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *values], names=[*keep, *(("n_read", "ids_crc32") if digest else ("ids",))])
        for f in files.values():
            f.close()

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)
    return found.select("file", "offset", "length", *keep).mapInArrow(common.lean(load), f"{kinds}, " + ("n_read bigint, ids_crc32 bigint" if digest else "ids array<bigint>"))
