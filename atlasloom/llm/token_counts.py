r"""Token counts without a shuffle: a two-tier map-side lookup.

A bounded sample (`sample_rows`, 2000 by default, of at most 64 KB) gives the frequent pre-tokens. Their lengths in tokens, at most
`table_words` pairs of a 64-bit hash and a length, are broadcast as one compact table: that bound holds at every size of
the corpus. A worker adds up table entries by hash; a pre-token that is not in the table is encoded by the library
once and kept in the worker's bounded table. The sample decides speed alone: every whole text is counted exactly.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each for itself; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import bpe, common, pretokens, records

TABLE_WORDS = 65_536
OUT = "n_tokens bigint"


def _frequent(path: str, words: int):
    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(w for w in bpe.PRE_TOKEN.findall(text or "") if len(w) <= bpe.LONGEST_KEPT)
        kept = [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:words]]
        lengths = [len(i) for i in bpe.encoder(path)._learned(kept)]
        value, once = np.unique(pretokens.hashes(kept), return_index=True) if kept else (np.empty(0, np.uint64), np.empty(0, int))
        yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(np.array(lengths, np.int64)[once])})

    return count


def length_table(docs: DataFrame, path: str, text: str = "text", sample_rows: int = 2000, table_words: int = TABLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent pre-tokens and their lengths in tokens; at most `table_words`, 12 bytes each."""
    found = common.sampled(docs, text, sample_rows).mapInArrow(_frequent(path, table_words), "h bigint, n bigint").toArrow()
    return found["h"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.uint32)


def counted(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, sample_rows: int = 2000, table_words: int = TABLE_WORDS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row."""
    common.ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(length_table(docs, path, text, sample_rows, table_words))
    name = uuid.uuid4().hex

    def count(batches):
        counter = bpe.counter(path, name, lambda: table.value)
        for batch in batches:
            n = pa.array([c for group in records.grouped(batch.column(1)) for c in counter.count_many(group)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=[key, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.octet_length(common.text_or_empty(text)).cast("long").alias("n_bytes"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
