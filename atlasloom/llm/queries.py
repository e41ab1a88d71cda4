"""Queries of the training-data operators; their SQL, where SQL can express them, is in `sql`."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasloom.llm import chat, common, decontam, jaccard, lm, mixing, passages, periodic, quality, records, sharding, suffix_dedup, token_counts, variants
from atlasloom.llm.sql import ORACLE_SQL  # noqa: F401


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "op1-records")
    found = records.starts(records.write(common.table(spark, sf_dir, "documents"), bpe_path(), path))
    out = records.read(found, path, digest=True, keep=("doc_id", "start"))
    return out.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(common.table(spark, sf_dir, "documents"), bpe_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.report(common.table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.scored(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(common.table(spark, sf_dir, "documents"), repetition=4.0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.flagged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("hit_start", "hit_end", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_start") > 0).alias("contaminated"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(common.table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.components(common.table(spark, sf_dir, "documents"), percent=85, shingle=4)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return chat.read_back(chat.formatted(turns.unionByName(probe)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assigned(common.table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("next_shard").alias("rebalanced_shard"))


def misspelled(key: str, run: str) -> str:
    """The planted misspellings: one run in 199 of a document loses a code point."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % 199:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.counted(common.table(spark, sf_dir, "documents"), shortest=6, edit=misspelled).where("n >= 5")
    return variants.grouped(words, shortest=6, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.deduplicated(common.table(spark, sf_dir, "documents"), window=13)
    removed = F.aggregate(F.zip_with("span_start", "span_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents becomes periodic from a word on; their words are then joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    start = lambda w: F.col("_g") % F.size(w)
    period = lambda w: 1 + F.floor((F.size(w) - start(w)) / (3 + F.col("_g") % 8))
    source = lambda w, i: F.when(i < start(w), i).otherwise(start(w) + (i - start(w)) % period(w))
    rewritten = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, source(w, i).cast("int"))), " ")))
    return docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), h.alias("_h")).select("doc_id", F.when(F.col("_h") % 10 == 0, F.get(rewritten, F.lit(0))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.runs(with_planted_runs(common.table(spark, sf_dir, "documents")), least=12)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = out.withColumn("best", first)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.n * 1000 div best.period").alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_records": op1_token_records,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_chat_format": op9_chat_format,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
