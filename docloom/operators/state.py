"""What has been translated already: progress, what is pending, and what must not be used again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results are known by what was asked for, not by a chunk's number, which changes with the limits.
RESULT_KEY = ("source_hash", "model", "target_lang")


def done_results(results: DataFrame) -> DataFrame:
    """One result for each key; of several the one that was stored last."""
    return results.filter("status = 'done'").groupBy(*RESULT_KEY).agg(F.max_by("translation", F.struct("stored_at", "translation")).alias("translation"))


def pending(chunks: DataFrame, results: DataFrame, model: str, target_lang: str) -> DataFrame:
    """Chunks without a result for this model and language."""
    done = done_results(results).filter((F.col("model") == model) & (F.col("target_lang") == target_lang)).select("source_hash")
    return chunks.join(done, "source_hash", "left_anti")


def with_results(chunks: DataFrame, results: DataFrame, model: str, target_lang: str) -> DataFrame:
    done = done_results(results).filter((F.col("model") == model) & (F.col("target_lang") == target_lang)).select("source_hash", "translation")
    return chunks.join(done, "source_hash", "left")


def progress(chunks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, chunks, done, status (running or completed), given finished chunk ids (keys, chunk_id)."""
    marked = chunks.select(*keys, "chunk_id").join(done.select(*keys, "chunk_id").distinct().withColumn("__done", F.lit(1)), [*keys, "chunk_id"], "left")
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.count("__done").alias("done"))
    return counts.withColumn("status", F.when(F.col("chunks") == F.col("done"), "completed").otherwise("running"))


def stale(chunks: DataFrame, saved: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Saved chunks whose id still exists but stands for another text now."""
    now = chunks.select(*keys, "chunk_id", F.col("source_hash").alias("hash_now"))
    return saved.join(now, [*keys, "chunk_id"]).filter("source_hash <> hash_now")


def verified(states: DataFrame, sources: DataFrame) -> DataFrame:
    """States (source_path, source_hash, ...) whose source hasn't changed since; others must not be resumed."""
    now = sources.select("source_path", F.sha2("content", 256).alias("__now"))
    return states.join(now, "source_path").filter("source_hash = __now").drop("__now")


def locate(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_path, work_dir: of the states (source_path, work_dir) of a wanted path the nearest, that is the deepest folder."""
    depth = F.size(F.split("work_dir", "/", -1))
    return states.join(wanted.select("source_path").distinct(), "source_path").groupBy("source_path").agg(F.max_by("work_dir", F.struct(depth, "work_dir")).alias("work_dir"))


def chunk_json(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, json: a document's chunks as a JSON list in order, with the hash filled in."""
    record = F.struct(
        F.col("chunk_no").alias("n"),
        F.struct("chunk_id", "block_ids", F.coalesce(F.nullif("source_hash", F.lit("")), F.sha2("source_text", 256)).alias("source_hash"), "source_text", F.coalesce("translation", F.lit("")).alias("translation"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("model", F.lit("")).alias("model")).alias("r"),
    )
    return chunks.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"])).alias("json"))


CHUNK_SCHEMA = "chunk_id string, block_ids array<string>, source_hash string, source_text string, translation string, status string, model string"


def chunks_from_json(stored: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The way back; fields that are missing get their defaults."""
    rows = stored.select(*keys, F.posexplode(F.from_json("json", f"array<struct<{CHUNK_SCHEMA.replace(' ', ':').replace(',:', ', ')}>>")).alias("at", "r")).filter("r.chunk_id is not null")
    get = lambda c, default: F.coalesce(F.col(f"r.{c}"), default).alias(c)
    empty = F.lit("")
    return rows.select(*keys, (F.col("at") + 1).alias("chunk_no"), "r.chunk_id", get("block_ids", F.array().cast("array<string>")), get("source_hash", empty), get("source_text", empty), get("translation", empty), get("status", F.lit("pending")), get("model", empty))


def state_json(states: DataFrame) -> DataFrame:
    """source_path, json of job states."""
    return states.select("source_path", F.to_json(F.struct("source_path", "source_hash", "model", "status", "chunk_ids", "done_chunk_ids")).alias("json"))


def states_from_json(stored: DataFrame) -> DataFrame:
    """The way back; fields that are missing get their defaults."""
    row = F.from_json("json", "source_path string, source_hash string, model string, status string, chunk_ids array<string>, done_chunk_ids array<string>")
    got = stored.select(row.alias("r"))
    empty, none = F.lit(""), F.array().cast("array<string>")
    defaults = {"source_path": empty, "source_hash": empty, "model": empty, "status": F.lit("running"), "chunk_ids": none, "done_chunk_ids": none}
    return got.select(*(F.coalesce(F.col(f"r.{c}"), d).alias(c) for c, d in defaults.items()))
