"""Translation units: a chunk for each translatable block, or for each sentence of an overlong paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import effective_text, strip
from docloom.operators.markdown import is_translatable

TARGET, HARD_LIMIT = 5000, 6500
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+"


def sentences(text: Column) -> Column:
    """Split after sentence marks; the whole where nothing else is left."""
    parts = F.filter(F.split(text, SENTENCE_END, -1), lambda x: strip(x) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def is_oversize(text: Column, hard_limit: int = HARD_LIMIT) -> Column:
    return F.octet_length(text) > hard_limit


def chunk_blocks(blocks: DataFrame, hard_limit: int = HARD_LIMIT, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, chunk_no, chunk_id, block_no, block_ids, part_no, source_text, source_hash, status, warning."""
    text = effective_text(F.col("normalized_text"), F.col("source_text"))
    own = blocks.filter(is_translatable(F.col("type"))).withColumn("__text", text).withColumn("__large", is_oversize(text, hard_limit))
    cut = F.col("__large") & F.col("type").isin("paragraph", "raw")
    parts = F.when(cut, sentences(F.col("__text"))).otherwise(F.array("__text"))
    warning = F.when(F.col("__large") & ~F.col("type").isin("paragraph", "raw"), F.concat("block_id", F.lit(" ("), "type", F.lit(") is over the hard limit and stays whole")))
    rows = own.select(*keys, "block_no", "block_id", warning.alias("warning"), F.posexplode(parts).alias("part", "source_text"))
    rows = rows.withColumn("chunk_no", F.row_number().over(Window.partitionBy(*keys).orderBy("block_no", "part")))
    over = F.when(F.col("warning").isNull() & is_oversize(F.col("source_text"), hard_limit), F.concat("block_id", F.lit(": a sentence is over the hard limit")))
    return rows.select(
        *keys, "chunk_no", F.format_string("chunk-%06d", "chunk_no").alias("chunk_id"), "block_no", F.array("block_id").alias("block_ids"), (F.col("part") + 1).alias("part_no"),
        "source_text", F.sha2("source_text", 256).alias("source_hash"), F.lit("pending").alias("status"), F.coalesce("warning", over).alias("warning"),
    )


def apply_translations(blocks: DataFrame, translated: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """blocks with the translations (keys, block_no, part_no, translation) of their parts, joined by spaces.

    Blank parts are left out; a block whose translation has no content keeps its text. Headings keep
    their level whatever marks the translation has; blank lines inside paragraphs go.
    """
    from docloom.functions.text import collapse_blank_lines, has_content, with_level

    parts = translated.filter(F.col("translation").isNotNull()).withColumn("__t", F.regexp_replace("translation", r"\n+\z", ""))
    said = parts.groupBy(*keys, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(strip(F.col("translation")) != "", F.struct("part_no", "__t")))), lambda x: x["__t"]), " ").alias("__said"))
    joined = blocks.join(said, [*keys, "block_no"], "left")
    new = F.when(F.col("type") == "heading", with_level(F.col("__said"), F.col("level"))).when(F.col("type") == "paragraph", collapse_blank_lines(F.col("__said"))).otherwise(F.col("__said"))
    return joined.withColumn("normalized_text", F.when(has_content(F.col("__said")), new).otherwise(F.col("normalized_text"))).select(*blocks.columns)
