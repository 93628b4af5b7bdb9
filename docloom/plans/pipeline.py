"""The compositions: normalise, translate, resume, and the whole run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import chunking, cleanup, layout, markdown, state, tables

KEYS = ("doc_id",)


def normalize(docs: DataFrame, layouts: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Blocks of documents (doc_id, text): parsed, headings restored from layouts (doc_id, layout_json), tables converted, cleaned.

    Restoring comes before filling, so that restored headings stay, and cleaning after conversion, so that converted tables
    are cleaned too. Tables are converted first of all, which no heading sees: the Python step forgets how rows
    are dealt. The blocks are then shuffled once, by document, for the levels' join, the windows and what follows.
    """
    blocks = tables.convert_tables(markdown.parse_markdown(docs, compat=compat))
    if layouts is not None:
        blocks = layout.restore_headings(blocks, layout.heading_levels(layout.layout_items(layouts)))
    return cleanup.clean(cleanup.fill_text(blocks))


def translate(blocks: DataFrame, translator: Callable[[DataFrame], DataFrame], hard_limit: int = chunking.HARD_LIMIT) -> DataFrame:
    """doc_id, text: translatable chunks through translator (adds a column translation), put back and serialised."""
    chunks = chunking.chunk_blocks(blocks, hard_limit)
    return markdown.serialize_markdown(chunking.apply_translations(blocks, translator(chunks)))


def resume(blocks: DataFrame, results: DataFrame, translator: Callable[[DataFrame], DataFrame], model: str, target_lang: str, hard_limit: int = chunking.HARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Documents with old and new translations, and the new results; only chunks without a result are translated.

    Equal texts are translated once, wherever they stand.
    """
    chunks = chunking.chunk_blocks(blocks, hard_limit)
    todo = state.pending(chunks, results, model, target_lang).select("source_hash", "source_text").dropDuplicates(["source_hash"])
    new = translator(todo).select("source_hash", F.lit(model).alias("model"), F.lit(target_lang).alias("target_lang"), "translation", F.lit("done").alias("status"), F.current_timestamp().alias("stored_at"))
    every = state.with_results(chunks, results.unionByName(new), model, target_lang)
    return markdown.serialize_markdown(chunking.apply_translations(blocks, every)), new


def mock_translator(chunks: DataFrame) -> DataFrame:
    """A translation that any engine can repeat: the first 20 characters in brackets."""
    text = F.col("source_text")
    return chunks.withColumn("translation", F.when(F.trim(text) == "", text).otherwise(F.concat(F.lit("译["), F.left(text, F.lit(20)), F.lit("]"))))
