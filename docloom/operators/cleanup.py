"""Normalising, cleaning and de-duplicating blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import clean_block, effective_text, image_source, strip
from docloom.operators.markdown import document_order

KEYS = ("doc_id",)


def _text():
    return effective_text(F.col("normalized_text"), F.col("source_text"))


def fill_text(blocks: DataFrame) -> DataFrame:
    """Unset normalised texts become the source's."""
    return blocks.withColumn("normalized_text", _text())


def clean_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("normalized_text", clean_block(F.col("type"), _text()))


def dedupe_adjacent(blocks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Blocks go that follow one of the same type and stripped text."""
    w = document_order(*keys)
    same = (F.lag("type").over(w) == F.col("type")) & (F.lag("__text").over(w) == F.col("__text"))
    marked = blocks.withColumn("__text", strip(_text()))
    return marked.withColumn("__same", F.coalesce(same, F.lit(False))).filter("not __same").drop("__text", "__same")


def dedupe_images(blocks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Images go that follow one with the same target. An image without target stays and stands between others."""
    w = document_order(*keys)
    marked = blocks.withColumn("__src", F.when(F.col("type") == "image", image_source(_text())))
    return marked.withColumn("__same", F.coalesce(F.lag("__src").over(w) == F.col("__src"), F.lit(False))).filter("not __same").drop("__src", "__same")


def clean(blocks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return dedupe_images(dedupe_adjacent(clean_blocks(blocks), keys), keys)
