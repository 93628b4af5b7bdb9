"""Result archives of a document parser: a Markdown file, a layout list, assets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArchiveError(RuntimeError):
    """The bytes are no archive, or it holds no Markdown."""


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files that match."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_members(archives: DataFrame, key: str = "path") -> DataFrame:
    """key, pos, name, content, error: a row for each file in each archive, in archive order; error where the bytes are no archive."""
    kind = archives.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "pos", "name", "content", "error"]
        types = [pa.int32(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for i, data in enumerate(batch.column("content")):
                own = batch.column(key).slice(i, 1)
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py() or b"")) as z:
                        for pos, name in enumerate(n for n in z.namelist() if not n.endswith("/")):
                            yield pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip((pos, name, z.read(name), None), types, strict=True))], names=names)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    yield pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip((None, None, None, f"no valid archive: {e}"), types, strict=True))], names=names)

    return archives.select(key, "content").mapInArrow(run, f"{key} {kind}, pos int, name string, content binary, error string")


def extract(members: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Documents (key, markdown, layout_json, error) and assets (key, name, content).

    The first Markdown file and the first layout list in archive order count; the rest are assets.
    """
    low = F.lower("name")
    is_md, is_list = low.rlike(r"\.(?:md|markdown)\z"), low.endswith("content_list.json")
    picked = members.groupBy(key).agg(
        F.min_by("name", F.when(is_md, F.col("pos"))).alias("md"), F.min_by("name", F.when(is_list, F.col("pos"))).alias("list"),
        F.min_by("content", F.when(is_md, F.col("pos"))).alias("md_bytes"), F.min_by("content", F.when(is_list, F.col("pos"))).alias("list_bytes"), F.max("error").alias("error"),
    )
    valid = lambda c: F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))
    text = lambda c: F.coalesce(valid(F.col(c).cast("string")), F.lit(""))
    docs = picked.select(key, text("md_bytes").alias("markdown"), text("list_bytes").alias("layout_json"), F.coalesce("error", F.when(F.col("md").isNull(), "no Markdown in the archive")).alias("error"))
    used = picked.select(key, F.explode(F.array("md", "list")).alias("name")).filter("name is not null")
    return docs, members.filter("name is not null").join(used, [key, "name"], "left_anti").select(key, "name", "content")
