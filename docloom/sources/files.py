"""Scans and sinks of text, layout lists, assets and results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.images import filter_assets
from docloom.operators.markdown import serialize_markdown


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?/*\z", 1)


def parent(path: str) -> str:
    """The folder, or pattern of folders, of a path or pattern."""
    return path.rstrip("/").rsplit("/", 1)[0] or "/" if "/" in path.rstrip("/") else "."


def read_markdown(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """source_path, stem, text: one row for each file, of those that are named as asked."""
    rows = (spark.read.option("pathGlobFilter", only) if only else spark.read).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return rows.select("source_path", stem(F.col("source_path")).alias("stem"), "text")


def with_layout(docs: DataFrame, *candidates: DataFrame, key: str = "source_path") -> DataFrame:
    """docs with layout_json from the first of the candidates (key, layout_json) that has one, '' without."""
    out = docs
    for i, c in enumerate(candidates):
        out = out.join(c.select(key, F.col("layout_json").alias(f"__layout{i}")), key, "left")
    found = F.coalesce(*(F.col(f"__layout{i}") for i in range(len(candidates))), F.lit(""))
    return out.withColumn("layout_json", found).drop(*(f"__layout{i}" for i in range(len(candidates))))


def write_documents(blocks: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """The serialised documents as Parquet: keys, text."""
    serialize_markdown(blocks, keys).write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def kept_assets(assets: DataFrame, docs: DataFrame, text: str = "markdown", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The assets that documents refer to, of images/ only: nothing is written outside that folder."""
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    return filter_assets(assets, docs, text, keys).filter(name.startswith("images/") & ~name.rlike(r"(?:\A|/)\.\.(?:/|\z)"))


def write_assets(assets: DataFrame, docs: DataFrame, path: str, text: str = "markdown", keys: tuple[str, ...] = ("path",)) -> None:
    """The same as a table."""
    kept_assets(assets, docs, text, keys).write.mode("overwrite").parquet(path)


def write_named(rows: DataFrame) -> int:
    """Write files (path, content) from the tasks that hold them, each under its own name; how many.

    Paths are of a file system that all tasks reach. A file is written under another name first and then moved, so that a
    task that is tried again leaves a whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)
                folder, name = at.rsplit("/", 1)
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/.{name}.part"
                with system.open_output_stream(draft) as out:
                    out.write(content or b"")
                system.move(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def present(spark: SparkSession, folder: str) -> DataFrame:
    """path of the files at any depth of a folder; none where there is no folder."""
    from docloom.streaming.resume import exists

    if not exists(spark, folder):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def images_beside(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """folder, name (images/...), content of the files in images/ of folders (folder), read by the tasks that get the folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, at = fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*://", folder) else (fs.LocalFileSystem(), folder)
                found = system.get_file_info(fs.FileSelector(f"{at}/images", allow_not_found=True))
                for info in sorted((x for x in found if x.is_file), key=lambda x: x.path):
                    with system.open_input_stream(info.path) as f:
                        row = (folder, "images/" + info.path.rsplit("/", 1)[-1], f.read())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["folder", "name", "content"])

    return folders.select("folder").mapInArrow(run, "folder string, name string, content binary")
