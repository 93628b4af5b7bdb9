"""Image references, the assets they keep, and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.folds import running
from docloom.functions.text import base_name, image_references

# What one upload may hold.
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 50, 80 * 1024 * 1024, 20 * 1024 * 1024
# Media types by file extension.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "ico": "image/vnd.microsoft.icon"}


def referenced_images(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ref: each distinct local reference."""
    return docs.select(*keys, F.explode(image_references(F.coalesce(F.col(text), F.lit("")))).alias("ref"))


def filter_assets(assets: DataFrame, docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Assets (keys, name, ...) that their document refers to by path or file name.

    A document without any reference keeps all below images/. Two semi joins on equal keys rather than one on either
    condition, which would compare every asset with every reference.
    """
    refs = referenced_images(docs, text, keys)
    path = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    named = assets.withColumn("__path", path).withColumn("__base", base_name(path))
    by_path = refs.select(*keys, F.col("ref").alias("__path"), F.lit(True).alias("__p")).distinct()
    by_base = refs.select(*keys, base_name(F.col("ref")).alias("__base"), F.lit(True).alias("__b")).distinct()
    any_ref = refs.select(*keys, F.lit(True).alias("__any")).distinct()
    joined = named.join(by_path, [*keys, "__path"], "left").join(by_base, [*keys, "__base"], "left").join(any_ref, list(keys), "left")
    keep = F.when(F.col("__any").isNull(), F.lower("name").startswith("images/")).otherwise(F.col("__p").isNotNull() | F.col("__b").isNotNull())
    return joined.filter(keep).select(*assets.columns)


def missing_files(cached: DataFrame, present: DataFrame, keys: tuple[str, ...] = ("doc_id", "name")) -> DataFrame:
    """Cached files that the output doesn't have yet."""
    return cached.join(present, list(keys), "left_anti")


def mime_type(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))
    return F.coalesce(*(F.when(extension == e, m) for e, m in MIME.items()), F.lit("application/octet-stream"))


def upload_records(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, name, contentBase64, mimeType, sha256 of files (name, content), and error where one is too large."""
    mime = mime_type(F.col("name"))
    large = F.octet_length("content") > MOST_FILE_BYTES
    data = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    return files.select(*keys, "name", F.when(~large, data).alias("contentBase64"), mime.alias("mimeType"), F.sha2("content", 256).alias("sha256"), F.when(large, F.concat(F.lit("larger than "), F.lit(MOST_FILE_BYTES), F.lit(" bytes: "), F.col("name"))).alias("error"))


def upload_batches(files: DataFrame, keys: tuple[str, ...] = ("doc_id",), most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, by: str = "name") -> DataFrame:
    """keys, name, size, batch (from 0): in order of names, or of another column, a batch is full when one more file would pass either limit.

    A fold over each document's files.
    """
    ordered = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), "name", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))).alias("files"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), zero.alias("bytes"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most_files) | (a["bytes"] + x["size"] > most_bytes))
        return F.struct((a["batch"] + full.cast("int")).alias("batch"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.when(full, x["size"]).otherwise(a["bytes"] + x["size"]).alias("bytes"))

    states = running(F.col("files"), start, step, ("batch", "n", "bytes"), "struct<batch:int,n:int,bytes:bigint>")
    placed = ordered.select(*keys, "files", F.transform(states, lambda s: s["batch"]).alias("batches"))
    rows = placed.select(*keys, F.explode(F.arrays_zip("files", "batches")).alias("x"))
    return rows.select(*keys, F.col("x.files.name").alias("name"), F.col("x.files.size").alias("size"), F.col("x.batches").alias("batch"))


def matched_replies(files: DataFrame, replies: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Files (keys, name) with the URL of the reply (keys, src) at the same place; the longer side's rest has no match."""
    place = lambda df, by: df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return place(files, "at").join(place(replies, "at").drop("at"), [*keys, "__at"]).drop("__at")
