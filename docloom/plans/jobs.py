"""Jobs: files in, parsed and translated documents out, with what happens told as events.

A job's work folder holds what must not be done twice or is worth looking at: archives of the parser, parsed documents and
their assets, normalised blocks, chunks, results, uploads and states, as tables. Its out folder holds the documents as files. Services are
called once for each file, text or batch; their replies are written before anything is made of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import naming
from docloom.functions.retry import Patience
from docloom.functions.text import base_name, rewrite_images
from docloom.operators import chunking, cleanup, images, markdown, state
from docloom.plans import pipeline
from docloom.sources import archives, files
from docloom.sources.config import Config
from docloom.sources.services import DocumentParser, ImageHost, Translator, parse_documents, translate_chunks, upload_images
from docloom.streaming.resume import exists, read_results

# What events are called.
EVENT_TYPES = (
    "JOB_STARTED", "PARSE_SUBMITTED", "PARSE_COMPLETED", "NORMALIZATION_STARTED", "NORMALIZATION_COMPLETED", "CHUNKING_COMPLETED", "TRANSLATION_STARTED",
    "CHUNK_COMPLETED", "IMAGE_UPLOAD_STARTED", "IMAGE_UPLOAD_COMPLETED", "JOB_COMPLETED", "JOB_FAILED",
)


class JobError(RuntimeError):
    """A job that can't go on; what has been done is kept."""


def plain_path(path: Column) -> Column:
    """A file's path as its name is written, from what Spark reports."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"\Afile:/+", "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


@dataclass
class Job:
    """work, out: folders, local or of a file system that driver and executors share."""

    spark: SparkSession
    config: Config
    work: str
    out: str
    parser: Callable[[], DocumentParser] | None = None
    translator: Callable[[], Translator] | None = None
    host: Callable[[], ImageHost] | None = None
    model: str = ""
    emit: Callable[[str, dict], None] = lambda event, data: None

    def _tell(self, event: str, **data: object) -> None:
        if event not in EVENT_TYPES:
            raise ValueError(event)
        self.emit(event, data)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written to the work folder and read again."""
        path = f"{self.work}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _folder(self, path: Column, stem: Column, several: bool) -> Column:
        """Below out: by category where one is given; else a folder for each of several documents, and none for a single one."""
        host = self.config.image_host
        if host.category or host.sub_category:
            return naming.batch_folder(stem, path, F.lit(host.category), F.lit(host.sub_category))
        return naming.folder_name(naming.title(stem)) if several else F.lit("")

    def parse(self, path: str) -> DataFrame:
        """Source files through the parser: doc_id (the Markdown file written), stem, text, layout_json. Assets that a document refers to are written beside it."""
        if self.parser is None:
            raise JobError("no parser is configured")
        self._tell("JOB_STARTED", path=path)
        sources = archives.read_archives(self.spark, path)
        n = sources.count()
        self._tell("PARSE_SUBMITTED", files=n)
        got = self._kept(parse_documents(sources, self.parser), "archives")
        docs, assets = archives.extract(archives.archive_members(got.filter("error is null")))
        failed = got.filter("error is not null").select("path", "error").unionByName(docs.filter("error is not null").select("path", "error"))
        plain = plain_path(F.col("path"))
        stem = files.stem(plain)
        named = docs.filter("error is null").select("path", naming.file_name(naming.title(stem)).alias("stem"), self._folder(plain, stem, n > 1).alias("folder"), "markdown", "layout_json")
        again = F.row_number().over(Window.partitionBy("folder", "stem").orderBy("path"))
        named = named.withColumn("again", again).withColumn("folder", F.when(F.col("again") > 1, F.concat_ws("-", "folder", "again")).otherwise(F.col("folder")))
        place = F.concat_ws("/", F.lit(self.out), F.nullif("folder", F.lit("")))
        parsed = self._kept(named.select("path", place.alias("folder"), F.concat(place, F.lit("/"), "stem", F.lit(".md")).alias("doc_id"), "stem", F.col("markdown").alias("text"), "layout_json"), "parsed")
        kept = files.kept_assets(assets, parsed, "text", ("path",)).join(parsed.select("path", "folder"), "path")
        cached = self._kept(kept.select(F.concat_ws("/", "folder", F.replace("name", F.lit("\\"), F.lit("/"))).alias("path"), "content"), "assets")
        files.write_named(parsed.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))
        files.write_named(cached)
        errors = failed.orderBy("path").limit(20).collect()  # for the message
        done = parsed.count()
        self._tell("PARSE_COMPLETED", documents=done, failed=n - done)
        if errors:
            self._tell("JOB_FAILED", error="; ".join(f"{r.path}: {r.error}" for r in errors))
            if not done:
                raise JobError(f"no file could be parsed: {errors[0].error}")
        return parsed.select("doc_id", "stem", "text", "layout_json")

    def read(self, path: str) -> DataFrame:
        """Markdown files with the layout list that the parser gave for them, or else the content_list.json beside them."""
        docs = files.read_markdown(self.spark, path).select(plain_path(F.col("source_path")).alias("doc_id"), "stem", "text").withColumn("folder", folder_of(F.col("doc_id")))
        parsed = self.spark.read.parquet(f"{self.work}/parsed").select("doc_id", "layout_json") if exists(self.spark, f"{self.work}/parsed") else docs.select("doc_id", F.lit("").alias("layout_json")).limit(0)
        beside = files.read_markdown(self.spark, files.parent(path), "content_list.json").select(folder_of(plain_path(F.col("source_path"))).alias("folder"), F.col("text").alias("layout_json"))
        first = parsed.filter("layout_json <> ''")
        both = files.with_layout(docs, first, docs.select("doc_id", "folder").join(beside, "folder").select("doc_id", "layout_json"), key="doc_id")
        return both.select("doc_id", "stem", "text", "layout_json")

    def normalize(self, docs: DataFrame) -> DataFrame:
        """Blocks of documents (doc_id, stem, text, layout_json); also written as Markdown files."""
        self._tell("NORMALIZATION_STARTED")
        blocks = self._kept(pipeline.normalize(docs.select("doc_id", "text"), docs.select("doc_id", "layout_json")), "blocks")
        name = F.concat(F.lit(f"{self.work}/normalized/"), files.stem(F.col("doc_id")), F.lit("-"), F.left(F.sha1("doc_id"), F.lit(8)), F.lit(".md"))
        files.write_named(markdown.serialize_markdown(blocks).select(name.alias("path"), F.encode("text", "UTF-8").alias("content")))
        self._tell("NORMALIZATION_COMPLETED", blocks=blocks.count())
        return blocks

    def translate(self, docs: DataFrame) -> DataFrame:
        """path of each translated document, written beside its source, with images uploaded where that is enabled."""
        if self.translator is None:
            raise JobError("no translator is configured")
        lang, said = self.config.translation.target_lang, self.config.translation
        docs = self._kept(docs, "documents")
        self._restore_images()
        blocks = self.normalize(docs)
        chunks = chunking.chunk_blocks(blocks, self.config.chunking.hard_limit)
        files.write_chunks(chunks, f"{self.work}/chunks")
        total = chunks.count()
        self._tell("CHUNKING_COMPLETED", chunks=total)
        results = read_results(self.spark, f"{self.work}/results")
        left = state.pending(chunks, results, self.model, lang)
        todo = left.count()
        self._states(docs, "running")
        self._tell("TRANSLATION_STARTED", chunks=total, resumed=total - todo)
        patience = Patience(said.max_retries, said.backoff_base, said.request_interval)
        new = translate_chunks(left.select("source_hash", "source_text").dropDuplicates(["source_hash"]), self.translator, lang, patience, said.concurrency)
        new = self._kept(new, "asked")
        done = new.filter("translation is not null")
        done.select("source_hash", F.lit(self.model).alias("model"), F.lit(lang).alias("target_lang"), "translation", F.lit("done").alias("status"), F.current_timestamp().alias("stored_at")).write.mode("append").parquet(f"{self.work}/results")
        self._tell("CHUNK_COMPLETED", done=done.count(), resumed=total - todo)
        if failed := new.filter("translation is null").agg(F.count(F.lit(1)), F.min("error")).first():
            if failed[0]:
                self._tell("JOB_FAILED", error=f"{failed[0]} texts have no translation: {failed[1]}")
                raise JobError(f"{failed[0]} texts have no translation: {failed[1]}")
        every = state.with_results(chunks, read_results(self.spark, f"{self.work}/results"), self.model, lang)
        texts = markdown.serialize_markdown(chunking.apply_translations(cleanup.fill_text(blocks), every))
        texts = docs.select("doc_id", "stem").join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
        if self.config.image_host.enabled and self.host is not None:
            texts = self._uploaded(docs, texts)
        out = texts.select(naming.translated_path(folder_of(F.col("doc_id")), F.col("stem"), self.config.output.zh_suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
        written = self._kept(out, "translated")
        files.write_named(written)
        self._states(docs, "completed")
        self._tell("JOB_COMPLETED", documents=written.count())
        return written.select("path")

    def resume(self, docs: DataFrame) -> DataFrame:
        """translate() of documents that an earlier job knew and that haven't changed since; others are refused."""
        if not exists(self.spark, f"{self.work}/states"):
            raise JobError("nothing to resume: no earlier job")
        states = self.spark.read.parquet(f"{self.work}/states")
        known = state.verified(states, docs.select(F.col("doc_id").alias("source_path"), F.encode("text", "UTF-8").alias("content"))).select(F.col("source_path").alias("doc_id"))
        n, same = docs.count(), docs.join(known, "doc_id", "left_semi").count()
        if same < n:
            raise JobError(f"{n - same} of {n} documents have changed or are new: translate them instead")
        return self.translate(docs)

    def run(self, path: str) -> DataFrame:
        """Source files to translated documents."""
        return self.translate(self.parse(path))

    def _states(self, docs: DataFrame, status: str) -> None:
        states = docs.select(F.col("doc_id").alias("source_path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("source_hash"), F.lit(self.model).alias("model"), F.lit(status).alias("status"))
        states.write.mode("overwrite").parquet(f"{self.work}/states")

    def _restore_images(self) -> None:
        """Files that the out folder lost come back from the work folder."""
        if exists(self.spark, f"{self.work}/assets"):
            cached = self.spark.read.parquet(f"{self.work}/assets")
            files.write_named(images.missing_files(cached, files.present(self.spark, self.out).select(plain_path(F.col("path")).alias("path")), ("path",)))

    def _uploaded(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """texts with the URLs of the images that stand in images/ beside the documents and that these refer to."""
        host = self.config.image_host
        own = docs.select("doc_id", "stem", "text", folder_of(F.col("doc_id")).alias("folder"))
        found = files.images_beside(self.spark, docs.select(folder_of(F.col("doc_id")).alias("folder")).distinct())
        assets = images.filter_assets(own.select("doc_id", "folder").join(found, "folder").select("doc_id", "name", "content"), own)
        asked = images.upload_records(assets.withColumn("name", base_name(F.col("name"))), ("doc_id",)).filter("error is null")
        sizes = asked.select("doc_id", "name", F.length("contentBase64").alias("size"))
        folder = naming.batch_folder(F.col("stem"), F.col("doc_id"), F.lit(host.category), F.lit(host.sub_category))
        placed = asked.join(images.upload_batches(sizes).drop("size"), ["doc_id", "name"]).join(own.select("doc_id", folder.alias("folder")), "doc_id")
        records = self._kept(placed.withColumn("request_id", naming.request_id(F.col("folder"))), "uploads")
        self._tell("IMAGE_UPLOAD_STARTED", count=records.count())
        urls = self._kept(upload_images(records, self.host), "urls")
        self._tell("IMAGE_UPLOAD_COMPLETED", count=urls.count())
        entry = F.struct(F.concat(F.lit("images/"), "name").alias("key"), F.col("url").alias("value"))
        maps = urls.dropDuplicates(["doc_id", "name"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("urls"))
        return texts.join(maps, "doc_id", "left").withColumn("text", F.when(F.col("urls").isNull(), F.col("text")).otherwise(rewrite_images(F.col("text"), F.col("urls")))).drop("urls")

