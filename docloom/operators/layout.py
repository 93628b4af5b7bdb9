"""Layout records of parsed documents and the heading levels they and section numbers imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import dots, is_roman, level_of_type, number_token, title_key

KEYS = ("doc_id",)
LIST_KEYS = ("content_list", "contents", "data", "items")
HEADING_TYPES = ("title", "heading", "h1", "h2", "h3", "h4", "h5", "h6")


def layout_items(docs: DataFrame, json: str = "layout_json", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, item_no (from 1), type, text_level, page_idx, bbox, text, raw for each record.

    The JSON is a list, or an object whose first list under one of LIST_KEYS counts; what is blank, invalid or anything
    else has no records, and what is no object is no record. Numbers are read tolerantly.
    """
    parsed = docs.select(*keys, F.try_parse_json(F.col(json)).alias("__v"))
    items = F.coalesce(*(F.try_variant_get("__v", path, "array<variant>") for path in ("$", *(f"$.{k}" for k in LIST_KEYS))))
    rows = parsed.select(*keys, F.posexplode(F.filter(items, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())).alias("at", "raw"))
    get = lambda path, kind: F.try_variant_get(F.col("raw"), path, kind)
    boxes = F.transform(get("$.bbox", "array<variant>"), lambda x: F.try_variant_get(x, "$", "double"))
    return rows.select(
        *keys, (F.col("at") + 1).alias("item_no"), F.coalesce(get("$.type", "string"), F.lit("")).alias("type"),
        F.coalesce(get("$.text_level", "int"), F.lit(0)).alias("text_level"), F.coalesce(get("$.page_idx", "int"), F.lit(0)).alias("page_idx"),
        F.coalesce(F.filter(boxes, lambda x: x.isNotNull()), F.array().cast("array<double>")).alias("bbox"),
        F.coalesce(get("$.text", "string"), F.lit("")).alias("text"), "raw",
    )


def is_heading(type_: Column, level: Column) -> Column:
    return type_.isin(*HEADING_TYPES) | (level > 0)


def heading_items(items: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, item_no, type, text_level, title, hint, token, kind of the records that are headings.

    Kinds: arabic; roman for several Roman numerals; alpha for other letters. Where a document has
    roman ones and letters that run on (A, B, C), a letter outside such a run that is a Roman numeral is roman too.
    """
    found = items.filter(is_heading(F.col("type"), F.col("text_level"))).withColumn("title", title_key(F.col("text"))).filter("title <> ''")
    found = found.withColumn("t", number_token(F.col("title"))).select(*keys, "item_no", "type", "text_level", "title", "t.hint", "t.token")
    doc, order = Window.partitionBy(*keys), Window.partitionBy(*keys, F.col("one").isNotNull()).orderBy("item_no")
    roman = (F.col("hint") == "letter") & is_roman(F.col("token"))
    found = found.withColumn("any_roman", F.bool_or(roman).over(doc))  # first, so that one exchange by document serves all windows
    found = found.withColumn("one", F.when((F.col("hint") == "letter") & (F.length("token") == 1), F.upper("token")))
    code = F.ascii("one")
    first, second = F.lead(code, 1).over(order), F.lead(code, 2).over(order)
    runs = F.when(F.col("one").isNotNull() & (first - code == 1) & (second - first == 1), F.array("one", F.char(first), F.char(second)))
    found = found.withColumn("run", runs)
    letters = F.array_distinct(F.flatten(F.collect_set("run").over(doc)))
    found = found.withColumn("in_runs", letters)
    odd = F.col("any_roman") & (F.size("in_runs") > 0) & ~F.array_contains("in_runs", F.upper("token"))
    kind = F.when(F.col("hint") == "arabic", "arabic").when(roman, "roman").when(F.col("hint") == "letter", F.when(odd & F.upper("token").rlike(r"\A[IVXLCDM]\z"), "roman").otherwise("alpha")).otherwise("")
    return found.withColumn("kind", kind).select(*keys, "item_no", "type", "text_level", "title", "hint", "token", "kind")


def _commonest(levels: Column) -> Column:
    """The most frequent, of equally frequent ones the lowest."""
    return F.mode(levels, True)


def _facts() -> dict[str, Column]:
    """What the anchor depends on, as aggregates over a document's headings."""
    plain = (F.col("kind") == "") & (F.col("text_level") > 0)
    return {
        "base": _commonest(F.when(plain, F.col("text_level"))), "all_levels": _commonest(F.when(F.col("text_level") > 0, F.col("text_level"))),
        "first": F.min(F.when(F.col("kind") != "", F.col("item_no"))), "plain": F.collect_list(F.when(F.col("kind") == "", F.struct("item_no", "text_level"))),
    }


def _anchor() -> Column:
    nested = F.exists("plain", lambda x: (x["item_no"] < F.col("first")) & (x["text_level"] >= F.col("base")))
    known = F.when(F.col("base").isNotNull(), F.least(F.col("base") + nested.cast("int"), F.lit(6))).otherwise(F.least(F.coalesce("all_levels", F.lit(2)), F.lit(6)))
    return F.when(F.col("first").isNull(), 2).otherwise(known).cast("int")


def numbering_anchor(headings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, anchor: the level at which a document's numbering starts.

    2 without numbers. Else the commonest level of headings without numbers, one deeper where such a heading of that
    level or deeper precedes the first number; without such headings the commonest level of all. 6 at most.
    """
    return headings.groupBy(*keys).agg(*(c.alias(n) for n, c in _facts().items())).select(*keys, _anchor().alias("anchor"))


def heading_levels(items: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, title, level: the first level found for each title, 6 at most. All by document: one exchange."""
    doc = Window.partitionBy(*keys)
    joined = heading_items(items, keys).withColumns({n: c.over(doc) for n, c in _facts().items()}).withColumn("anchor", _anchor())
    numbered = F.when(F.col("kind") == "arabic", F.col("anchor") + dots(F.col("token"))).when(F.col("kind") == "roman", F.col("anchor")).when(F.col("kind") == "alpha", F.col("anchor") + 1)
    stated = F.when(F.col("text_level") > 0, F.col("text_level")).otherwise(level_of_type(F.col("type")))
    level = F.when((F.col("hint") == "") & (F.col("text_level") > 2), F.col("text_level")).otherwise(F.coalesce(F.when(numbered > 0, numbered), stated))
    found = joined.withColumn("level", level).filter("level > 0")
    return found.groupBy(*keys, "title").agg(F.min_by(F.least("level", F.lit(6)), "item_no").cast("int").alias("level"))


def level_maps(levels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, levels: each document's levels as a map by title."""
    return levels.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("title", "level"))).alias("levels"))


def restore_from(blocks: DataFrame, levels: Column) -> DataFrame:
    """Headings whose title has another level in the map are rewritten to it."""
    known = F.when(F.col("type") == "heading", F.try_element_at(levels, title_key(F.col("title"))))
    changed = blocks.withColumn("__level", F.when((known != 0) & (known != F.col("level")), known))
    line = F.concat(F.repeat(F.lit("#"), F.col("__level")), F.lit(" "), F.col("title"))
    changed = changed.withColumn("normalized_text", F.coalesce(line, F.col("normalized_text"))).withColumn("restored", F.col("restored") | F.col("__level").isNotNull())
    return changed.withColumn("level", F.coalesce("__level", "level")).drop("__level")


def restore_headings(blocks: DataFrame, levels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same from a table of levels (keys, title, level), joined by document, so that the blocks are dealt
    by the key that windows and aggregations of documents need as well."""
    maps = level_maps(levels, keys).withColumnRenamed("levels", "__levels")
    return restore_from(blocks.join(maps, list(keys), "left"), F.col("__levels")).select(*blocks.columns)


def heading_level(titles: DataFrame, levels: DataFrame, default: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """titles (keys, title) with the level looked up, or the default."""
    known = levels.select(*keys, F.col("title").alias("__title"), "level")
    return titles.withColumn("__title", title_key(F.col("title"))).join(known, [*keys, "__title"], "left").select(*keys, "title", F.coalesce("level", F.lit(default)).alias("level"))
