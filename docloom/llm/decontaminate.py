"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, native.

Documents are cut into windows of as many words as the benchmark's windows have. One pass
walks all words; a window is hashed and looked up in the broadcast set where the longest word
of some n-gram stands at its place in it (no other window can be in the set), and the words of
a hash hit are compared with the n-gram itself. A mark after the last word of each document
always hits, so that the same pass also brings one row for documents without hits, and the
texts are neither joined nor shuffled.

The set grows with the benchmark only. Up to MAX_BROADCAST bytes it is broadcast. Beyond that, hashes of windows are
shuffled with their text's hash and place, without words: first those that a bitmap of BITS bits lets through, which is all that
is broadcast then. Grams that meet an equal hash are brought to their texts, which are shuffled once, and compared with
the words there. The results are the same.

Defined results: a null or wordless text has no words and no hits; an item without words is
never found; n-grams that several items share count for each of them; an item without item_id counts for hits and
is left out of the list of items. A row of the input
gives a row of the result, repeated rows included. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, bound, table

N = 10
#: Bytes of n-grams and item ids.
MAX_BROADCAST = 64 << 20
BITS = 1 << 26
#: A word: digits, letters a-z, and all beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """m, gram (its words), items (ids as strings): the distinct windows of the benchmark."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    m = F.least(F.lit(n), F.size("w"))
    grams = w.select("item", m.alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m))).alias("gram"))
    return grams.groupBy("m", "gram").agg(F.collect_set("item").alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans (word ranges of the windows, ends exclusive, sorted), items (sorted ids) per row of docs."""
    grams = ngrams(benchmark, n)
    of_items = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 24)
    size = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + 24 * F.col("m") + of_items + 64)).first()[0] or 0
    found = _probe(docs, grams) if size <= max_broadcast else _exchange(docs, grams, n)
    counted = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["upto"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return found.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), counted.alias("n_hit"), "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def _probe(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Windows at anchor words, looked up in the broadcast set."""
    longest = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("n"), x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<string>")
    end_mark = docs.sparkSession.range(1).select(F.lit(0).alias("m"), none.alias("gram"), none.alias("items"), F.lit("").alias("anchor"), F.lit(0).alias("offset"))
    grams = grams.select("m", "gram", "items", longest["x"].alias("anchor"), longest["i"].alias("offset")).unionByName(end_mark)
    anchors = F.broadcast(grams.select(F.xxhash64("anchor").alias("anchor"), "m", "offset").distinct())
    grams = F.broadcast(grams.select(F.xxhash64("gram").alias("key"), "m", "gram", "items"))

    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    read = read.select("doc_id", "text_key", "n_words", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
    starts = read.withColumn("anchor", F.xxhash64("word")).join(anchors, "anchor").withColumn("start", F.col("at") - F.col("offset"))
    inside = F.when(F.col("m") > 0, (F.col("start") >= 0) & (F.col("start") + F.col("m") <= F.col("n_words"))).otherwise(F.col("at") == F.col("n_words"))
    window = F.when(F.col("m") > 0, F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("m"))).otherwise(none)
    windows = starts.filter(inside).select("doc_id", "text_key", "n_words", "m", "start", window.alias("window"))
    probes = windows.withColumn("key", F.xxhash64("window")).join(grams, ["key", "m"]).filter(F.col("window") == F.col("gram"))
    span = F.when(F.col("m") > 0, F.struct(F.col("start").alias("s"), (F.col("start") + F.col("m")).alias("e")))
    hits = probes.select("doc_id", "text_key", "n_words", span.alias("span"), "items")
    per_doc = hits.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.col("span").isNull().cast("long")).alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("items"),
    )
    return per_doc.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).drop("row", "rows")


def _exchange(docs: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """Hashes of all windows that the bitmap lets through meet those of the grams in a shuffle."""
    sizes = sorted(r["m"] for r in grams.select("m").distinct().collect())  # n of them at most
    grams = grams.select(F.xxhash64("gram").alias("key"), "m", "gram", "items")
    bit = F.pmod("key", F.lit(BITS)).cast("int")
    bitmap = grams.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.size(words(F.col("text"))).alias("n_words"))
    w = docs.select(F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))

    def starts(m: int) -> Column:
        window = lambda i: F.struct(F.xxhash64(F.slice("w", i + 1, F.lit(m))).alias("key"), (i * (n + 1) + m).cast("int").alias("place"))
        return F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(0), F.size("w") - m), window)).otherwise(F.array().cast("array<struct<key:bigint,place:int>>"))

    rows = w.select("text_key", F.explode(F.concat(*map(starts, sizes))).alias("x")).select("text_key", "x.key", "x.place")
    rows = rows.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(bitmap), "word").filter("(bits & shiftleft(1L, cast(key & 63 as int))) <> 0").drop("word", "bits")
    met = rows.join(grams, "key").filter(F.col("place") % (n + 1) == F.col("m"))
    start = F.floor(F.col("place") / (n + 1)).cast("int")
    met = met.groupBy("text_key").agg(F.collect_set(F.struct(start.alias("s"), (start + F.col("m")).alias("e"), "m", "gram", "items")).alias("met"))
    given = texts.join(met, "text_key", "left")
    same = bound(lambda v: F.filter(v["met"], lambda x: F.slice(v["w"], x["s"] + 1, x["m"]) == x["gram"]), met=F.col("met"), w=words(F.col("text")))
    hits = given.select("doc_id", "text_key", "n_words", F.when(F.col("met").isNotNull(), same).alias("hits"))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))
    items = F.transform("hits", lambda x: x["items"])
    return hits.select("doc_id", "text_key", "n_words", F.coalesce(spans, F.array().cast("array<struct<s:int,e:int>>")).alias("spans"), F.coalesce(items, F.array().cast("array<array<string>>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, spans: bool = False) -> DataFrame:
    """The rows of docs, all columns, without the documents in whose text a window of the benchmark occurs.

    With spans, these documents stay and lose the words inside windows, each with what separates it from the word before.
    """
    found = find(docs, benchmark, n).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    on = docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__key"])
    if not spans:
        return docs.join(found, on, "left_anti")
    pieces = F.regexp_extract_all(docs["text"], F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform("__spans", lambda x: F.sequence(x["s"], x["e"] - 1))))
    stay = bound(lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["pieces"]) - 1), v["gone"]), lambda i: F.get(v["pieces"], i)), ""), pieces=pieces, gone=gone)
    tail = F.reverse(F.regexp_extract(F.reverse(docs["text"]), r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0))
    cut = F.concat(stay, tail)
    return docs.join(found, on, "left").select(*(F.when(F.col("__spans").isNull(), docs[c]).otherwise(cut).alias(c) if c == "text" else docs[c] for c in docs.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: CTEs over {docs}: found(doc_id, s, m, item_id), a row per window of a document that is one of an item.
FOUND_SQL = f"""
 bw AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark),
 bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
 bg AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM bm, unnest(range(1, len(w) - m + 2)) AS u(i)),
 dw AS (SELECT doc_id, {sql_words('text')} AS w FROM {{docs}}),
 ms AS (SELECT DISTINCT m FROM bg),
 dg AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM dw, ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
 found AS (SELECT doc_id, i AS s, dg.m, item_id FROM dg JOIN bg USING (m, g))"""

SQL = f"""
WITH {FOUND_SQL.format(docs='documents')},
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + m)) AS u(p) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE = {"op5_decontaminate": SQL}
