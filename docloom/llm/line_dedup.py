"""Line de-duplication over overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines are hashed; a window that occurs more than once in the corpus
keeps its first occurrence (smallest doc_id, then position), and the lines that later
occurrences cover go. Covered positions of overlapping windows are merged as a set per
document. A later occurrence that overlaps its own first one, as in a run of equal lines,
only covers the lines beyond it, so that the first occurrence stays whole.

Windows are equal when both a 64-bit and a 32-bit hash of their lines agree. First
occurrences are found by an aggregation with partial sums before the shuffle, so a window
that a third of all rows share costs one row per task there; the join that marks the later
ones leaves rows of unique windows behind and is one that Spark can split when a key is hot.

Defined results: a null text stays null and counts no lines; a text of fewer than three lines and
windows of blank lines only are left alone; rows that share doc_id and text are one document.
All columns of the input come back, in their order, with the cleaned text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bound, table

SPAN = 3


def _windows(docs: DataFrame, span: int) -> DataFrame:
    lines = F.split("text", "\n", -1)
    own = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), lines.alias("l"))
    at = lambda i: F.struct(F.xxhash64(*(F.get("l", i + k) for k in range(span))).alias("a"), F.hash(*(F.get("l", i + k) for k in range(span))).alias("b"), F.concat(*(F.trim(F.get("l", i + k)) for k in range(span))).eqNullSafe("").alias("blank"))
    own = own.filter(F.size("l") >= span).select("d", "t", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("l") - span), at)).alias("p", "w"))
    return own.filter(~F.col("w.blank")).select("d", "t", "p", F.col("w.a").alias("a"), F.col("w.b").alias("b"))


def covered(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """d (doc_id), t (hash of the text), gone: positions of the lines that go, from 0, unordered."""
    windows = _windows(docs, span)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "t", "p")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["a", "b"]).filter(~F.struct("d", "t", "p").eqNullSafe(F.col("first")))
    same = F.col("d").eqNullSafe(F.col("first.d")) & (F.col("t") == F.col("first.t"))
    start = F.when(same, F.greatest(F.col("p"), F.col("first.p") + span)).otherwise(F.col("p"))
    return later.select("d", "t", F.sequence(start, F.col("p") + span - 1).alias("x")).groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_set("x"))).alias("gone"))


def marked(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """All columns of docs with the cleaned text, then __lines and __removed, the lines before and those that went."""
    gone = covered(docs, span).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    on = docs["doc_id"].eqNullSafe(gone["__d"]) & (F.xxhash64(docs["text"]) == gone["__t"])
    lines = F.split(docs["text"], "\n", -1)
    kept = bound(lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["gone"]), lambda i: F.get(v["lines"], i)), "\n"), lines=lines, gone=F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(kept)
    return docs.join(gone, on, "left").select(
        *(cleaned.alias("text") if c == "text" else docs[c] for c in docs.columns),
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__removed"),
    )


def drop_repeated_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without the lines that later occurrences cover, other columns as they were.

    Documents of which no line stays go. n_chars, where there is such a column, is set anew.
    """
    out = marked(docs, span).filter(F.col("text").isNull() | (F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("__lines", "__removed")


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return marked(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


#: CTEs over {docs}: gone(doc_id, i), a row for each line, from 1, that goes.
GONE_SQL = """
 ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs} WHERE text IS NOT NULL),
 wi AS (SELECT doc_id, i, l[i : i + 2] AS w FROM ln, unnest(range(1, len(l) - 1)) AS u(i)),
 rk AS (SELECT doc_id, i, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi
        FROM wi WHERE len(list_filter(w, lambda x: trim(x) <> '')) > 0 WINDOW o AS (PARTITION BY w ORDER BY doc_id, i)),
 gone AS (SELECT DISTINCT doc_id, p AS i FROM rk, unnest(range(CASE WHEN doc_id = fd THEN greatest(i, fi + 3) ELSE i END, i + 3)) AS u(p)
          WHERE doc_id <> fd OR i <> fi)"""

SQL = f"""
WITH {GONE_SQL.format(docs='documents')},
 ga AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ln.l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
       CASE WHEN g IS NULL THEN d.text ELSE array_to_string(list_filter(ln.l, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text
FROM documents d LEFT JOIN ln USING (doc_id) LEFT JOIN ga USING (doc_id)"""

QUERIES = {"op9_line_windows": op9_line_windows}
ORACLE = {"op9_line_windows": SQL}
