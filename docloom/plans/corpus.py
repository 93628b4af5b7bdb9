"""A Markdown corpus derived from plain documents, the same in Spark and in SQL.

Lines are decorated by their place and the document's number, so that every construct occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.spread import spread

CASES = 30
#: (remainder, SQL for the line); x is the line, i its number from 0, doc_id the document.
DECORATED = (
    (0, "concat('## ', x)"), (1, "concat('- ', x)"), (2, "concat('  ', x)"), (3, "concat('> ', x)"), (4, "''"), (5, "'> q'"),
    (6, "'```py'"), (7, "x"), (8, "'```'"), (9, "'$$'"), (10, "'x^2'"), (11, "'$$'"),
    (12, "concat('![a](images/', cast(doc_id % 5 as varchar(20)), '.jpg)')"), (13, "concat('![b](images/', cast(doc_id % 5 as varchar(20)), '.jpg)')"),
    (14, "'| a | b |'"), (15, "'|---|---|'"), (16, "concat('| ', cast(i as varchar(20)), ' | 2 |')"), (17, "'---'"), (18, "''"),
    (19, "concat('$$y_', cast(i as varchar(20)), '$$')"),
    (20, "concat('<table><tr><td colspan=\"2\">', cast(i as varchar(20)), '</td></tr>')"), (21, "'<tr><td>p</td><td>q|r</td></tr></table>'"),
    (22, "concat(x, '  see $[3, 4]$  and $^{[2]}$ ')"), (23, "concat('### 2.', cast(1 + i % 7 as varchar(20)), ' Part ', cast(i % 3 as varchar(20)))"),
    (26, "'~~~text'"), (27, "x"), (28, "'~~~'"), (29, "concat('<table><tr><td colspan=\"2\">', cast(i as varchar(20)), '</td></tr></table>')"),
)
LINE_SQL = f"CASE (doc_id * 5 + i) % {CASES} " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in DECORATED) + " ELSE x END"

#: DuckDB: lines(doc_id, i, line), the decorated lines from 0.
LINES_SQL = f"""
 raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
 lines AS (SELECT doc_id, i, {LINE_SQL.replace("varchar(20)", "VARCHAR")} AS line FROM raw)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").filter("text is not null")


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    docs = _texts(spark, sf_dir)
    split = docs.select("doc_id", F.split("text", "\n", -1).alias("parts"))
    line = LINE_SQL.replace("varchar(20)", "string")
    return split.select("doc_id", F.expr(f"array_join(transform(parts, (x, i) -> {line}), '\n')").alias("text"))


def layout_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, layout_json: layout records of headings with levels and section numbers, which vary with doc_id."""
    docs = _texts(spark, sf_dir)
    return docs.select("doc_id", F.expr(_spark_layout()).alias("layout_json"))


#: (section number, words, level as JSON) of each record; levels vary with doc_id.
RECORDS = (
    ("", "Title ", "1"), ("", "Abstract", "2"), ("1. ", "Introduction", "2"), ("1.1 ", "Scope", "2"), ("1.1.2 ", "Limits", "\"2\""),
    ("II. ", "Methods", "2"), ("A. ", "First", "3"), ("B. ", "Second", "0"), ("C. ", "Third", "2"), ("V. ", "Results", "2"),
    ("", "Deep part.", "4"), ("", "plain body", "0"), ("1. ", "Introduction", "5"),
    ("2.1 ", "Part 0", "2"), ("2.3 ", "Part 2", "2"), ("2.5 ", "Part 1", "1"),
)


def _record(number: str, words: str, level: str, k: int) -> str:
    """SQL for one record: which documents number their sections, and which have it at all, varies."""
    text = f"concat(CASE WHEN doc_id % 3 <> 0 THEN '{number}' ELSE '' END, '{words}', CASE WHEN doc_id % 7 = {k % 7} THEN '.' ELSE '' END)"
    level_ = f"CASE WHEN doc_id % 11 = {k % 11} THEN '3' ELSE '{level}' END"
    kind = f"CASE WHEN doc_id % 5 = {k % 5} THEN 'title' ELSE 'text' END"
    return f"concat('{{\"type\":\"', {kind}, '\",\"text\":\"', {text}, '\",\"text_level\":', {level_}, ',\"page_idx\":', cast(doc_id % 4 as varchar(20)), ',\"bbox\":[1,\"2.5\",\"x\",{k}]}}')"


LAYOUT_SQL = "concat(CASE WHEN doc_id % 2 = 0 THEN '[' ELSE '{\"content_list\":[' END, concat_ws(',', " + ", ".join(
    f"CASE WHEN (doc_id + {k}) % 4 <> 0 THEN {_record(*r, k)} END" for k, r in enumerate(RECORDS)
) + "), CASE WHEN doc_id % 2 = 0 THEN ']' ELSE ']}' END)"


def _spark_layout() -> str:
    return LAYOUT_SQL.replace("varchar(20)", "string")


#: DuckDB: layout(doc_id, layout_json).
LAYOUT_TABLE_SQL = f" layout AS (SELECT doc_id, {LAYOUT_SQL.replace('varchar(20)', 'VARCHAR')} AS layout_json FROM documents WHERE text IS NOT NULL)"
