"""HTML tables to pipe tables.

Occupied cells of row and column spans make the expansion sequential, so one table is read in
Python, in Arrow batches; everything before and after stays in the JVM.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import effective_text

#: A table whose spans ask for more cells than a task can hold stays as it is.
MOST_CELLS = 5_000_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    """Elements as [name, attributes, children], nested as they are closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _all(node: list, names: tuple[str, ...]) -> list[list]:
    """Elements of these names below a node, in document order."""
    out, todo = [], list(reversed(node[2]))
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            if x[0] in names:
                out.append(x)
            todo += reversed(x[2])
    return out


def _text(node: list) -> str:
    out, todo = [], list(reversed(node[2]))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.strip())
        else:
            todo += reversed(x[2])
    return " ".join(t for t in out if t).replace("|", "\\|").replace("\n", "<br>")


def _span(node: list, name: str) -> int:
    return max(int(node[1].get(name) or 1), 1)


def table_rows(html: str | None) -> list[list[str]] | None:
    """The first table as rows of equal length, spans filled with copies; None without a table or rows."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tables = _all(tree.root, ("table",))
    rows = _all(tables[0], ("tr",)) if tables else []
    if not rows:
        return None
    cells: dict[tuple[int, int], str] = {}
    width = 0
    for r, row in enumerate(rows):
        c = 0
        for cell in _all(row, ("td", "th")):
            while (r, c) in cells:
                c += 1
            try:
                down, across = _span(cell, "rowspan"), _span(cell, "colspan")
            except ValueError:
                down = across = 1
            down = min(down, len(rows) - r)
            if len(cells) + down * across > MOST_CELLS or (c + across) * len(rows) > MOST_CELLS:
                return None
            text = _text(cell)
            cells.update({(r + i, c + j): text for i in range(down) for j in range(across)})
            c += across
            width = max(width, c)
    return [[cells.get((r, c), "") for c in range(width)] for r in range(len(rows))]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def html_table_rows(html: pd.Series) -> pd.Series:
    return html.map(lambda x: table_rows(x) if x else None)


def rows_to_markdown(rows: Column) -> Column:
    """A pipe table with the first row as its head; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(padded, F.lit(0))), rule), F.transform(F.slice(padded, F.lit(2), F.size(padded)), line)), "\n")).otherwise("")


def convert_tables(blocks: DataFrame) -> DataFrame:
    """HTML table blocks become pipe tables; what holds no table stays."""
    html = (F.col("type") == "table") & F.coalesce(F.col("kind") == "html", F.lit(False))
    text = F.when(html, effective_text(F.col("normalized_text"), F.col("source_text")))
    rows = blocks.withColumn("__html", html).withColumn("__rows", html_table_rows(text))
    done = F.col("__html") & F.col("__rows").isNotNull() & (F.size("__rows") > 0)
    out = rows.withColumn("__done", F.coalesce(done, F.lit(False))).withColumn("normalized_text", F.when(F.col("__done"), rows_to_markdown(F.col("__rows"))).otherwise(F.col("normalized_text")))
    out = out.withColumn("kind", F.when(F.col("__done"), "md").otherwise(F.col("kind"))).withColumn("converted", F.col("converted") | F.col("__done"))
    return out.select(*blocks.columns)
