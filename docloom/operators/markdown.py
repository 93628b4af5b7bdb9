"""Markdown texts to typed, ordered blocks, and back.

Segmentation is one fold per document over its lines. Each line is classified once; the fold's state
is the open construct and the places where blocks start and end, so that no line is copied. A fold copies its state at every step: so one
without places finds what is open at the start of each run of RUN lines, and one in each run gathers its places. Blocks are then cut from
the line array. No shuffle, no Python.

blocks: key columns, block_no, block_id, type, source_text, normalized_text ('' if unset), level, title,
lang, kind, restored, converted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import WS, bound, effective_text, strip

TYPES = ("heading", "paragraph", "list", "table", "blockquote", "code", "math", "image", "thematic_break", "raw")
#: Lines whose places are gathered in one fold.
RUN = 128
KEPT_AS_IS = ("code", "math", "image", "thematic_break")

# How lines are told apart, in the order in which they are tried.
FIRST = rf"(?U)\A{WS}*([^\s\x1c-\x1f])"
FENCE = rf"(?U)\A{WS}*(```+|~~~+){WS}*([^\s\x1c-\x1f]*){WS}*\z"
MATH_MARK = rf"(?U)\A{WS}*\$\${WS}*\z"
MATH_LINE = rf"(?Us)\A{WS}*\$\$.*\$\${WS}*\z"
TABLE_START = rf"(?Ui)\A{WS}*<table\b"
TABLE_END = rf"(?Ui)</table{WS}*>{WS}*\z"
HEADING = rf"(?Us)\A(#{{1,6}}){WS}+(.*)\z"
RULE = rf"(?U)\A{WS}*(?:\*{{3,}}|-{{3,}}|_{{3,}}){WS}*\z"
IMAGE_LINE = rf"(?U)\A{WS}*!\[[^\]]*\]\([^)]*\){WS}*\z"
LIST_ITEM = rf"(?U)\A{WS}*(?:[-*+]|\d+[.)]){WS}+"
SEPARATOR = r"(?U)\A\|?[\s\x1c-\x1f:|-]+\|?[\s\x1c-\x1f]*\z"

#: What a paragraph ends at.
STOPS = ("fence", "math", "html", "heading", "rule", "list", "quote")
TYPE_OF = {"fence": "code", "math": "math", "mathline": "math", "html": "table", "heading": "heading", "rule": "thematic_break", "image": "image", "list": "list", "quote": "blockquote", "pipe": "table", "text": "paragraph"}


def _classes(lines: Column) -> Column:
    """struct<k, q, f, e, t, s> of each line: class, next line is a quote, fence, ends a table, starts with a pipe or blank space, stripped.

    The first character that isn't white space says which patterns are worth trying.
    """
    headed = F.transform(lines, lambda line: F.struct(line.alias("l"), F.regexp_extract(line, FIRST, 1).alias("c")))

    def of(heads: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            line, first, following = x["l"], x["c"], F.get(heads, i + 1)
            separator = strip(following["l"])
            like = lambda pattern, *chars: first.isin(*chars) & line.rlike(pattern)
            kind = (
                F.when(first == "", "blank").when(like(FENCE, "`", "~"), "fence").when(like(MATH_MARK, "$"), "math").when(like(MATH_LINE, "$"), "mathline")
                .when(like(TABLE_START, "<"), "html").when(like(HEADING, "#"), "heading").when(like(RULE, "*", "-", "_"), "rule").when(like(IMAGE_LINE, "!"), "image")
                .when((first.isin("-", "*", "+") | first.rlike(r"(?U)\d")) & line.rlike(LIST_ITEM), "list").when(first == ">", "quote")
                .when((first == "|") & F.coalesce(separator.rlike(SEPARATOR) & F.contains(separator, F.lit("|")), F.lit(False)), "pipe").otherwise("text")
            )
            return F.struct(
                kind.alias("k"), F.coalesce(following["c"] == ">", F.lit(False)).alias("q"),
                F.when(F.contains(line, F.lit("```")) | F.contains(line, F.lit("~~~")), strip(line)).otherwise("").alias("f"),
                (F.contains(line, F.lit("</")) & line.rlike(TABLE_END)).alias("e"), (first == "|").alias("t"), line.rlike(r"\A[ \t]").alias("s"),
            )

        return F.transform(heads, one)

    return bound(headed, of)


def _marks(lines: Column, compat: bool) -> Column:
    """array<struct<i, k>>: where blocks start (k: class) and where lines outside blocks start (k empty)."""
    none = F.lit("")
    mark = lambda at, k: F.struct(at.cast("int").alias("i"), k.alias("k"))

    def step(a: Column, x: Column, placed: bool) -> Column:
        """The construct that is open after a line, with its fence; placed: and the places so far, and the next line's."""
        mode, kind = a["mode"], x["k"]
        inside = (
            mode.isin("fence", "math", "html", "pipe1")
            | (mode == "pipe") & x["t"]
            | (mode == "list") & (kind != "blank") & ((kind == "list") | x["s"])
            | (mode == "quote") & ((kind == "quote") | (kind == "blank") & x["q"])
            | (mode == "text") & (kind != "blank") & ~kind.isin(*STOPS)
        )
        closes = (mode == "fence") & (x["f"] == a["fence"]) | (mode == "math") & (kind == "math") | (mode == "html") & x["e"]
        opened = F.when(kind == "pipe", "pipe1").when(kind == "html", F.when(F.lit(compat) | ~x["e"], "html").otherwise("")).when(kind.isin("fence", "math", "list", "quote", "text"), kind).otherwise("")

        def after(mode: Column, *marks: Column, fence: Column = a["fence"]) -> Column:
            own = [F.concat(a["marks"], F.array(*marks)).alias("marks") if marks else a["marks"].alias("marks"), (a["i"] + 1).alias("i")] if placed else []
            return F.struct(mode.alias("mode"), fence.alias("fence"), *own)

        at = a["i"] if placed else F.lit(0)
        return (
            F.when(inside, F.when(closes, after(none, mark(at + 1, none))).otherwise(after(F.when(mode == "pipe1", "pipe").otherwise(mode))))
            .when(kind == "blank", F.when(mode == "", after(none)).otherwise(after(none, mark(at, none))))
            .when(opened == "", after(none, mark(at, kind), mark(at + 1, none)))
            .otherwise(after(opened, mark(at, kind), fence=F.when(kind == "fence", F.regexp_extract(x["f"], FENCE, 1)).otherwise(a["fence"])))
        )

    def places(runs: Column, states: Column) -> Column:
        def of_run(run: Column, j: Column) -> Column:
            state = F.get(states, j)
            start = F.struct(state["mode"].alias("mode"), state["fence"].alias("fence"), F.array().cast("array<struct<i:int,k:string>>").alias("marks"), (j * RUN).alias("i"))
            return F.aggregate(run, start, lambda a, x: step(a, x, True), lambda a: a["marks"])

        return F.flatten(F.transform(runs, of_run))

    def folded(runs: Column) -> Column:
        begin = F.array(F.struct(none.alias("mode"), none.alias("fence")))
        states = F.aggregate(F.slice(runs, 1, F.size(runs) - 1), begin, lambda a, run: F.array_append(a, F.aggregate(run, F.element_at(a, -1), lambda b, x: step(b, x, False))))
        return bound(states, lambda s: places(runs, s))

    split = lambda classes: F.transform(F.sequence(F.lit(1), F.size(classes), F.lit(RUN)), lambda at: F.slice(classes, at, RUN))
    return bound(_classes(lines), lambda classes: bound(split(classes), folded))


def parse_markdown(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), compat: bool = False) -> DataFrame:
    """The blocks of each document.

    An HTML table that ends on the line it starts on is closed there; with compat it goes on
    to the next line that ends one, or to the end. A null text has no blocks.
    """
    plain = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = docs.filter(F.col(text).isNotNull()).select(*keys, F.split(plain, "\n", -1).alias("lines"))
    marked = lines.select(*keys, "lines", _marks(F.col("lines"), compat).alias("marks"))
    spans = F.filter(
        F.transform("marks", lambda m, j: F.struct(m["k"].alias("k"), m["i"].alias("i"), F.coalesce(F.get("marks", j + 1)["i"], F.size("lines")).alias("end"))),
        lambda s: s["k"] != "",
    )
    cut = F.transform(spans, lambda s: F.struct(s["k"].alias("k"), F.array_join(F.slice("lines", s["i"] + 1, F.greatest(s["end"] - s["i"], F.lit(0))), "\n").alias("text"), F.get("lines", s["i"]).alias("first")))
    rows = marked.select(*keys, F.posexplode(cut).alias("at", "b"))
    kind, source, first = F.col("b.k"), F.col("b.text"), F.col("b.first")
    type_ = F.coalesce(*(F.when(kind == k, t) for k, t in TYPE_OF.items()))
    heading = kind == "heading"
    return rows.select(
        *keys, (F.col("at") + 1).alias("block_no"), F.format_string("block-%06d", F.col("at") + 1).alias("block_id"), type_.alias("type"), source.alias("source_text"),
        F.when(type_.isin(*KEPT_AS_IS), source).otherwise("").alias("normalized_text"),
        F.when(heading, F.length(F.regexp_extract(first, HEADING, 1))).cast("int").alias("level"),
        F.when(heading, strip(F.regexp_extract(first, HEADING, 2))).alias("title"),
        F.when(kind == "fence", F.regexp_extract(first, FENCE, 2)).alias("lang"),
        F.when(kind == "html", "html").when(kind == "pipe", "md").alias("kind"),
        F.lit(False).alias("restored"), F.lit(False).alias("converted"),
    )


def is_translatable(type_: Column) -> Column:
    return ~type_.isin(*KEPT_AS_IS)


def serialize_markdown(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), separator: str = "\n\n") -> DataFrame:
    """keys and text: the blocks' texts in order, without empty ones, with one newline at the end."""
    own = effective_text(F.col("normalized_text"), F.col("source_text"))
    text = F.regexp_replace(own, r"\n+\z", "")
    held = blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(own != "", F.struct("block_no", text.alias("t"))))), lambda x: x["t"]).alias("parts"))
    joined = F.array_join("parts", separator)
    return held.select(*keys, F.when((joined != "") & ~joined.endswith("\n"), F.concat(joined, F.lit("\n"))).otherwise(joined).alias("text"))


def document_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("block_no")
