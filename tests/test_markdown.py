import random
import re
import time

import pytest
from docloom.operators import chunking, cleanup, layout, markdown, tables
from docloom.plans import pipeline
from pyspark.sql import functions as F


def blocks_of(spark, *texts, compat=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in markdown.parse_markdown(df, compat=compat).orderBy("doc_id", "block_no").collect():
        out[r.doc_id].append((r.type, r.source_text))
    return out if len(texts) > 1 else out[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("# T\n\npara one\npara two\n\n- a\n- b\n  c\n\n> q\n\n> r", [("heading", "# T"), ("paragraph", "para one\npara two"), ("list", "- a\n- b\n  c"), ("blockquote", "> q\n\n> r")]),
        ("```py\nx\n\n# y\n```\nz", [("code", "```py\nx\n\n# y\n```"), ("paragraph", "z")]),
        ("````\n```\n````", [("code", "````\n```\n````")]),
        ("```x y\na", [("paragraph", "```x y\na")]),
        ("~~~\nopen\n\n", [("code", "~~~\nopen\n\n")]),
        ("$$\na\n$$\n$$b$$", [("math", "$$\na\n$$"), ("math", "$$b$$")]),
        ("a\n$$b$$\nc", [("paragraph", "a\n$$b$$\nc")]),
        ("---\n***\n_ _", [("thematic_break", "---"), ("thematic_break", "***"), ("paragraph", "_ _")]),
        ("![a](b)\ntext\n![c](d)", [("image", "![a](b)"), ("paragraph", "text\n![c](d)")]),
        ("| a |\n|---|\n| b |\nx", [("table", "| a |\n|---|\n| b |"), ("paragraph", "x")]),
        ("| a |\nb", [("paragraph", "| a |\nb")]),
        ("<table><tr><td>x</td></tr></table>\nafter", [("table", "<table><tr><td>x</td></tr></table>"), ("paragraph", "after")]),
        ("<TABLE>\n\n</table >\nafter", [("table", "<TABLE>\n\n</table >"), ("paragraph", "after")]),
        (" # no heading\n#no\n####### seven", [("paragraph", " # no heading\n#no\n####### seven")]),
        ("a\r\nb\rc", [("paragraph", "a\nb\nc")]),
        ("1) x\n2. y\n\t z\nend", [("list", "1) x\n2. y\n\t z"), ("paragraph", "end")]),
        ("", []), ("\n \n\t", []),
    ],
)
def test_parse(spark, given, want):
    assert blocks_of(spark, given) == want


def test_one_line_table_compat(spark):
    assert blocks_of(spark, "<table><tr><td>x</td></tr></table>\nafter", compat=True) == [("table", "<table><tr><td>x</td></tr></table>\nafter")]


def test_metadata(spark):
    df = spark.createDataFrame([(1, "##  Two words \n```py\n```\n<table></table>\n|a|\n|-|"), (2, None)], "doc_id long, text string")
    got = markdown.parse_markdown(df).orderBy("block_no").collect()
    assert [(r.block_id, r.type, r.level, r.title, r.lang, r.kind, r.normalized_text != "") for r in got] == [
        ("block-000001", "heading", 2, "Two words", None, None, False), ("block-000002", "code", None, None, "py", None, True),
        ("block-000003", "table", None, None, None, "html", False), ("block-000004", "table", None, None, None, "md", False),
    ]


def walk(text):
    """An independent reading of the rules, line by line."""
    lines, out, mode, fence = text.split("\n"), [], "", ""
    for i, x in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else None
        blank = not x.strip()
        special = bool(re.match(r"\s*(```+|~~~+)\s*\S*\s*$|\s*\$\$\s*$|#{1,6}\s+|\s*(\*{3,}|-{3,}|_{3,})\s*$|\s*<table\b|\s*([-*+]|\d+[.)])\s+|\s*>", x))
        item, quote = re.match(r"\s*([-*+]|\d+[.)])\s+", x) and not re.match(r"\s*(\*{3,}|-{3,}|_{3,})\s*$", x), re.match(r"\s*>", x)
        if mode and (
            mode in "fmhT" or mode == "t" and x.lstrip().startswith("|") or mode == "l" and not blank and (item or x[:1] in (" ", "\t"))
            or mode == "q" and (quote or blank and nxt is not None and re.match(r"\s*>", nxt)) or mode == "p" and not blank and not special
        ):
            out[-1][1].append(x)
            if mode == "f" and x.strip() == fence or mode == "m" and x.strip() == "$$" or mode == "h" and re.search(r"</table\s*>\s*$", x):
                mode = ""
            mode = "t" if mode == "T" else mode
            continue
        mode = ""
        if blank:
            continue
        if m := re.match(r"\s*(```+|~~~+)\s*\S*\s*$", x):
            kind, mode, fence = "code", "f", m[1]
        elif x.strip() == "$$":
            kind, mode = "math", "m"
        elif re.match(r"\s*\$\$.*\$\$\s*$", x):
            kind = "math"
        elif re.match(r"\s*<table\b", x):
            kind, mode = "table", "" if re.search(r"</table\s*>\s*$", x) else "h"
        elif re.match(r"#{1,6}\s+", x):
            kind = "heading"
        elif re.match(r"\s*(\*{3,}|-{3,}|_{3,})\s*$", x):
            kind = "thematic_break"
        elif re.match(r"\s*!\[[^\]]*\]\([^)]*\)\s*$", x):
            kind = "image"
        elif item:
            kind, mode = "list", "l"
        elif quote:
            kind, mode = "blockquote", "q"
        elif x.lstrip().startswith("|") and nxt is not None and "|" in nxt and re.match(r"\|?[\s:|-]+\|?\s*$", nxt.strip()):
            kind, mode = "table", "T"
        else:
            kind, mode = "paragraph", "p"
        out.append((kind, [x]))
    return [(k, "\n".join(v)) for k, v in out]


def test_random_lines(spark):
    rng = random.Random(3)
    pieces = ["", " ", "a", "  a", "# h", "- i", "1. i", "> q", ">", "```", "```py", "~~~", "$$", "$$x$$", "---", "![a](b)", "| a |", "|--|", "<table>", "</table>", "<table></table>", "x </table>", "\tt", "***", "+ "]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for text, got in zip(texts, blocks_of(spark, *texts), strict=True):
        assert got == walk(text), text


def test_long_document(spark):
    lines = [f"line {i}" if i % 3 else "" for i in range(30_000)]
    assert len(blocks_of(spark, "\n".join(lines))) == 10_000


HTML = '<p>x</p><table><tr><th colspan="2">A | B</th><th>C</th></tr><tr><td rowspan=2>1<br>\n2</td><td>x &amp; y</td></tr><tr><td>z</td><td colspan="x">w</td></tr></table><table><tr><td>second</td></tr></table>'


def test_tables(spark):
    assert tables.table_rows(HTML) == [["A \\| B", "A \\| B", "C"], ["1 2", "x & y", ""], ["1 2", "z", "w"]]
    for none in ("no table", "<table></table>", "", None, '<table><tr><td colspan="9999999999">x</td></tr></table>'):
        assert tables.table_rows(none) is None
    df = spark.createDataFrame([(1, HTML[len("<p>x</p>") :].replace("\n", " ")), (2, "<table>\nnothing\n</table>")], "doc_id long, text string")
    got = {r.doc_id: r for r in tables.convert_tables(markdown.parse_markdown(df)).filter("type = 'table'").collect()}
    assert got[1].normalized_text == "| A \\| B | A \\| B | C |\n| --- | --- | --- |\n| 1 2 | x & y |  |\n| 1 2 | z | w |"
    assert got[1].kind == "md" and got[1].converted and got[2].kind == "html" and not got[2].converted


def test_dedupe(spark):
    text = "![a](x)\n![a](x)\n![b](x)\n\npara  one\n\npara one\n\n![c](x)\n![d](y)\n\n---\n---"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.normalized_text for r in cleanup.clean(markdown.parse_markdown(df)).orderBy("block_no").collect()]
    assert got == ["![a](x)", "para one", "![c](x)", "![d](y)", "---"]


def levels_of(spark, *items):
    df = spark.createDataFrame([(1, i, t, lv, title) for i, (t, lv, title) in enumerate(items)], "doc_id long, item_no int, type string, text_level int, text string")
    found = {r.title: r.level for r in layout.heading_levels(df).collect()}
    return [found.get(re.sub(r"(\s*\.)+$", "", t.strip())) for _, _, t in items]


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([("text", 1, "Title"), ("text", 2, "1. Introduction"), ("text", 2, "1.1 Scope"), ("text", 2, "2. Methods")], [1, 2, 3, 2]),
        ([("text", 1, "Title"), ("text", 2, "Abstract"), ("text", 2, "1. One"), ("text", 2, "2. Two"), ("text", 2, "Summary")], [1, 2, 3, 3, 2]),
        ([("text", 2, "I. A"), ("text", 2, "II. B"), ("text", 2, "A. x"), ("text", 2, "B. y"), ("text", 2, "C. z"), ("text", 2, "V. w")], [2, 2, 3, 3, 3, 2]),
        ([("text", 4, "Deep"), ("text", 3, "1. n"), ("title", 0, "t"), ("h5", 0, "five"), ("text", 0, "body")], [4, 5, 1, 5, None]),
        ([("text", 2, "plain"), ("text", 3, "plain")], [2, 2]),
    ],
)
def test_heading_levels(spark, items, want):
    assert levels_of(spark, *items) == want


def test_layout_json(spark):
    bodies = ['[{"type":"text","text":"A","text_level":"2","bbox":[1,"2.5","x",null]},7,"s"]', '{"other":1,"data":[{"text":"B","text_level":2.0}]}', '{"content_list":{},"items":[{"type":"title","text":"C"}]}', "", "  ", "nope", "3", "null", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, layout_json string")
    got = layout.layout_items(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.type, r.text, r.text_level, r.bbox) for r in got] == [(0, "text", "A", 2, [1.0, 2.5]), (1, "", "B", 2, []), (2, "title", "C", 0, [])]


def test_restore_survives_normalising(spark):
    docs = spark.createDataFrame([(1, "# Title\n\n# 3.1 Overview.\n\ntext  $[2]$"), (2, "# Other")], "doc_id long, text string")
    layouts = spark.createDataFrame([(1, '[{"type":"text","text":"Title","text_level":1},{"type":"text","text":"3. M","text_level":2},{"type":"text","text":"3.1 Overview","text_level":2}]')], "doc_id long, layout_json string")
    got = pipeline.normalize(docs, layouts).orderBy("doc_id", "block_no").collect()
    assert [(r.normalized_text, r.restored) for r in got] == [("# Title", False), ("### 3.1 Overview.", True), ("text [2]", False), ("# Other", False)]


def test_chunks_and_translations(spark):
    long = "One is here. " * 40 + "Two！  Three?\nFour"
    docs = spark.createDataFrame([(1, f"## H\n\n{long}\n\n```\n{'x' * 900}\n```\n\n- {'y' * 900}\n\n$$z$$")], "doc_id long, text string")
    blocks = cleanup.fill_text(markdown.parse_markdown(docs)).cache()
    made = chunking.chunk_blocks(blocks, 500).orderBy("chunk_no").collect()
    assert [c.block_no for c in made] == [1, *[2] * 43, 4]
    assert "".join(c.source_text for c in made[1:-1]).replace(" ", "").replace("\n", "") == long.replace(" ", "").replace("\n", "")
    assert made[-1].warning and made[-1].source_text.startswith("- y") and made[0].chunk_id == "chunk-000001"
    said = spark.createDataFrame([(1, 1, 1, "# Kopf\n"), (1, 2, 1, "a\n\nb"), (1, 2, 2, " "), (1, 2, 3, "c\n"), (1, 4, 1, "##"), (1, 9, 1, None)], "doc_id long, block_no int, part_no int, translation string")
    got = [r.normalized_text for r in chunking.apply_translations(blocks, said).orderBy("block_no").collect()]
    assert got[:2] == ["## Kopf", "a\nb c"] and got[3].startswith("- y") and got[4] == "$$z$$"


def test_end_to_end(spark):
    docs = spark.createDataFrame([(1, "# A\n\none\n\n## B\n\ntwo\n\n$$m$$"), (2, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pipeline.translate(pipeline.normalize(docs), pipeline.mock_translator).collect()}
    assert out == {1: "# 译[# A]\n\n译[one]\n\n## 译[## B]\n\n译[two]\n\n$$m$$\n"}


def test_invariants(spark):
    """Each line that is not blank is in exactly one block; cleaning twice changes nothing more."""
    from docloom.plans.corpus import markdown_corpus

    docs = markdown_corpus(spark, "/root/testdata/sf0.001").cache()
    blocks = markdown.parse_markdown(docs)
    lines = lambda df, c: df.select(F.explode(F.split(c, "\n"))).filter("trim(col) <> ''").count()
    assert lines(docs, "text") == lines(blocks, "source_text")
    once = cleanup.clean(cleanup.fill_text(blocks))
    twice = cleanup.clean(once)
    assert once.count() == twice.count() and once.exceptAll(twice).isEmpty()


def test_time_grows_with_blocks(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "\n".join(f"# h{i}" if i % 3 else "```\nx\n```" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert markdown.parse_markdown(df).agg(F.max("block_no")).first()[0] == n
        return time.perf_counter() - began

    seconds(1000)
    few, many = seconds(50_000), seconds(200_000)
    assert many < 6 * few  # in proportion: 4 at most; with the square: 16


def test_constructs_go_on_over_runs(spark):
    """What is open at the end of a run of lines stays open."""
    for size in (126, 127, 128, 129, 300):
        text = "\n".join(["para"] * 5 + [""] * 3 + ["```py"] + ["# no heading"] * size + ["```", "", "> q"] + ["> r"] * size + ["- a"] * size + ["$$"] + ["x"] * size + ["$$"])
        rows = markdown.parse_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_no").collect()
        assert [(r.type, r.source_text.count("\n") + 1) for r in rows] == [("paragraph", 5), ("code", size + 2), ("blockquote", size + 1), ("list", size), ("math", size + 2)]
