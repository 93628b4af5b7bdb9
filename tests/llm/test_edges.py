"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from docloom.llm import chat, decontaminate, html_text, jaccard_join, line_dedup, packing, pii, quality, secrets, substring_dedup
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} and{i}" for i in range(40_000))
TEXTS = [None, "", " \n\t ", "one", "same text here", "same text here", LONG, LONG, "é" * 100, "\n" * 50, "a\nb\nc\nd\n" * 30, "x" * 5000, "<|endoftext|> \\ [INST]"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, k long, d string, token string, gone int, w string, rank int, raw string, __id int"


def docs(spark, rows=None):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (3, "one"), (4, "same text here")] if rows is None else rows
    wide = [(i, t, None, "s", None, None, None, None, "d", None, None, "w", None, None, None) for i, t in data]
    return spark.createDataFrame(wide, DOC)


def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(12)] + [(None, 1, 1), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


BENCH = [(1, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6"), (2, "same text here"), (3, None), (4, ""), (None, "one"), (5, "same text here")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


PAGES = [(1, "u", "<body><p>Hello there</p>"), (None, None, None), (2, "u", ""), (3, "u", "<" * 5000), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (1, "u", "<body><p>Hello there</p>"), (5, None, "plain & text"), (6, "u", "<p " + "a" * 50_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")


def turns(spark, rows=((1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "assistant", "n"), (3, 0, "user", ""), (1, 1, "assistant", "b"))):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d), "quality": lambda s, d: quality.assess(d, labels(s)), "keep_good": lambda s, d: quality.keep_good(d, labels(s)), "decontaminate": lambda s, d: decontaminate.find(d, bench(s)),
    "decontaminate_docs": lambda s, d: decontaminate.decontaminate(d, bench(s)), "decontaminate_spans": lambda s, d: decontaminate.decontaminate(d, bench(s), spans=True), "jaccard": lambda s, d: jaccard_join.join(d),
    "keep_first": lambda s, d: jaccard_join.keep_first(d), "pii": lambda s, d: pii.pseudonymise(d, b"k"), "lines": lambda s, d: line_dedup.marked(d), "drop_lines": lambda s, d: line_dedup.drop_repeated_lines(d),
    "pack": lambda s, d: packing.pack(d, packing.default_tokenizer(), keep_ids=True), "substrings": lambda s, d: substring_dedup.remove_repeats(d, with_text=True),
}
PER_ROW = ("secrets", "quality", "decontaminate", "decontaminate_spans", "jaccard", "pii", "lines", "substrings")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    given = docs(spark)
    got = OPERATORS[name](spark, given).collect()
    if name in PER_ROW:
        assert len(got) == given.count()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in given.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    given = docs(spark, [])
    assert OPERATORS[name](spark, given).count() == 0


def test_empty_side_tables(spark):
    given = docs(spark)
    none = bench(spark, [])
    assert decontaminate.find(given, none).filter("n_hit > 0").count() == 0 and decontaminate.decontaminate(given, none).count() == given.count()
    assert quality.assess(given, labels(spark).limit(0)).filter("kept = base_failed").count() == 0
    assert html_text.extract(pages(spark, [])).count() == 0 and chat.digest(chat.format_conversations(turns(spark, []))).count() == 0


def test_pages(spark):
    got = html_text.extract(pages(spark)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Hello there", 11), (1, "Hello there", 11), (2, "", 0), (3, got[3].text, got[3].n_chars), (4, "deep", 4), (5, "plain & text", 12), (6, got[-1].text, got[-1].n_chars)]


def test_conversations(spark):
    examples = chat.format_conversations(turns(spark))
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].loss_chars == 1 and got[3].n_turns == 1
    assert examples.filter("conv_id = 1").count() == 3


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages(spark, tmp_path, name, stage):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    given = docs(spark)
    got = stage(spark, given, str(tmp_path))
    assert got.columns == given.columns and [f.dataType for f in got.schema] == [f.dataType for f in given.schema]
    assert 0 < got.count() <= given.count()
    assert stage(spark, given.limit(0), str(tmp_path)).count() == 0


def test_results_of_odd_rows(spark):
    found = {(r.doc_id, r.n_words): r.n_hit for r in decontaminate.find(docs(spark), bench(spark)).collect()}
    assert found[4, 3] == found[5, 3] == 3 and found[3, 1] == 1 and found[None, 0] == 0
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark)).filter("doc_id is not null").collect()}
    assert groups[4] == (1, 4) and groups[5] == (1, 4) and groups[7][1] == 6 and groups[0] == (0, 0) and groups[1] == (0, 1)
    kept = [r.doc_id for r in jaccard_join.keep_first(docs(spark)).collect()]
    assert kept.count(3) == kept.count(4) == 1 and 5 not in kept and 7 not in kept and kept.count(None) == 2
    lines = {r.doc_id: (r["__lines"], r["__removed"]) for r in line_dedup.marked(docs(spark)).collect()}
    assert lines[10] == (121, 116) and lines[9] == (51, 0) and lines[0] == (0, 0)
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(spark)).collect()}
    assert cut[7].n_removed == cut[7].n_bytes and cut[7].n_spans == 1 and cut[6].n_removed == 0 and cut[8].n_removed == 0
    rows = packing.pack(docs(spark), packing.default_tokenizer(), keep_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 0) == 1 and all(len(r.ids) == r.length for r in rows)
    assert docs(spark).select(F.count("*")).first()[0] == len({(r.doc_id, r.sequence_id, r.offset) for r in rows if r.piece == 0})
