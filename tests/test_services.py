import io
import json
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest
from __spark_entry__ import oracle_sql, queries
from docloom import cli
from docloom.cli import main
from docloom.functions.retry import Patience
from docloom.operators import images, state
from docloom.plans import jobs
from docloom.sources import archives, config, files
from docloom.sources.services import ChatTranslator, DocumentParser, Http, ImageHost, MockTranslator, Replay, Reply, ServiceError, poll_state, translate_chunks, upload_images
from docloom.streaming.resume import job_events, read_results, stream_translations
from pyspark.sql import functions as F


def reply(body, status=200):
    return Reply(status, json.dumps(body).encode())


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return out.getvalue()


def test_archives(spark):
    good = archive(images__a_DOT_jpg=b"A", notes_DOT_MD=b"# T\xff", x_content_list_DOT_json=b"[]", second_DOT_md="no", images__b_DOT_jpg=b"B")
    df = spark.createDataFrame([("g", good), ("bad", b"no zip"), ("none", archive(a_DOT_txt="x")), ("null", None)], "path string, content binary")
    docs, assets = archives.extract(archives.archive_members(df))
    got = {r.path: r for r in docs.collect()}
    assert (got["g"].markdown, got["g"].layout_json, got["g"].error) == ("# T", "[]", None)
    assert got["bad"].error.startswith("no valid archive") and got["none"].error and got["null"].error
    assert sorted((r.path, r.name) for r in assets.collect()) == [("g", "images/a.jpg"), ("g", "images/b.jpg"), ("g", "second.md"), ("none", "a.txt")]


def test_parser_states():
    assert poll_state({"data": {"extract_result": [{"state": "done", "full_zip_url": "u"}]}}) == ("done", "u")
    assert poll_state({"data": {"extract_result": [{"state": "running"}]}})[0] == "waiting"
    for failed in ({}, {"data": {"extract_result": []}}, {"data": {"extract_result": [{"state": "done"}]}}, {"data": {"extract_result": [{"state": "failed", "err_msg": "e"}]}}):
        assert poll_state(failed)[0] == "failed"


def test_parser_client():
    status = "B/extract-results/batch/7"
    replies = {
        ("POST", "B/file-urls/batch"): [reply({"code": 0, "data": {"batch_id": "7", "file_urls": ["up"]}})], ("PUT", "up"): [Reply(200)],
        ("GET", status): [reply({"data": {"extract_result": [{"state": "running"}]}}), reply({"data": {"extract_result": [{"state": "done", "full_zip_url": "zip"}]}})], ("GET", "zip"): [Reply(200, b"Z")],
    }
    waits = []
    assert DocumentParser(Replay(dict(replies)), "B", sleep=waits.append).parse("a.pdf", b"x") == b"Z" and waits == [3.0]
    late = iter(range(0, 99999, 5000))
    slow = {**replies, ("GET", status): [reply({"data": {"extract_result": [{"state": "running"}]}})]}
    with pytest.raises(ServiceError, match="timed out"):
        DocumentParser(Replay(slow), "B", sleep=lambda s: None, clock=lambda: next(late)).parse("a.pdf", b"x")
    for bad in ({("POST", "B/file-urls/batch"): [reply({"code": 5})]}, {}, {**replies, ("PUT", "up"): [Reply(500)]}, {**replies, ("GET", "zip"): [Reply(404)]}):
        with pytest.raises(ServiceError):
            DocumentParser(Replay(dict(bad)), "B", sleep=waits.append).parse("a", b"")


class Server(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/here?x=1")
            self.end_headers()
            return
        if self.path == "/slow":
            time.sleep(1.5)
        self.answer(200, self.path.encode())

    def do_POST(self):
        self.answer(201, self.headers["X-Own"].encode() + self.rfile.read(int(self.headers["Content-Length"])))

    def answer(self, status, body):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, link = f"http://127.0.0.1:{server.server_port}", Http(read=0.5)
    assert link.call("GET", f"{base}/moved") == Reply(200, b"/here?x=1")
    assert link.call("POST", base, {"X-Own": "h"}, "é".encode()) == Reply(201, "hé".encode())
    with pytest.raises(OSError):
        link.call("GET", f"{base}/slow")
    server.shutdown()
    with pytest.raises(ServiceError):
        link.call("GET", "ftp://x/y")


def chat(*replies, retries=2):
    waits = []
    return ChatTranslator(Replay({("POST", "B/chat/completions"): list(replies)}), "B", "k", "m", patience=Patience(more=retries, stretch=0), sleep=waits.append), waits


def said(text):
    return reply({"choices": [{"message": {"content": text}}]})


def test_translator_retries():
    t, waits = chat(reply({"error": {"code": "1302"}}, 429), reply({"error": {"code": 1305}}), said("<think>x</think> ok"))
    assert t.translate("a", "zh") == "ok" and waits == [10.0, 60.0]
    t, _ = chat(said(""))
    assert t.translate("a", "zh") == "" and t.translate("  ", "zh") == "  "
    t, waits = chat(reply({}, 401))
    with pytest.raises(ServiceError):
        t.translate("a", "zh")
    assert waits == []
    t, _ = chat(reply({"msg": 1}, 503))
    with pytest.raises(ServiceError, match="3 attempts"):
        t.translate("a", "zh")


def test_image_host(spark):
    host = lambda *r: ImageHost(Replay({("POST", "H/upload/batch"): list(r)}), "H", sleep=waits.append)
    waits = []
    ok = reply({"success": True, "files": [{"src": "/x"}, {"src": "https://y"}, {"src": ""}]})
    assert host(reply({"code": "RATE_LIMIT", "retryAfterSeconds": 99}, 429), ok).upload("f", [], "r") == ["H/x", "https://y", ""] and waits == [60.0]
    for bad in (reply({"success": False}), reply({"code": "X"}, 400)):
        with pytest.raises(ServiceError):
            host(bad).upload("f", [], "r")
    df = spark.createDataFrame([(1, "b.png", 5, b"1"), (1, "a.jpg", 5, b"2")], "doc_id long, name string, size int, content binary")
    records = images.upload_records(df).join(images.upload_batches(df), "name").withColumn("folder", F.lit("f")).withColumn("request_id", F.lit("r"))
    got = upload_images(records, lambda: ImageHost(Replay({("POST", "H/upload/batch"): [ok]}), "H")).collect()
    assert sorted((r.name, r.url) for r in got) == [("a.jpg", "H/x"), ("b.png", "https://y")]


def test_upload_limits(spark):
    df = spark.createDataFrame([(1, f"{i:02d}", s) for i, s in enumerate([5, 5, 5, 50, 1, 1])] + [(2, "x", None)], "doc_id long, name string, size int")
    got = {(r.doc_id, r.name): r.batch for r in images.upload_batches(df, most_files=2, most_bytes=20).collect()}
    assert [got[1, f"{i:02d}"] for i in range(6)] == [0, 0, 1, 2, 3, 3] and got[2, "x"] == 0


def test_uploads_in_order_of_a_key(spark, tmp_path):
    """Keys past a million, whose names of seven digits sort before those of six."""
    keys = [*range(100_010, 100_200, 10), *range(1_000_000, 1_000_200, 10)]
    spark.createDataFrame([(k, 1 + k // 10 % 49) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries()["upload_batches"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == sorted(con.execute(oracle_sql()["upload_batches"]).fetchall())


def test_assets(spark):
    docs = spark.createDataFrame([(1, "![a](./images/a.jpg?x)\n<img src='b.png'>"), (2, "no refs")], "doc_id long, text string")
    assets = spark.createDataFrame([(d, n) for d in (1, 2) for n in ("images\\a.jpg", "other/b.png", "images/c.jpg", "IMAGES/d.jpg")], "doc_id long, name string")
    got = sorted((r.doc_id, r.name) for r in images.filter_assets(assets, docs).collect())
    assert got == [(1, "images\\a.jpg"), (1, "other/b.png"), (2, "IMAGES/d.jpg"), (2, "images/c.jpg")]


def test_state(spark):
    chunks = spark.createDataFrame([(1, "c1", "h1"), (1, "c2", "h2"), (2, "c1", "h1"), (2, "c2", "h3")], "doc_id long, chunk_id string, source_hash string")
    results = spark.createDataFrame([("h1", "m", "zh", "old", "done", 1), ("h1", "m", "zh", "new", "done", 2), ("h2", "x", "zh", "t", "done", 1), ("h3", "m", "zh", "t", "failed", 1)], "source_hash string, model string, target_lang string, translation string, status string, stored_at long")
    assert sorted((r.doc_id, r.chunk_id) for r in state.pending(chunks, results, "m", "zh").collect()) == [(1, "c2"), (2, "c2")]
    assert {r.translation for r in state.with_results(chunks, results, "m", "zh").filter("source_hash = 'h1'").collect()} == {"new"}
    got = {r.doc_id: (r.done, r.status) for r in state.progress(chunks, chunks.filter("doc_id = 1 or chunk_id = 'c1'")).collect()}
    assert got == {1: (2, "completed"), 2: (1, "running")}
    states = spark.createDataFrame([("a", "/w/x"), ("a", "/w/x/y"), ("b", "/z")], "source_path string, work_dir string")
    assert [tuple(r) for r in state.locate(states, spark.createDataFrame([("a",)], "source_path string")).collect()] == [("a", "/w/x/y")]
    known = spark.createDataFrame([("a", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", "0")], "source_path string, source_hash string")
    sources = spark.createDataFrame([("a", b"x"), ("b", b"x")], "source_path string, content binary")
    assert [r.source_path for r in state.verified(known, sources).collect()] == ["a"]


def test_translate_chunks_and_stream(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "h1", "alpha"), (2, "h2", ""), (3, "h1", "alpha")], "doc_id long, source_hash string, source_text string")
    got = {r.doc_id: r.translation for r in translate_chunks(chunks, MockTranslator, "zh").collect()}
    assert got == {1: "译[alpha]", 2: "", 3: "译[alpha]"}
    source, results = str(tmp_path / "chunks"), str(tmp_path / "results")
    chunks.select("source_hash", "source_text").coalesce(1).write.parquet(source)

    def run():
        stream_translations(spark, source, "source_hash string, source_text string", results, str(tmp_path / "check"), lambda df: translate_chunks(df, MockTranslator, "zh"), "m", "zh").awaitTermination()
        return sorted((r.source_hash, r.translation) for r in read_results(spark, results).collect())

    assert run() == [("h1", "译[alpha]"), ("h2", "")]
    spark.createDataFrame([("h1", "alpha"), ("h3", "beta")], "source_hash string, source_text string").coalesce(1).write.mode("append").parquet(source)
    assert run() == [("h1", "译[alpha]"), ("h2", ""), ("h3", "译[beta]")]


def test_event_counts(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("select timestamp'2024-01-01 00:00:10' + make_interval(0, 0, 0, 0, 0, 0, id * 20) as at, 'j' as job_id, if(id % 2 = 0, 'A', 'B') as type from range(6)").write.parquet(path)
    stream = spark.readStream.schema("at timestamp, job_id string, type string").parquet(path)
    q = job_events(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.type, r.n) for r in spark.sql("select type, n from counts").collect()) == [("A", 1), ("A", 2), ("B", 1), ("B", 2)]


def test_config(tmp_path, monkeypatch):
    (tmp_path / "user").mkdir()
    (tmp_path / "user/user.toml").write_text('[translation]\nmax_retries = "x"\nbackoff_base = "3"\n[image_host]\nenabled = "yes"\n[chunking]\nhard_limit = 7\n[parser]\ntoken = "never"')
    monkeypatch.setenv("DOCLOOM_CONFIG_DIR", str(tmp_path))
    monkeypatch.setenv("DOCLOOM_TRANSLATOR_KEY", "abcdefghijkl")
    c = config.load()
    assert (c.translation.max_retries, c.translation.backoff_base, c.image_host.enabled, c.chunking.hard_limit, c.parser.token) == (2, 3.0, True, 7, "")
    assert c.translator.configured and not c.parser.configured and config.masked("abcdefghijkl") == "abcd****ijkl"
    monkeypatch.setenv("DOCLOOM_CONFIG_DIR", str(tmp_path / "none"))
    assert config.load(tmp_path).chunking.hard_limit == 6500


def test_files_and_cli(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("DOCLOOM_CONFIG_DIR", str(tmp_path / "settings"))
    (tmp_path / "settings").mkdir()
    (tmp_path / "settings/user.toml").write_text("[translation]\nrequest_interval = 0")
    (tmp_path / "a.b.md").write_text("# T\n\nbody")
    docs = files.read_markdown(spark, str(tmp_path / "a.b.md"))
    assert [(r.stem, r.text) for r in docs.collect()] == [("a.b", "# T\n\nbody")]
    first = spark.createDataFrame([(docs.first().source_path, "[1]")], "source_path string, layout_json string")
    assert files.with_layout(docs, first.limit(0), first).first().layout_json == "[1]" and files.with_layout(docs, first.limit(0)).first().layout_json == ""
    work, path = str(tmp_path / "work"), str(tmp_path / "a.b.md")
    options = ["--translator", "mock", "--work-dir", work]
    assert main([*options, "resume", path], spark) == 1  # nothing to resume
    assert main([*options, "translate", path], spark) == 0
    assert (tmp_path / "a.b.zh.md").read_text() == "# 译[# T]\n\n译[body]\n"
    before = spark.read.parquet(f"{work}/results").count()
    assert main([*options, "resume", path], spark) == 0 and spark.read.parquet(f"{work}/results").count() == before
    (tmp_path / "a.b.md").write_text("# T\n\nother")
    assert main([*options, "resume", path], spark) == 1  # the source has changed
    assert main([*options, "normalize", path], spark) == 0 and spark.read.parquet(f"{work}/blocks").count() == 2
    assert main([*options, "run", str(tmp_path / "no.pdf")], spark) == 2 and main(["--translator", "x", "translate", path], spark) == 3
    monkeypatch.delenv("DOCLOOM_PARSER_TOKEN", raising=False)
    assert main([*options, "run", path], spark) == 3
    assert main(["config", "check"]) == 0


def test_run_from_source_files_to_translations(spark, tmp_path, monkeypatch, capsys):
    """Two files through a recorded parser, translator and image host."""
    layout = [{"type": "title", "text": "1 Intro", "text_level": 1}, {"type": "title", "text": "1.1 Part", "text_level": 1}]
    text = "# 1 Intro\n\nsome words\n\n# 1.1 Part\n\n![a](images/a.jpg)\n\n![r](https://x/y.jpg)\n\n<table><tr><td>p</td></tr></table>"
    made = archive(full_DOT_md=text, x_content_list_DOT_json=json.dumps(layout), images__a_DOT_jpg=b"A", images__unused_DOT_jpg=b"U", images__x_DOT_DOT_y=b"n")
    base = "B/extract-results/batch/7"
    parsing = {("POST", "B/file-urls/batch"): [reply({"code": 0, "data": {"batch_id": "7", "file_urls": ["up"]}})], ("PUT", "up"): [Reply(200)], ("GET", base): [reply({"data": {"extract_result": [{"state": "done", "full_zip_url": "zip"}]}})], ("GET", "zip"): [Reply(200, made)]}
    uploads = {("POST", "H/upload/batch"): [reply({"success": True, "files": [{"src": "/u/a.jpg"}]})]}
    monkeypatch.setitem(cli.PARSERS, "replay", (lambda c: DocumentParser(Replay(dict(parsing)), "B", sleep=lambda s: None), ""))
    monkeypatch.setitem(cli.HOSTS, "replay", (lambda c: ImageHost(Replay(dict(uploads)), "H", sleep=lambda s: None), ""))
    monkeypatch.setenv("DOCLOOM_CONFIG_DIR", str(tmp_path / "config"))
    (tmp_path / "config").mkdir()
    (tmp_path / "config/user.toml").write_text("[translation]\nrequest_interval = 0")
    for name in ("Ann Lee and Bo - 2001 - First paper.pdf", "2002 - Second manual.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    options = ["--parser", "replay", "--translator", "mock", "--host", "replay", "--upload-images", "--work-dir", str(tmp_path / "work"), "--out-dir", str(tmp_path / "out")]
    assert main([*options, "run", str(tmp_path / "*.pdf")], spark) == 0, capsys.readouterr()
    written = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert written == sorted(f"{t}/{f}" for t in ("First paper", "Second manual") for f in (f"{t}.md", f"{t}.zh.md", "images/a.jpg"))
    assert (tmp_path / "out/First paper/First paper.md").read_text() == text
    translated = (tmp_path / "out/First paper/First paper.zh.md").read_text()
    assert "# 译[# 1 Intro]" in translated and "\n## 译[## 1.1 Part]" in translated  # levels come from the layout
    assert "![a](H/u/a.jpg)\n\n![r](https://x/y.jpg)" in translated
    dumped = [p.read_text() for p in (tmp_path / "work/normalized").iterdir() if not p.name.startswith(".")]
    assert len(dumped) == 2 and all("| p |" in x and "\n## 1.1 Part" in x for x in dumped)
    assert spark.read.json(str(tmp_path / "work/chunks")).count() == 8
    said = [line.split("]")[0][1:].upper().replace(" ", "_") for line in capsys.readouterr().out.splitlines() if line.startswith("[")]
    assert said == [e for e in jobs.EVENT_TYPES if e != "JOB_FAILED"]
    # Lost images come back from the work folder, the layout is found again, and nothing is translated twice.
    (tmp_path / "out/First paper/images/a.jpg").unlink()
    results = spark.read.parquet(str(tmp_path / "work/results")).count()
    assert main([*options, "translate", str(tmp_path / "out/First paper/First paper.md")], spark) == 0
    assert (tmp_path / "out/First paper/images/a.jpg").read_bytes() == b"A" and (tmp_path / "out/First paper/First paper.zh.md").read_text() == translated
    assert spark.read.parquet(str(tmp_path / "work/results")).count() == results


def test_a_failed_translation_keeps_what_is_done(spark, tmp_path, capsys, monkeypatch):
    class Broken(MockTranslator):
        def translate(self, text, target_lang):
            if "bad" in text:
                raise ServiceError("refused", 1301)
            return super().translate(text, target_lang)

    monkeypatch.setitem(cli.TRANSLATORS, "broken", (lambda c: Broken(), ""))
    monkeypatch.setenv("DOCLOOM_CONFIG_DIR", str(tmp_path))
    (tmp_path / "user.toml").write_text("[translation]\nrequest_interval = 0")
    (tmp_path / "a.md").write_text("good\n\nbad")
    options = ["--work-dir", str(tmp_path / "w")]
    assert main([*options, "--translator", "broken", "translate", str(tmp_path / "a.md")], spark) == 1 and "[job failed]" in capsys.readouterr().out
    assert [r.translation for r in spark.read.parquet(str(tmp_path / "w/results")).collect()] == ["译[good]"]
    assert not (tmp_path / "a.zh.md").exists()


def test_layout_beside_a_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 1 Intro")
    (tmp_path / "content_list.json").write_text(json.dumps([{"type": "title", "text": "1 Intro", "text_level": 3}]))
    job = jobs.Job(spark, config.Config(), str(tmp_path / "w"), str(tmp_path / "o"))
    assert [r.normalized_text for r in job.normalize(job.read(str(tmp_path / "a.md"))).collect()] == ["### 1 Intro"]
