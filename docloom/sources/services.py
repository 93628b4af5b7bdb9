"""Remote services: document parsers, translators, image hosts.

What a service is asked for is a task that goes from stage to stage: call() says what to send in a state, and step() what a reply
makes of it. Neither opens a connection or waits; run() does, the same for all of them, through a Transport. Http is one; Replay
answers from recorded replies, for tests and offline runs. Calls are made from Spark tasks, so that a task that
is tried again repeats its calls: requests carry keys that are equal for equal work, and speculation should be off.
"""

from __future__ import annotations

import http.client
import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.retry import EMPTY_REPLY, UPLOAD_RETRY_CODES, Patience, worth_retrying
from docloom.sources.archives import ArchiveError


class ServiceError(RuntimeError):
    """A failed task; code is the service's own or the HTTP status."""

    def __init__(self, message: str, code: int | str | None = None) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Reply:
    status: int
    body: bytes = b""

    def json(self) -> object:
        try:
            return json.loads(self.body)
        except ValueError:
            return None


class Call(NamedTuple):
    method: str
    url: str
    headers: dict[str, str] | None = None
    body: bytes | None = None


class Transport(ABC):
    @abstractmethod
    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply: ...


@dataclass
class Http(Transport):
    """A connection for each call, with limits in seconds for connecting, writing and reading. Certificates are verified; up to
    five redirects of a GET are followed."""

    connect: float = 5.0
    read: float = 600.0
    write: float = 600.0

    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply:
        for _ in range(6):
            at = urlsplit(url)
            if at.scheme not in ("http", "https") or not at.hostname:
                raise ServiceError(f"not an HTTP address: {url[:200]}")
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            link = kind(at.hostname, at.port, timeout=self.connect)
            try:
                link.connect()
                link.sock.settimeout(self.write)
                link.request(method, (at.path or "/") + (f"?{at.query}" if at.query else ""), body, headers or {})
                link.sock.settimeout(self.read)
                got = link.getresponse()
                if method == "GET" and got.status in (301, 302, 303, 307, 308) and (to := got.getheader("Location")):
                    url = to if "://" in to else f"{at.scheme}://{at.netloc}{to}"
                    continue
                return Reply(got.status, got.read())
            except http.client.HTTPException as e:
                raise ConnectionError(f"{method} {at.hostname}: {type(e).__name__}") from e
            finally:
                link.close()
        raise ServiceError(f"too many redirects: {url[:200]}")


@dataclass
class Replay(Transport):
    """Recorded replies by method and URL, each list in its order; the last one repeats."""

    replies: dict[tuple[str, str], list[Reply]]
    calls: list[tuple[str, str]] = field(default_factory=list)
    bodies: list[bytes | None] = field(default_factory=list)

    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply:
        self.calls.append((method, url))
        self.bodies.append(body)
        own = self.replies.get((method, url))
        if not own:
            raise ConnectionError(f"no reply recorded for {method} {url}")
        return own.pop(0) if len(own) > 1 else own[0]


class State(NamedTuple):
    """Where a task stands: its stage, what it knows, and how long to wait before the next call. The last stage is DONE."""

    stage: str
    known: dict
    wait: float = 0.0


DONE = "done"


class Service(ABC):
    """What a kind of task sends, and what replies make of it."""

    @abstractmethod
    def call(self, state: State) -> Call: ...

    @abstractmethod
    def step(self, state: State, reply: Reply | Exception) -> State:
        """The next state after a reply, or after a call that failed before there was one; ServiceError if there is none."""


def run(service: Service, state: State, transport: Transport, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What a task knows when it is done."""
    while state.stage != DONE:
        if state.wait:
            sleep(state.wait)
        try:
            got: Reply | Exception = transport.call(*service.call(state))
        except (OSError, ValueError) as e:
            got = e
        state = service.step(state, got)
    return state.known


def _json_headers(token: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {token}", "Content-Type": "application/json", "Accept": "application/json"}


def _part(value: object, *path: str | int) -> object:
    """What lies at a path of an answer; None where the path ends early."""
    for key in path:
        try:
            value = value[key]
        except (KeyError, IndexError, TypeError):
            return None
    return value


# --- document parser --------------------------------------------------------------------------------------------


def poll_state(reply: object) -> tuple[str, str]:
    """(done, archive URL), (failed, message) or (waiting, '') of a reply to a status request."""
    first = _part(reply, "data", "extract_result", 0)
    if not first:
        return "failed", "the reply has no result"
    url, said = _part(first, "full_zip_url"), _part(first, "err_msg") or _part(first, "message") or "unknown error"
    outcomes = {"done": ("done", url) if url else ("failed", "done without an archive"), "failed": ("failed", str(said))}
    return outcomes.get(_part(first, "state"), ("waiting", ""))


@dataclass
class DocumentParser(Service):
    """A file's way through a parser: submit it, upload it, poll until it is done, download the archive.

    known: name, content; then batch, url; at the end archive.
    """

    transport: Transport
    base_url: str
    token: str = ""
    options: dict = field(default_factory=lambda: {"enable_formula": True, "language": "en", "enable_table": True, "model_version": "vlm"})
    poll_interval: float = 3.0
    poll_timeout: float = 3600.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time

    def call(self, state: State) -> Call:
        known, own = state.known, _json_headers(self.token)
        if state.stage == "submit":
            return Call("POST", f"{self.base_url}/file-urls/batch", own, json.dumps({**self.options, "files": [{"name": known["name"], "is_ocr": True}]}).encode())
        if state.stage == "poll":
            return Call("GET", f"{self.base_url}/extract-results/batch/{known['batch']}", own)
        return Call("PUT", known["url"], None, known["content"]) if state.stage == "upload" else Call("GET", known["url"])

    def step(self, state: State, reply: Reply | Exception) -> State:
        if isinstance(reply, Exception):
            raise ServiceError(f"{state.stage}: {reply}") from reply
        if reply.status >= 400:
            raise ServiceError(f"{state.stage}: HTTP {reply.status}", reply.status)
        return getattr(self, f"_after_{state.stage}")(state.known, reply)

    def _after_submit(self, known: dict, reply: Reply) -> State:
        said = reply.json()
        batch, url = _part(said, "data", "batch_id"), _part(said, "data", "file_urls", 0)
        if _part(said, "code") != 0 or not batch or not url:
            raise ServiceError(f"no upload URL: {said}")
        return State("upload", {**known, "batch": batch, "url": url})

    def _after_upload(self, known: dict, _: Reply) -> State:
        return State("poll", {"batch": known["batch"], "until": self.clock() + self.poll_timeout})

    def _after_poll(self, known: dict, reply: Reply) -> State:
        outcome, said = poll_state(reply.json())
        if outcome == "failed":
            raise ServiceError(said)
        if outcome == "waiting" and self.clock() > known["until"]:
            raise ServiceError("polling timed out")
        return State("poll", known, self.poll_interval) if outcome == "waiting" else State("download", {"url": said})

    def _after_download(self, known: dict, reply: Reply) -> State:
        return State(DONE, {"archive": reply.body})

    def parse(self, filename: str, content: bytes) -> bytes:
        return run(self, State("submit", {"name": filename, "content": content}), self.transport, self.sleep)["archive"]


def parse_documents(files: DataFrame, make_parser: Callable[[], DocumentParser]) -> DataFrame:
    """path, content (the archive), error of files (path, content); one parser for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make_parser()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    row = (path, parser.parse(path.rsplit("/", 1)[-1], content), None)
                except (ServiceError, ArchiveError, OSError) as e:
                    row = (path, None, str(e)[:200])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")


# --- translator -------------------------------------------------------------------------------------------------


class Translator(ABC):
    """What turns a text into another language; runs inside tasks."""

    @abstractmethod
    def translate(self, text: str, target_lang: str) -> str: ...


class MockTranslator(Translator):
    def translate(self, text: str, target_lang: str) -> str:
        return text if not text.strip() else f"译[{text[:20]}]"


PROMPT = """Translate the document into {target_lang}. Keep formulas, code, structure, order and image references as they are. Return the translation only."""


@dataclass
class ChatTranslator(Translator, Service):
    """A chat service, asked until it gives a usable reply or patience ends.

    Blank texts are not sent. Empty replies are tried again; where they persist the result is empty, and the
    caller keeps the source. known: text, lang, attempt; at the end said.
    """

    transport: Transport
    base_url: str
    api_key: str
    model: str
    temperature: float = 0.7
    top_p: float = 0.9
    patience: Patience = Patience()
    sleep: Callable[[float], None] = time.sleep

    def call(self, state: State) -> Call:
        messages = [{"role": "system", "content": PROMPT.format(target_lang=state.known["lang"])}, {"role": "user", "content": state.known["text"]}]
        asked = {"model": self.model, "messages": messages, "temperature": self.temperature, "top_p": self.top_p}
        return Call("POST", f"{self.base_url.rstrip('/')}/chat/completions", _json_headers(self.api_key), json.dumps(asked, ensure_ascii=False).encode())

    def outcome(self, reply: Reply | Exception) -> tuple[str, int | None, str, bool]:
        """What was said; else the code, a message, and whether the call failed in a way that may pass."""
        if isinstance(reply, Exception):
            return "", None, str(reply), True
        body = reply.json()
        error = _part(body, "error")
        if reply.status >= 400 or error:
            return "", own_code(body) or (reply.status if reply.status >= 400 else -1), str(error or reply.body[:200]), False
        try:
            said = thoughtless(reply_content(body))
        except (ValueError, AttributeError, TypeError) as e:
            return "", None, str(e), True
        return said, EMPTY_REPLY, "empty reply", True

    def step(self, state: State, reply: Reply | Exception) -> State:
        said, code, message, passing = self.outcome(reply)
        attempt = state.known["attempt"]
        if said.strip():
            return State(DONE, {"said": said})
        if not worth_retrying(code, passing):
            raise ServiceError(message, code)
        if attempt < self.patience.more:
            return State("ask", {**state.known, "attempt": attempt + 1}, self.patience.wait(attempt, code))
        if code == EMPTY_REPLY:
            return State(DONE, {"said": ""})
        raise ServiceError(f"no translation after {attempt + 1} attempts: {message[:200]}", code)

    def translate(self, text: str, target_lang: str) -> str:
        return run(self, State("ask", {"text": text, "lang": target_lang, "attempt": 0}), self.transport, self.sleep)["said"] if text.strip() else text


def own_code(body: object) -> int | None:
    """The first positive of error.code, code and msgCode."""
    if not isinstance(body, dict):
        return None
    error = body.get("error")
    for value in ((error or {}).get("code") if isinstance(error, dict) else None, body.get("code"), body.get("msgCode")):
        try:
            if int(value) > 0:
                return int(value)
        except (TypeError, ValueError):
            continue
    return None


def reply_content(body: object) -> str:
    choices = body.get("choices") if isinstance(body, dict) else None
    if not choices:
        raise ValueError("the reply has no choices")
    content = (choices[0].get("message") or {}).get("content", "")
    if isinstance(content, list):
        return "".join(x if isinstance(x, str) else x.get("text", x.get("content", "")) for x in content if isinstance(x, (str, dict)))
    return content or ""


def thoughtless(text: str) -> str:
    """Without a leading think element."""
    rest = text.lstrip()
    if rest.startswith("<think>") and "</think>" in rest:
        rest = rest.split("</think>", 1)[1]
    return rest.strip()


def translate_chunks(chunks: DataFrame, make_translator: Callable[[], Translator], target_lang: str, patience: Patience | None = None, concurrency: int = 1) -> DataFrame:
    """chunks with translation and error; one translator for each task.

    As many tasks as the concurrency, each with patience's gap between requests, as a service with one account's rate limit asks for.
    Filter before: nothing is pushed below Python.
    """
    wait = (lambda: time.sleep(patience.between())) if patience and patience.gap > 0 else lambda: None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator, first = make_translator(), True
        for batch in batches:
            out, errors = [], []
            for text in batch.column("source_text").to_pylist():
                if not first and (text or "").strip():
                    wait()
                first = False
                try:
                    out.append(translator.translate(text or "", target_lang))
                    errors.append(None)
                except ServiceError as e:
                    out.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "translation", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return (chunks.coalesce(1) if concurrency == 1 else chunks.repartition(concurrency)).mapInArrow(run, f"{fields}, translation string, error string")


# --- image host -------------------------------------------------------------------------------------------------


@dataclass
class ImageHost(Service):
    """Uploads of batches; a batch's key is the request's, with the batch's number. known: asked, attempt; at the end files."""

    transport: Transport
    base_url: str
    token: str = ""
    max_retries: int = 3
    sleep: Callable[[float], None] = time.sleep

    def call(self, state: State) -> Call:
        return Call("POST", f"{self.base_url.rstrip('/')}/upload/batch", _json_headers(self.token), json.dumps(state.known["asked"]).encode())

    def step(self, state: State, reply: Reply | Exception) -> State:
        attempt = state.known["attempt"]
        status, body = (None, None) if isinstance(reply, Exception) else (reply.status, reply.json())
        if status == 200 and _part(body, "success"):
            return State(DONE, {"files": _part(body, "files") or []})
        code, after = _part(body, "code"), _part(body, "retryAfterSeconds")
        again = isinstance(reply, OSError) if status is None else status != 200 and (status == 429 or status >= 500 or code in UPLOAD_RETRY_CODES)
        if not again or attempt == self.max_retries:
            raise ServiceError(f"upload: {reply if status is None else f'HTTP {status}: ' + str(_part(body, 'error'))}", code)
        asked_for = float(after) if isinstance(after, (int, float)) and after > 0 else 2.0 * 2**attempt
        return State("send", {**state.known, "attempt": attempt + 1}, min(asked_for, 60.0))

    def upload(self, folder: str, files: list[dict], request_id: str, message: str = "") -> list[str]:
        """URLs in the files' order."""
        asked = {"folderName": folder, "files": files, "requestId": request_id, **({"commitMessage": message} if message else {})}
        done = run(self, State("send", {"asked": asked, "attempt": 0}), self.transport, self.sleep)
        return [self.absolute(str(x.get("src", ""))) for x in done["files"]]

    def absolute(self, source: str) -> str:
        return source if not source or source.startswith(("http://", "https://")) else f"{self.base_url.rstrip('/')}{source}"


def upload_images(records: DataFrame, make_host: Callable[[], ImageHost], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, name, url of upload records (keys, folder, request_id, batch, name, contentBase64, mimeType, sha256)."""
    file = F.struct("name", "contentBase64", "mimeType", "sha256")
    batches = records.groupBy(*keys, "folder", "request_id", "batch").agg(F.array_sort(F.collect_list(file)).alias("files"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = make_host()
        for batch in rows:
            for i, row in enumerate(batch.to_pylist()):
                urls = host.upload(row["folder"], row["files"], f"{row['request_id']}-{row['batch']}")
                pairs = list(zip((f["name"] for f in row["files"]), urls, strict=False))
                own = [batch.column(k).take(pa.array([i] * len(pairs))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([n for n, _ in pairs], pa.string()), pa.array([u for _, u in pairs], pa.string())], names=[*keys, "name", "url"])

    kinds = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in keys)
    return batches.mapInArrow(run, f"{kinds}, name string, url string")
