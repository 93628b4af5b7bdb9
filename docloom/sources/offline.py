"""Stand-ins for the services: transports that answer from what they are sent, without a connection."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass, field

from docloom.sources.services import Reply, Transport


def _answer(body: object, status: int = 200) -> Reply:
    return Reply(status, json.dumps(body, ensure_ascii=False).encode())


@dataclass
class OfflineParser(Transport):
    """A parser that takes each file for UTF-8 Markdown and says it is busy once; each heading line becomes a layout record. What begins with ! fails."""

    files: dict[str, bytes] = field(default_factory=dict)
    asked: int = 0

    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply:
        last = url.rsplit("/", 1)[-1]
        if method == "POST":
            return _answer({"code": 0, "data": {"batch_id": (name := f"b{len(self.files)}"), "file_urls": [f"offline/put/{name}"]}})
        if method == "PUT":
            self.files[last], self.asked = body or b"", 0
            return Reply(200)
        content = self.files.get(last, b"")
        if "/batch/" in url:
            self.asked += 1
            state = "failed" if content.startswith(b"!") else "done" if self.asked > 1 else "running"
            return _answer({"data": {"extract_result": [{"state": state, "err_msg": "unreadable", "full_zip_url": f"offline/zip/{last}"}]}})
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            text = content.decode("utf-8", "ignore")
            z.writestr("full.md", text)
            z.writestr("0_content_list.json", json.dumps([{"type": "title", "text": x.lstrip("# "), "text_level": 1} for x in text.split("\n") if x.startswith("#")]))
            z.writestr("images/a.jpg", content[:4])
        return Reply(200, out.getvalue())


@dataclass
class OfflineChat(Transport):
    """A chat service that says a text in capitals after a thought; it asks for patience first where the text's length is odd, and says nothing to texts with "mute"."""

    refused: str = ""

    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply:
        text = json.loads(body or b"{}")["messages"][-1]["content"]
        if "stop" in text:
            return _answer({"error": {"code": "1301", "message": "refused"}}, 400)
        if len(text) % 2 and self.refused != text:
            self.refused = text
            return _answer({"error": {"code": "1302", "message": "slow down"}}, 429)
        return _answer({"choices": [{"message": {"content": "" if "mute" in text else f"<think>hm</think>\n{text.upper()}"}}]})


@dataclass
class OfflineHost(Transport):
    """An image host that puts files under the folder they are sent for; every first request of a batch is turned away."""

    seen: set[str] = field(default_factory=set)

    def call(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> Reply:
        asked = json.loads(body or b"{}")
        if asked["requestId"] not in self.seen:
            self.seen.add(asked["requestId"])
            return _answer({"success": False, "code": "RATE_LIMIT", "retryAfterSeconds": 1}, 429)
        return _answer({"success": True, "files": [{"src": f"/{asked['folderName']}/{f['name']}"} for f in asked["files"]]})
