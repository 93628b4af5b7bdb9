"""Secret scans with structural confirmation.

Patterns find candidates; a candidate is only reported as a key or token when its decoded
bytes have the structure of one: base64 or hex that decodes to a DER key (nested lengths
that fill their parents exactly, the fields of PKCS#1, PKCS#8 or SEC1), to an OpenSSH key
(magic, then length-prefixed strings that fit), or a signed token whose first part is a JSON
header with an algorithm and whose second is JSON too. The three base patterns (assign,
access, hex) are reported as they match and stay.

Line ends may be written out (backslash and n or r, as in JSON and source text) and lines may be string literals in a row.
Lines of base64 or hex, but for the last of 16 characters at least, are read as one run without line ends and 0x prefixes,
pairs of hex digits between colons or white space as one run too, and keys are looked for at every place of a run; the key's own lengths say where it ends.
A PEM block is a BEGIN mark and the next mark, if that ends the same kind. Only the bytes that a structure's
lengths lead to are decoded, so that time grows with the text and not with what false starts claim to hold.

Kinds in their order: assign, access, hex, token, pem, der, openssh.
Offsets are code points, ends exclusive; a base64 key inside a PEM block is reported as pem only.

Defined results: a null or empty text has no spans. A row of the input gives a row of the
result, repeated rows included. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table

KINDS = ("assign", "access", "hex", "token", "pem", "der", "openssh")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Candidates of the method: runs of base64 or hex, also over several lines. What is shorter than 40 characters holds no private key.
BREAK = r"""(?:(?:\\+[rn])*(?:["'][ \t]*[+,]?)?[ \t]*[\r\n]\s*(?:(?:\+[ \t]*)?["'])?|(?:\\+[rn])+[ \t]*)"""
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{BREAK}[A-Za-z0-9+/_-]{{16,}})*(?:{BREAK}[A-Za-z0-9+/_-]+)?")
PIECE = re.compile(rf"{BREAK}|[A-Za-z0-9+/_-]+")
#: How a key begins, in hex: a sequence and its length, then a version or a sequence; and in base64 its first byte.
DER_START = re.compile(r"30(?:[0-7][0-9a-f]|81..|82.{4}|83.{6}|84.{8})(?:02010[01]|30)")
B64_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
PAIRS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?:(?::\s*|\s+)[0-9A-Fa-f]{2}(?![0-9A-Fa-f])){19,}")
MAGIC = b"openssh-key-v1\0"
#: More elements than these no key has on one level, and no key file so many public keys.
MOST_ELEMENTS, MOST_KEYS = 32, 64


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


class _Bytes:
    """Bytes that are decoded where they are read: chars characters from a place of a run stand for per bytes."""

    def __init__(self, run: str, at: int, end: int, chars: int, per: int, decode: Callable[[str], bytes | None]) -> None:
        end -= (end - at) % chars if chars == 2 else (end - at) % chars == 1
        self.run, self.at, self.end, self.chars, self.per, self.decode = run, at, end, chars, per, decode
        self.size = (end - at) * per // chars

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, min(len(self) if part.stop is None else part.stop, len(self))
        first = start // self.per
        text = self.run[self.at + first * self.chars : min(self.at - (-stop // self.per) * self.chars, self.end)]
        data = self.decode(text) if start < stop else b""
        return (data or b"")[start - first * self.per : stop - first * self.per]


def _element(data: bytes | _Bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at a place; None if it doesn't fit."""
    head = data[at : min(at + 6, end)]
    if len(head) < 2:
        return None
    tag, size, at = head[0], head[1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
        if size < 0x80:
            return None  # DER writes such lengths in one byte
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes | _Bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly."""
    out = []
    while at < end:
        if len(out) == MOST_ELEMENTS or (e := _element(data, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _der_end(data: bytes | _Bytes) -> int | None:
    """Where a private key ends that begins here: PKCS#8 (also encrypted), PKCS#1 or SEC1, its lengths nested without a gap."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30:
        return None
    parts = _children(data, top[1], top[2])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    oid_first = lambda p: bool(c := _children(data, p[1], p[2])) and c[0][0] == 0x06
    version = data[parts[0][1] : min(parts[0][2], parts[0][1] + 2)] if tags[0] == 0x02 else b""
    if tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1"):
        return top[2] if oid_first(parts[1]) else None
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version in (b"\0", b"\1"):
        return top[2]
    if tags[:2] == [0x02, 0x04] and version == b"\1":
        return top[2] if all(t in (0xA0, 0xA1) for t in tags[2:]) else None
    return top[2] if tags == [0x30, 0x04] and oid_first(parts[0]) else None


def is_der_key(data: bytes) -> bool:
    return _der_end(data) == len(data)


def is_openssh_key(data: bytes) -> bool:
    return _openssh_end(data) == len(data)


def _openssh_end(data: bytes | _Bytes) -> int | None:
    """Where a key ends: the magic, then cipher, derivation, options, a count of keys, public keys and the private part."""
    if data[: len(MAGIC)] != MAGIC:
        return None

    def string(at: int) -> int | None:
        size = data[at : at + 4]
        end = at + 4 + int.from_bytes(size, "big")
        return end if len(size) == 4 and end <= len(data) else None

    at: int | None = len(MAGIC)
    for _ in range(3):
        if (at := string(at)) is None:
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= keys <= MOST_KEYS:
        return None
    at += 4
    for _ in range(keys + 1):
        if (at := string(at)) is None:
            return None
    return at


def _keys_in(run: str, base64_too: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the keys at any place of a run of base64 or hex, the outermost of nested ones, by start."""

    def look(starts: Iterable[int], end: int, chars: int, per: int, decode: Callable[[str], bytes | None]) -> Iterator[tuple[int, int, int]]:
        """Keys that begin at one of the places; per bytes take chars characters."""
        free = 0
        for at in starts:
            if at < free:
                continue
            data = _Bytes(run, at, end, chars, per, decode)
            kind = 5 if data[:1] == b"\x30" else 6
            n = _der_end(data) if kind == 5 else _openssh_end(data)
            if n is not None and n * chars // per >= 40:
                free = at - (-n * chars // per)
                yield at, kind, free

    found = list(look((m.start() for m in B64_START.finditer(run)), len(run), 4, 3, _b64)) if base64_too else []
    taken = [a for a, _, _ in found]
    for h in re.finditer(r"[0-9a-fA-F]{40,}", run):
        low = h[0].lower()
        starts = sorted([m.start() + h.start() for m in re.finditer(rf"(?={DER_START.pattern}|{MAGIC.hex()})", low)])
        for x in look(starts, h.end(), 2, 1, bytes.fromhex):
            k = bisect_right(taken, x[0]) - 1
            if not (k >= 0 and found[k][2] > x[0] or k + 1 < len(taken) and taken[k + 1] < x[2]):
                found.append(x)
    return found


def is_token(header: str, payload: str) -> bool:
    parts = []
    for x in (header, payload):
        try:
            parts.append(json.loads(_b64(x) or b""))
        except (ValueError, RecursionError):
            return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base patterns, unordered."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class _Spans:
    """Spans that don't overlap, in which places are looked up."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]

    def meet(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.spans[k][1] > a or k + 1 < len(self.spans) and self.starts[k + 1] < b


def _pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    marks = list(PEM_MARK.finditer(text)) if "-----BEGIN" in text else []
    for first, last in zip(marks, marks[1:], strict=False):
        if first[1] != "BEGIN" or last[1] != "END" or first[2] != last[2]:
            continue
        inner = text[first.end() : last.start()]
        body = re.sub(r"""["']\s*[+,]?\s*["']""", "", re.sub(r"\\+[rn]", "\n", inner).replace("\\/", "/"))
        body = re.sub(r"^(?:[A-Za-z-]+:[^\n]*\n)+\s*", "", body.lstrip())
        data = _b64(re.sub(r"\s+", "", body))
        sealed = "ENCRYPTED" in inner  # its contents are cipher text, without structure of their own
        if data and (is_der_key(data) or is_openssh_key(data) or (sealed and len(data) % 8 == 0)):
            yield first.start(), last.end()


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what has the structure of a key or signed token, unordered."""
    blocks = _Spans(list(_pem_blocks(text)))
    out = [(a, 4, b) for a, b in blocks.spans]
    out += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
    keys: list[tuple[int, int, int]] = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < 40:
            continue
        pieces = [(p.start(), p.end()) for p in PIECE.finditer(text, m.start(), m.end()) if p[0][0].isalnum() or p[0][0] in "+/_-"]
        found = _placed(text, pieces)
        if any(text.startswith(("0x", "0X"), a) for a, _ in pieces[1:]):
            known = _Spans([(a, b) for a, _, b in found])
            bare = [(a + 2 * text.startswith(("0x", "0X"), a), b) for a, b in pieces]
            found += [x for x in _placed(text, bare) if not known.meet(x[0], x[2])]
        keys += [x for x in found if not blocks.meet(x[0], x[2])]
    known = _Spans([(a, b) for a, _, b in keys])
    for m in PAIRS.finditer(text):
        pieces = [(p.start(), p.end()) for p in re.compile("[0-9A-Fa-f]{2}").finditer(text, m.start(), m.end())]
        keys += [x for x in _placed(text, pieces, False) if not known.meet(x[0], x[2]) and not blocks.meet(x[0], x[2])]
    return out + keys


def _placed(text: str, pieces: list[tuple[int, int]], base64_too: bool = True) -> list[tuple[int, int, int]]:
    """The keys in a run made of pieces of a text, by their places in the text, padding included."""
    run = "".join(text[a:b] for a, b in pieces)
    firsts = list(accumulate((b - a for a, b in pieces), initial=0))

    def place(i: int) -> int:
        k = bisect_right(firsts, i) - 1
        return pieces[k][0] + i - firsts[k]

    out = []
    for a, kind, b in _keys_in(run, base64_too):
        end = place(b - 1) + 1
        out.append((place(a), kind, end + len(re.compile("={0,2}").match(text, end)[0])))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base patterns, and all spans, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + confirmed_spans(text))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id"))


QUERIES = {"op1_secrets": op1_secrets}
