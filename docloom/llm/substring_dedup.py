"""Exact removal of repeated passages with longest-previous-factor arrays.

A byte goes when it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id. In
suffix order, the earlier matches of a string are its previous and next smaller positions: the
nearest suffixes of smaller documents. The longer of its common prefixes with these two is its
longest previous factor, and the string has an earlier copy when that reaches LENGTH. Every removal comes from
such an array over the bytes themselves; hashes only say which bytes need not be compared.

No suffix array of the whole corpus is made. Each window of LENGTH bytes is assigned to its anchor,
the leftmost of its GRAM-byte substrings with the smallest hash; equal windows have equal anchors,
so windows only need to be compared where anchors agree. Consecutive windows of one anchor form a context.
Documents are dealt to groups by doc_id, a group for each partition.

1. A group sends each of its anchors once, 32 bits of it, to the bucket that the others give.
2. A bucket answers which anchors more than one document has, and which of them are crowded: they stand in more than HOT
   different contexts in all.
3. A group compares its contexts of such anchors with one another. What has an earlier copy there goes no
   further. The rest is sent to the anchor's bucket; of crowded anchors window by window, dealt by content, so that
   a line or phrase that very many documents share is one row for each group and no bucket's burden.
4. Buckets compare what they get in the same way and answer the groups.
5. A group drops the bytes that windows with earlier copies cover.

In 3 and 4, whole contexts are put in suffix order first, and only the windows of those that are no whole copies after
them. The texts are shuffled once, by group, and read three times from there. The number of groups grows with the
input (PART_BYTES), and so does that of buckets. Strings are judged on the input; matches within one document don't
count and none crosses documents.

Defined results: a null text is empty; shorter ones than LENGTH stay; a null doc_id is smaller than all
others; rows with equal doc_id don't match one another. doc_id is an integer column; others are an error. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import partitions_for, table
from docloom.llm.rolling import mix, prefixes, ranges

LENGTH = 50
GRAM = 24
HOT = 1 << 14
#: Windows that are put in suffix order at once, and bytes whose anchors are found at once.
BLOCK, CHUNK = 200_000, 1 << 18
#: Contexts that are expanded into windows or bits at once, and texts that are copied at once.
FEW, MANY = 2048, 1 << 14
#: Bytes of input for each partition, which is a group and a bucket. A task's arrays take many times that.
PART_BYTES = 10 << 20
NULL_ID = -(2**63)
LOCAL = -1


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, a hash of the bytes, text number, first and last window of each context of the texts, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(texts):
        if len(raw) < length:
            continue
        for at in range(0, len(raw) - length + 1, CHUNK):  # a piece ends where the last window that starts in it does
            piece = raw[at : at + CHUNK + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                out.append(_contexts(held, length, gram))
                held, size = [], 0
    if held:
        out.append(_contexts(held, length, gram))
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _contexts(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    n, wide = len(data) - length + 1, length - gram + 1
    p = prefixes(data)
    starts = np.arange(len(data) - gram + 1)
    h = ranges(p, starts, starts + gram)
    at, step = starts, 1
    while 2 * step <= wide:
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        step *= 2
    a, b = at[:n], at[wide - step : wide - step + n]
    at = np.where(h[b] < h[a], b, a)
    inside = starts[:n] + length <= np.repeat(ends, sizes)[:n]
    new = np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
    first = np.flatnonzero(inside & new)
    last = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
    piece = np.searchsorted(ends, first, "right")
    before = (ends - sizes)[piece] - np.array([a for _, a, _ in pieces], np.int64)[piece]
    return h[at[first]], ranges(p, first, last + length), np.array([i for i, _, _ in pieces], np.int64)[piece], first - before, last - before


def previous_factors(docs: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The LPF array, given suffixes in order by their documents and the common prefixes of neighbours (lcp[i]: of i-1 and i).

    Previous and next smaller documents are found for all suffixes at once, by descending tables of
    minima over runs of 1, 2, 4 ... suffixes, which carry the common prefix along.
    """
    n = len(docs)
    best = np.zeros(n, np.int32)
    for turn in (1, -1):
        d = docs[::turn]
        # common prefix of i and the one before it, in this direction
        c = lcp if turn == 1 else np.r_[0, lcp[1:]][::-1][np.r_[n - 1, np.arange(n - 1)]] if n else lcp
        mins, cuts = [d], [c]
        size = 1
        while 2 * size <= n:
            m, k = mins[-1], cuts[-1]
            mins.append(np.r_[m[: size], np.minimum(m[size:], m[:-size])] if size < len(m) else m)
            cuts.append(np.r_[k[: size], np.minimum(k[size:], k[:-size])] if size < len(k) else k)
            size *= 2
        # mins[j][i]: the smallest document of suffixes i - 2**j + 1 to i; cuts[j][i]: the common prefix of suffixes i - 2**j and i
        at, far = np.arange(n), np.full(n, np.iinfo(np.int32).max, np.int32)
        for j in range(len(mins) - 1, -1, -1):
            width = 1 << j
            # step over suffixes at - width to at - 1 while none of them is smaller
            before = at - 1
            can = before - width + 1 >= 0
            m = mins[j][np.maximum(before, 0)]
            skip = can & (m >= d)
            far = np.where(skip, np.minimum(far, cuts[j][at]), far)
            at = np.where(skip, at - width, at)
        found = at > 0
        far = np.where(found, np.minimum(far, cuts[0][at]), 0)
        far = far if turn == 1 else far[::-1]
        best = np.maximum(best, far.astype(np.int32))
    return best


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each with the one before, up to the width."""
    n, width = windows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = windows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    w = words[order]
    differs = w[1:] != w[:-1]
    word = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
    lcp = np.full(n, width, np.int32)
    if n:
        lcp[0] = 0
    some = np.flatnonzero(word < words.shape[1])
    if len(some):
        x, y = padded[order[some + 1]], padded[order[some]]
        at = np.arange(8)[None, :] + 8 * word[some][:, None]
        odd = np.take_along_axis(x, at, 1) != np.take_along_axis(y, at, 1)
        lcp[some + 1] = np.minimum(8 * word[some] + odd.argmax(axis=1), width)
    return order, lcp


def _taken(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of texts, given by their places in data, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for at in range(0, len(sizes), MANY):  # places are sixteen times the bytes
        to = slice(at, at + MANY)
        a, b = int(starts[at]), int(ends[to][-1])
        out[a:b] = data[np.arange(a, b) + np.repeat(begin[to] - starts[to], sizes[to])]
    return out


def _windows_hit(docs: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each text a number whose bit j says that its window j also is in a text of a smaller document."""
    data = _taken(data, begin, sizes)
    n = sizes - length + 1
    own = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[own] + j
    # A window that is nowhere else has no neighbour with so long a common prefix.
    h = ranges(prefixes(data), start, start + length)
    by_hash = np.argsort(h, kind="stable")
    same = h[by_hash[1:]] == h[by_hash[:-1]]
    keep = np.sort(by_hash[np.r_[False, same] | np.r_[same, False]])
    out = np.zeros(len(n), np.uint64)
    if len(keep):
        own, j, start = own[keep], j[keep], start[keep]
        order, lcp = suffix_order(np.lib.stride_tricks.sliding_window_view(data, length)[start])
        hit = previous_factors(docs[own[order]], lcp) >= length
        at = order[hit]
        np.bitwise_or.at(out, own[at], np.uint64(1) << j[at].astype(np.uint64))
    return out


def earlier(docs: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each text (its document, its place in data) a number whose bit j says that its window j also is in a text of a smaller document.

    Texts are put in suffix order whole first: where the longest previous factor of one reaches its end, all its windows have
    earlier copies, and whatever is equal to one of them has an earlier copy in that smaller document too.
    """
    out = np.zeros(len(docs), np.uint64)
    if len(docs) < 2:
        return out
    rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)
    rows = np.zeros((len(docs), int(sizes.max())), np.uint8)
    rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = _taken(data, begin, sizes)
    order, lcp = suffix_order(rows)
    ordered = sizes[order]
    lcp = np.minimum(lcp, np.minimum(ordered, np.r_[0, ordered[:-1]])).astype(np.int32)  # what fills rows up is no text
    whole = order[previous_factors(rank[order], lcp) >= ordered]
    out[whole] = (np.uint64(1) << (sizes[whole] - length + 1).astype(np.uint64)) - np.uint64(1)
    rest = np.flatnonzero(out == 0)
    if len(rest) > 1:
        out[rest] = _windows_hit(rank[rest], data, begin[rest], sizes[rest], length)
    return out


def compared(docs: np.ndarray, parts: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same in blocks that end between parts: windows are only equal where parts are."""
    out = np.zeros(len(docs), np.uint64)
    order = np.argsort(parts, kind="stable")
    ends = np.flatnonzero(np.r_[parts[order][1:] != parts[order][:-1], True]) + 1 if len(order) else np.zeros(0, np.int64)
    start = 0
    windows = np.cumsum(sizes[order] - LENGTH + 1)
    for end in ends[np.r_[np.diff(windows[ends - 1] // BLOCK) > 0, True]].tolist() if len(ends) else []:
        own = order[start:end]
        start = end
        out[own] = earlier(docs[own], data, begin[own], sizes[own])
    return out


def _blob(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length, after that length."""
    return b"".join((np.array([len(columns[0])], "<u4").tobytes(), *(c.tobytes() for c in columns)))


def _columns(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], int]:
    """The columns, and where they end."""
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out, at


SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
SENT_DDL = "bucket int, part int, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 3, SENT, strict=True)], schema=SENT)


def _batches(rows: Iterator[tuple], size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield from _table(held).to_batches()
            held = []
    if held:
        yield from _table(held).to_batches()


class _Group:
    """The documents of a group, in an order that doesn't depend on how they arrive."""

    def __init__(self, docs: pa.Table) -> None:
        ids = docs.column("k").to_numpy()
        raws = [x or b"" for x in docs.column("raw").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], raws[i]))
        self.ids, self.raws = ids[self.order], [raws[i] for i in self.order]


def _route(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of an anchor, and the 32 bits it is known by there."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (anchor & np.uint64(0xFFFFFFFF)).astype("<u4")


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of the runs of a sorted column."""
    edges = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[i]), i, j


def _send(buckets: int):
    """Step 1: a row for each bucket with the group's anchors, in how many contexts they stand and whether several documents have them."""

    def run(docs: pa.Table) -> pa.Table:
        group = _Group(docs)
        anchor, whole, own, _, _ = contexts(group.raws)
        if not len(anchor):
            return _table([])
        part = docs.column("part")[0].as_py()
        bucket, name = _route(anchor, buckets)
        order = np.lexsort((whole, name, bucket))
        bucket, name, whole, ids = bucket[order], name[order], whole[order], group.ids[own[order]]
        new = np.r_[True, (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])]
        start = np.flatnonzero(new)
        several = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start)
        kinds = np.add.reduceat((new | np.r_[True, whole[1:] != whole[:-1]]).astype(np.int64), start)
        state = np.minimum(kinds, 0x7FFF).astype("<u2") | (several.astype("<u2") << np.uint16(15))
        bucket, name = bucket[start], name[start]
        return _table([(b, part, _blob(name[i:j], state[i:j])) for b, i, j in _cuts(bucket)])

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, for all buckets of a task: which anchors of a group others have too, and whether they are crowded."""
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for bucket, part, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "data")), strict=True):
            groups.setdefault(bucket, []).append((part, data))

    def answers() -> Iterator[tuple]:
        for bucket in sorted(groups):
            blobs = groups.pop(bucket)
            names, states = (np.concatenate(x) for x in zip(*(_columns(data, "<u4", "<u2")[0] for _, data in blobs), strict=True))
            own = np.repeat(np.arange(len(blobs)), [int(np.frombuffer(data, "<u4", 1)[0]) for _, data in blobs])
            order = np.argsort(names, kind="stable")
            new = np.r_[True, names[order][1:] != names[order][:-1]] if len(order) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            state = states[order]
            shared = (np.add.reduceat(np.ones(len(order), np.int64), start) > 1) | (np.maximum.reduceat(state, start) >= 1 << 15)
            crowded = np.add.reduceat((state & np.uint16(0x7FFF)).astype(np.int64), start) > HOT
            want, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
            want[order], hot[order] = shared[run], (shared & crowded)[run]
            names, hot, own = names[want], hot[want], own[want]
            for at, i, j in _cuts(own):
                yield bucket, blobs[at][0], _blob(names[i:j], hot[i:j].astype(np.uint8))

    yield from _batches(answers())


def _alone(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, bits: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of contexts of crowded anchors, without those that have an earlier copy here: context, number in it, hash of the bytes.

    A window is 50 bytes of hash sums for one of the text, so few contexts are expanded at a time.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(0, len(many), FEW):
        some = many[at : at + FEW]
        n = windows[some].astype(np.int64)
        of = np.repeat(some, n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        kept = (bits[of] >> j.astype(np.uint64)) & np.uint64(1) == 0
        of, j = of[kept], j[kept]
        ends = np.arange(1, len(of) + 1) * LENGTH
        out.append((of, j, ranges(prefixes(_taken(data, begin[of] + j, np.full(len(of), LENGTH))), ends - LENGTH, ends)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gather(buckets: int):
    """Step 3: contexts of anchors that others have, compared within the group; (LOCAL, part, answers), and for buckets what has no earlier copy here."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _table([])
        group, part = _Group(docs), docs.column("part")[0].as_py()
        said = [(b, *_columns(data, "<u4", "u1")[0]) for b, data in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True)]
        known = np.concatenate([n.astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, n, _ in said])
        hot = np.concatenate([x for _, _, x in said]) > 0
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        anchor, _, own, first, last = contexts(group.raws)
        bucket, name = _route(anchor, buckets)
        full = name.astype(np.uint64) | bucket.astype(np.uint64) << np.uint64(32)
        at = np.minimum(np.searchsorted(known, full), len(known) - 1)
        pick = np.flatnonzero(known[at] == full)
        crowded, bucket, anchor, own, first, last = hot[at[pick]], bucket[pick], anchor[pick], own[pick], first[pick], last[pick]
        lengths = np.array([len(x) for x in group.raws], np.int64)
        data, begin, sizes = np.frombuffer(b"".join(group.raws), np.uint8), (np.cumsum(lengths) - lengths)[own] + first, last - first + LENGTH
        bits = compared(group.ids[own], anchor, data, begin, sizes)
        some = np.flatnonzero(bits)
        rows = [(LOCAL, part, _blob(own[some].astype("<u4"), first[some].astype("<u4"), bits[some]))] if len(some) else []
        free = bits != (np.uint64(1) << (last - first + 1).astype(np.uint64)) - np.uint64(1)
        plain, many = np.flatnonzero(free & ~crowded), np.flatnonzero(free & crowded)
        of, j, h = _alone(data, begin, last - first + 1, bits, many)
        to = np.r_[bucket[plain], ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)]
        sub = np.r_[(anchor[plain] >> np.uint64(16)).astype("<u2"), (h >> np.uint64(8)).astype("<u2")]
        own, first = np.r_[own[plain], own[of]], np.r_[first[plain], first[of] + j]
        begin, sizes = np.r_[begin[plain], begin[of] + j], np.r_[sizes[plain], np.full(len(of), LENGTH)]
        order = np.lexsort((own, sub, to))
        to, sub, own, first, begin, sizes = (x[order] for x in (to, sub, own, first, begin, sizes))
        for b, i, j in _cuts(to):
            docs_, at = np.unique(own[i:j], return_inverse=True)
            head = _blob(docs_.astype("<u4"), group.ids[docs_].astype("<i8"))
            rows.append((b, part, head + _blob(sub[i:j], at.astype("<u4"), first[i:j].astype("<u4"), sizes[i:j].astype("u1")) + _taken(data, begin[i:j], sizes[i:j]).tobytes()))
        return _table(rows)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: (LOCAL, part, answers) for what buckets got; what groups told themselves passes through."""
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        passed = []
        for bucket, part, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "data")), strict=True):
            if bucket == LOCAL:
                passed.append((bucket, part, data))
            else:
                groups.setdefault(bucket, []).append((part, data))
        if passed:
            yield from _table(passed).to_batches()

    def answers() -> Iterator[tuple]:
        for bucket in sorted(groups):
            blobs = groups.pop(bucket)
            ks, subs, sizes, datas, places = [], [], [], [], []
            for _, blob in blobs:
                (docs, ids), at = _columns(blob, "<u4", "<i8")
                (sub, own, where, size), end = _columns(blob[at:], "<u2", "<u4", "<u4", "u1")
                ks.append(ids[own])
                subs.append(sub)
                sizes.append(size.astype(np.int64))
                datas.append(np.frombuffer(blob, np.uint8, -1, at + end))
                places.append((docs[own], where))
            size = np.concatenate(sizes)
            bits = compared(np.concatenate(ks), np.concatenate(subs), np.concatenate(datas), np.cumsum(size) - size, size)
            at = 0
            for (part, _), (own, where) in zip(blobs, places, strict=True):
                said = bits[at : at + len(own)]
                at += len(own)
                hit = np.flatnonzero(said)
                if len(hit):
                    yield LOCAL, part, _blob(own[hit], where[hit], said[hit])

    yield from _batches(answers())


def covered(size: int, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a text of this size lie in windows with earlier copies: bit j of a context is the window first + j."""
    edge = np.zeros(size + 1, np.int32)
    for at in range(0, len(bits), FEW):
        row, j = np.nonzero((bits[at : at + FEW, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1))
        starts = first[at + row].astype(np.int64) + j
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(with_text: bool):
    """Step 5."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(docs)
        said = [_columns(data, "<u4", "<u4", "<u8")[0] for data in told.column("data").to_pylist()]
        own, first, bits = (np.concatenate(x) for x in zip(*said, strict=True)) if said else (np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint64))
        order = np.argsort(own, kind="stable")
        own, first, bits = own[order], first[order], bits[order]
        edges = np.searchsorted(own, np.arange(len(group.raws) + 1))
        rows = []
        for i, raw in enumerate(group.raws):
            a, b = int(edges[i]), int(edges[i + 1])
            rest, runs = raw, 0
            if a < b:
                gone = covered(len(raw), first[a:b], bits[a:b])
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
            rows.append((len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
        columns = list(zip(*rows, strict=True)) if rows else [()] * (4 + with_text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([docs.column("doc_id").take(pa.array(group.order, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=["doc_id", *names[: 4 + with_text]])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}")
    parts = partitions_for(docs, "text", PART_BYTES)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    own = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    texts = docs.select("doc_id", key.alias("k"), F.col("text").cast("binary").alias("raw"), own).repartitionById(parts, F.col("part"))
    sent = texts.groupBy("part").applyInArrow(_send(parts), SENT_DDL)
    told = sent.repartitionById(parts, F.col("bucket")).mapInArrow(_match, SENT_DDL).repartitionById(parts, F.col("part"))
    gathered = texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_gather(parts), SENT_DDL)
    # What a group told itself goes through any task.
    dealt = gathered.repartitionById(parts, F.when(F.col("bucket") == LOCAL, F.col("part")).otherwise(F.col("bucket")))
    answers = dealt.mapInArrow(_compare, SENT_DDL).repartitionById(parts, F.col("part"))
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_finish(with_text), out)


def op3_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op3_previous_factors": op3_previous_factors}
