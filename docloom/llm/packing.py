"""Best-fit packing planned on the histogram of lengths.

Documents become token ids and are cut into pieces only where they are longer than a
sequence. The plan is made on counts by length (as many numbers as a sequence has tokens at
most, whatever the corpus): best-fit decreasing over whole groups of pieces that are equally
long. Its result is a table of slots, each a run of ranks within a length that goes to a run of
sequences at one offset; pieces take their slots by their rank within their length.

Ranks within a length are counted in buckets, so that no length, however frequent, is sorted
by one task; the buckets' first ranks come from their counts.

Texts are tokenised once, word by word: no token crosses white space, so that the ids of words
are looked up where they have been seen before (see Encoder; a worker keeps about CACHE
words, in some 30 bytes each). The pieces (lengths and checksums, or ids where asked for) are checkpointed and read
twice.

Defined results: a null or empty text is the end token alone; repeated rows are packed each
for itself; no rows give no sequences. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, table
from docloom.llm.rolling import prefixes, ranges

LENGTH = 4096
END_ID = 1
CACHE = 2_000_000
#: Bytes of text that are tokenised at a time.
PART = 1 << 20
#: ASCII marks at which the tokenizer ends a word, whatever follows; the apostrophe begins some of its words.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BUCKET_ROWS = 200_000


def _cut(raw: bytes) -> list[bytes]:
    """A text in parts of about PART bytes that end at white space."""
    out, at = [], 0
    while len(raw) - at > PART:
        end = max(raw.rfind(b" ", at, at + PART), raw.rfind(b"\n", at, at + PART))
        end = end if end > at else next((m.start() for m in re.finditer(rb"\s", raw[at + PART :])), len(raw) - at - PART) + at + PART
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def _kinds() -> np.ndarray:
    """0: other, 1: ASCII letter, 2: mark, 3: white space."""
    kinds = np.zeros(256, np.int8)
    kinds[list(range(65, 91)) + list(range(97, 123))] = 1
    kinds[list(MARKS.encode())] = 2
    kinds[[9, 10, 11, 12, 13, 32]] = 3
    return kinds


KINDS = _kinds()
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Ids of texts, in numpy, with the words' ids kept by 64-bit hashes of their bytes.

    Texts are cut where the tokenizer cuts too: at ASCII white space, which it drops, and between ASCII letters and
    marks. ASCII letters are lower-cased, as it does. Each distinct word of a batch is looked up once. Words not seen
    yet are encoded together, as one text, and told apart by the ids that end words; what isn't
    all letters or all marks is encoded by itself. A text with special tokens is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has."""
        texts = [w.decode() for w in words]
        plain, rest = [], []
        for i, t in enumerate(texts):
            if not t.isascii():
                t = texts[i] = "".join(map(str.lower, t)) if t.isalpha() and is_normalized("NFC", t) else t  # one by one: no final sigma
            (plain if t.isalpha() and (t.isascii() or is_normalized("NFC", t)) else rest).append(i)
        parts: list[np.ndarray | None] = [None] * len(words)
        if plain:
            ids = self.whole([" ".join(texts[i] for i in plain)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(plain):
                raise ValueError("the tokenizer splits words in another way")
            for i, x in zip(plain, np.split(ids, stops[:-1]), strict=True):
                parts[i] = x
        for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            parts[i] = x
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def batch(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        data = LOWERED[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        kind = np.r_[np.int8(3), KINDS[data]]
        before, here = kind[:-1], kind[1:]
        first = np.flatnonzero((here != 3) & ((before == 3) | ((before == 1) & (here == 2)) | ((before == 2) & (here == 1))))
        ends = np.flatnonzero((before != 3) & ((here == 3) | ((before == 1) & (here == 2)) | ((before == 2) & (here == 1))))
        hashes = ranges(prefixes(data), first, ends)
        names, at, own = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, names)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == names[known]
        starts, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        starts[known], sizes[known] = self.starts[place[known]], self.sizes[place[known]]
        pool = self.pool
        fresh = np.flatnonzero(~known)
        if len(fresh):
            flat = data.tobytes()
            ids, counts = self._new([flat[i:j] for i, j in zip(first[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)])
            sizes[fresh] = counts
            if len(self.keys) < CACHE:
                starts[fresh] = np.cumsum(counts) - counts + len(pool)
                self.pool = pool = np.concatenate([pool, ids])
                self.keys = np.insert(self.keys, place[fresh], names[fresh])
                self.starts = np.insert(self.starts, place[fresh], starts[fresh])
                self.sizes = np.insert(self.sizes, place[fresh], counts)
            else:  # this batch's own pool
                kept = np.flatnonzero(known)
                starts[fresh] = np.cumsum(counts) - counts
                moved = _ragged(starts[kept], sizes[kept])
                pool = np.concatenate([ids, pool[moved]])
                starts[kept] = len(ids) + np.cumsum(sizes[kept]) - sizes[kept]
        ids = pool[_ragged(starts[own], sizes[own])]
        # Words of each text, then ids of each text.
        text_ends = np.cumsum([len(r) + 1 for r in raws])
        words = np.searchsorted(first, text_ends)
        cuts = np.r_[0, np.cumsum(sizes[own])][words]
        return np.split(ids, cuts[:-1])

    def ids(self, raws: list[bytes]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in raws]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), x in zip(held, self.batch([r for _, r in held]), strict=True):
                out[i].append(x)
            held.clear()

        for i, raw in enumerate(raws):
            if b"<|" in raw:
                out[i] = self.whole([raw.decode()])
                continue
            for part in _cut(raw):
                held.append((i, part))
                size += len(part)
                if size > PART:
                    flush()
                    size = 0
        if held:
            flush()
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in out]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, data = [], []
                for i, ids in enumerate(own_encoder.ids([x or b"" for x in part.column("raw").to_pylist()])):
                    ids = np.r_[ids, np.uint32(END_ID)].astype("<u4")
                    for k in range(-(-len(ids) // length)):
                        own = ids[k * length : (k + 1) * length]
                        rows.append((i, k, k * length, len(own), zlib.crc32(own)))
                        if keep_ids:
                            data.append(own.astype(np.int32))
                r = np.array(rows, np.int64).reshape(len(rows), 5)
                columns = [part.column("doc_id").take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32)), *(pa.array(r[:, c]) for c in (2, 3, 4))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(data, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, out)


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset): best-fit decreasing over counts.

    Sequences that are equally full form a class, held as runs of sequence numbers. Pieces of a
    length go to the fullest class that still has room for them; as they fill a sequence further, its next
    best fit among equally long pieces is the same one again, so each sequence takes as many as fit.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    classes: dict[int, list[list[int]]] = {}  # room left: runs [first sequence, how many]
    rooms: list[int] = []  # keys of classes, ascending
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                classes[room] = []
                bisect.insort(rooms, room)
            classes[room].append([first, n])

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room = capacity
                need = -(-left // (room // size))
                first, have = made, need
                made += need
            else:
                room = rooms[at]
                first, have = classes[room][-1]
            each = room // size
            full = min(have, left // each)
            rest = left - full * each if full < have else 0
            rest = min(rest, each - 1)
            for j in range(each if full else 0):
                slots.append((size, rank, full, first, capacity - room + j * size))
                rank += full
            for j in range(rest):
                slots.append((size, rank, 1, first + full, capacity - room + j * size))
                rank += 1
            used = full + (rest > 0)
            left -= full * each + rest
            if at < len(rooms):
                if used == have:
                    classes[room].pop()
                    if not classes[room]:
                        del classes[room]
                        del rooms[at]
                else:
                    classes[room][-1] = [first + used, have - used]
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
    return slots


def ranked(parts: DataFrame, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """With rank, from 0, among the pieces of the same length."""
    buckets = max(16, -(-total // bucket_rows))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    firsts = parts.groupBy("length", "bucket").count()
    firsts = firsts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    joined = parts.withColumn("own", own).join(firsts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("rank", F.col("own") + F.col("first")).drop("l", "b", "first", "own", "bucket")


def place(parts: DataFrame, slots: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> DataFrame:
    """With sequence_id and offset; rank goes."""
    bases, total = {}, 0
    for size in sorted(counts, reverse=True):
        bases[size], total = total, total + counts[size]
    table_ = np.array([(bases[s] + r, q, o) for s, r, _, q, o in slots], np.int64).reshape(len(slots), 3)
    held = parts.sparkSession.sparkContext.broadcast((bases, table_[np.argsort(table_[:, 0], kind="stable")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, slot = held.value
        for batch in batches:
            g = np.array([base[x] for x in batch.column("length").to_pylist()], np.int64) + batch.column("rank").to_numpy()
            at = np.searchsorted(slot[:, 0], g, "right") - 1
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(slot[at, 1] + g - slot[at, 0]), pa.array(slot[at, 2])], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "rank")
    return parts.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of each piece."""
    parts = durable(pieces(docs, tokenizer, length, keep_ids))
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # a row for each length: bounded by the sequence
    return place(ranked(parts, sum(counts.values())), plan(counts, length), counts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id"), default_tokenizer())


QUERIES = {"op10_best_fit": op10_best_fit}
