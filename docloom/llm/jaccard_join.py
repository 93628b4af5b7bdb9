"""Exact n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Their global order is
cut into FRAGMENTS; partial overlaps are counted fragment by fragment and summed per pair.

1. Equal sets are one class. The first FIRST fragments are counted for all classes: where a
   class has more shingles there that no other class has than a linked one may lack in all, it
   links with nothing and is done. Most documents end here, after three eighths of their shingles.
2. The others are cut into all fragments. Candidates share a shingle of their prefixes: of n
   shingles, those n - ceil(t n) + 1 that come first where shingles of the first fragments precede the others
   and rare ones the frequent. Each shingle's list of classes is named after its leader, the class
   whose shingles are most common, and lists of one leader are one group.
3. In a group, partial overlaps are counted in each fragment and summed per pair: the leader's with
   all members, then those of members that it is not linked with. Pairs of members that are both linked with the leader cannot
   change the result, so a group of copies costs one comparison a member, and no link between
   components is lost. Only links that join something leave the group. A large group is dealt in blocks: all members
   once, to be compared with the leader; then only those that aren't linked with it, in blocks against blocks of all members.
4. Links give components.

A shingle that many documents share costs one row per task in step 1, where postings are merged before
the shuffle, and is no candidate for documents that have enough rarer ones. What is counted by shingle or leader is counted with
partial sums and joined back; keys with more than 1 / MOST_HOT of all rows, of which there are fewer than MOST_HOT, are
broadcast for that. The number of partitions grows with the input (PART_BYTES).

Defined results: a null, empty or wordless text has an empty set and is its own component; rows
that repeat a doc_id are judged by their texts; rows without doc_id are compared like all others, but null is never a
component's number unless no row of it has a doc_id. Other columns are ignored. Sets are told apart by 64-bit digests and their sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, durable, partitions_for, stored, table
from docloom.llm.components import components
from docloom.llm.rolling import shingles

N = 5
PERCENT = 75
FRAGMENTS, FIRST = 8, 3
#: Which documents are to be read again is broadcast up to this many bytes and joined by a shuffle beyond it.
MAX_BROADCAST = 64 << 20
#: Bytes of input for each partition.
PART_BYTES = 64 << 20
#: Keys are hot that have more than this part of all rows.
MOST_HOT = 10_000
#: A block of a group has about so many members and shingles at most, and one of members that are compared with the leader only.
BLOCK_MEMBERS, BLOCK_TOKENS, NEAR_MEMBERS = 2048, 2_000_000, 256
#: Documents whose shingles are held at once: in the first pass, where what they share is counted, and in the second.
CLASS_DOCS, FRAGMENT_DOCS = 2000, 500
#: Overlaps are counted over so many shingles at a time.
MATRIX = 2048


def _key(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _postings(hashes: np.ndarray, owner: np.ndarray, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Shingles that several sets of the batch share are counted at once, for each set, and sent without owners;
    the others are sent with theirs. A blob: number of owners, their keys, their counts of shingles, shingles."""
    if not len(hashes):
        return np.zeros(len(keys), np.int64), []
    order = np.argsort(hashes, kind="stable")
    h, own = hashes[order], owner[order]
    first = np.r_[True, h[1:] != h[:-1]]
    many = ~(first & np.r_[first[1:], True])
    counts = np.bincount(own[many], minlength=len(keys))
    keep = first  # one row for each shingle
    h, own = h[keep], np.where(many, len(keys), own)[keep]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((own, bucket))
    h, own, bucket = h[order], own[order], bucket[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)]
    names = np.r_[keys, np.int64(0)]
    out = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        o = own[i:j]
        starts = np.r_[0, np.flatnonzero(np.diff(o)) + 1]
        sizes = np.diff(np.r_[starts, len(o)]).astype("<u4")
        shared = o[starts] == len(keys)
        out.append((int(bucket[i]), b"".join((np.array([len(starts)], "<u4").tobytes(), names[o[starts]].tobytes(), shared.astype(np.uint8).tobytes(), sizes.tobytes(), h[i:j].tobytes()))))
    return counts, out


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    at = 4
    keys = np.frombuffer(blob, np.int64, n, at)
    at += 8 * n
    shared = np.frombuffer(blob, np.uint8, n, at)
    at += n
    sizes = np.frombuffer(blob, "<u4", n, at)
    return np.repeat(keys, sizes), np.repeat(shared, sizes) > 0, np.frombuffer(blob, np.uint64, -1, at + 4 * n)


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """Rows with doc_id, t (hash of the text), key, n and first (shingles in the first fragments), and rows with key and shared, which
    sum up to those of the first fragments that other sets have too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = partitions_for(docs, "text", PART_BYTES)
    limit = np.uint64(FIRST * (2**64 // FRAGMENTS))
    schema = f"bucket int, doc_id {kind}, t bigint, key bigint, n int, first int, shared int, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CLASS_DOCS):
                batch = whole.slice(at, CLASS_DOCS)
                keys, sizes, firsts, seen, lists = [], [], [], {}, []
                for raw in batch.column("raw").to_pylist():
                    own = shingles((raw or b"").lower(), n)
                    head = own[: int(np.searchsorted(own, limit))]
                    keys.append(_key(own))
                    sizes.append(len(own))
                    firsts.append(len(head))
                    if len(own) and (keys[-1], sizes[-1]) not in seen:
                        seen[keys[-1], sizes[-1]] = len(seen)
                        lists.append(head)
                own_keys = np.array([k for k, _ in seen], np.int64)
                counts, blobs = _postings(np.concatenate(lists) if lists else np.zeros(0, np.uint64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), own_keys, buckets)
                some = np.flatnonzero(counts)
                rows = batch.num_rows
                empty = [None] * rows
                yield _batch(schema_, batch.column("any"), batch.column("doc_id"), batch.column("t"), keys, sizes, firsts, empty, empty)
                if len(some):
                    no = [None] * len(some)
                    yield _batch(schema_, (own_keys[some] % buckets).astype(np.int32), no, no, own_keys[some], no, no, counts[some].astype(np.int32), no)
                if blobs:
                    no = [None] * len(blobs)
                    yield _batch(schema_, [b for b, _ in blobs], no, no, no, no, no, no, [d for _, d in blobs])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            data = batch.column("data")
            plain = batch.filter(data.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns[1:7], names=plain.schema.names[1:7])
            held += [_unpacked(x.as_py()) for x in data.drop_null()]
        if not held:
            return
        keys, shared, h = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(h, kind="stable")
        keys, shared, h = keys[order], shared[order], h[order]
        first = np.r_[True, h[1:] != h[:-1]]
        run = np.cumsum(first) - 1
        # Sets that are equal in several tasks are one.
        least, most = np.full(run[-1] + 1, np.iinfo(np.int64).max), np.full(run[-1] + 1, np.iinfo(np.int64).min)
        own = ~shared
        np.minimum.at(least, run[own], keys[own])
        np.maximum.at(most, run[own], keys[own])
        both = (least < most) | (np.bincount(run[shared], minlength=len(least)) > 0)
        hit = own & both[run]
        pairs = np.unique(np.rec.fromarrays([keys[hit], run[hit]]))
        names, counts = np.unique(pairs["f0"], return_counts=True)
        for i in range(0, len(names), 50_000):
            no = [None] * len(names[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(no, id_type), pa.array(no, pa.int64()), pa.array(names[i : i + 50_000]), pa.array(no, pa.int32()), pa.array(no, pa.int32()), pa.array(counts[i : i + 50_000].astype(np.int32))], names=["doc_id", "t", "key", "n", "first", "shared"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema_ = pa.schema([("bucket", pa.int32()), ("doc_id", id_type), ("t", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("shared", pa.int32()), ("data", pa.binary())])
    any_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")  # rows of documents are in no bucket for a reason
    sent = docs.select("doc_id", text_hash().alias("t"), F.col("text").cast("binary").alias("raw"), any_.alias("any")).mapInArrow(cut, schema)
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(count, f"doc_id {kind}, t bigint, key bigint, n int, first int, shared int")


def text_hash() -> Column:
    """Which text a row has, beside its doc_id."""
    return F.xxhash64("text")


def _batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fragments(docs: DataFrame, n: int) -> DataFrame:
    """key, n, first (shingles in the first fragments), fragment, tokens (as signed numbers): a row for each fragment that has some."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 2**64 // FRAGMENTS
        edges = np.array([i * step for i in range(1, FRAGMENTS)], np.uint64)
        for batch in (whole.slice(at, FRAGMENT_DOCS) for whole in batches for at in range(0, whole.num_rows, FRAGMENT_DOCS)):
            rows = []
            for raw in batch.column("raw").to_pylist():
                own = shingles((raw or b"").lower(), n)
                cuts = [0, *np.searchsorted(own, edges).tolist(), len(own)]
                key = _key(own)
                rows += [(key, len(own), cuts[FIRST], f, own[i:j].view(np.int64)) for f, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "n", "first", "fragment", "tokens"])

    return docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(cut, "key bigint, n int, first int, fragment int, tokens array<bigint>")


def _least_overlap(n: Column, percent: int) -> Column:
    """Of a set of n, what a linked set has too at least: ceil(percent / 100 * n)."""
    return F.floor((n * percent + 99) / 100)


def _overlaps(own: np.ndarray, against: np.ndarray, members: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How many shingles members (by position) share: partial overlaps, summed over the fragments.

    parts: for each fragment, its tokens and their owners' positions.
    """
    total = np.zeros((len(own), len(against)), np.float32)
    row_of, column_of = np.full(members, -1), np.full(members, -1)
    row_of[own], column_of[against] = np.arange(len(own)), np.arange(len(against))
    for tokens, owner in parts:
        mine, theirs = row_of[owner] >= 0, column_of[owner] >= 0
        names = np.intersect1d(tokens[mine], tokens[theirs])
        sides = []
        for side, place in ((mine, row_of), (theirs, column_of)):
            at = np.searchsorted(names, tokens[side])
            known = np.flatnonzero(at < len(names))
            known = known[names[at[known]] == tokens[side][known]]
            sides.append((at[known], place[owner[side][known]]))
        for low in range(0, len(names), MATRIX):
            width = min(MATRIX, len(names) - low)
            pair = []
            for (at, row), size in zip(sides, (len(own), len(against)), strict=True):
                ok = (at >= low) & (at < low + width)
                matrix = np.zeros((size, width), np.float32)
                matrix[row[ok], at[ok] - low] = 1
                pair.append(matrix)
            total += pair[0] @ pair[1].T
    return total


def _linked(own: np.ndarray, against: np.ndarray, sizes: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], percent: int) -> np.ndarray:
    overlap = _overlaps(own, against, len(sizes), parts)
    return 100 * overlap >= percent * (sizes[own][:, None] + sizes[against][None, :] - overlap)


def _joining(sizes: np.ndarray, rows: np.ndarray, columns: np.ndarray, inside: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (positions) of rows with columns that join components; those inside (a mask) are joined already."""
    out = []
    root = np.arange(len(sizes))
    if inside.any():
        root[inside] = np.flatnonzero(inside)[0]
    step = max(1, 1_000_000 // max(len(columns), 1))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        for i, j in zip(*np.nonzero(_linked(own, columns, sizes, parts, percent)), strict=True):
            x, y = int(own[i]), int(columns[j])
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[x]] = root[y]
    return out


class _Block:
    """The classes of a group or block, and the shingles of their fragments by position."""

    def __init__(self, block: pa.Table) -> None:
        column = lambda c: block.column(c).to_numpy()
        self.keys, first, owner = np.unique(column("key"), return_index=True, return_inverse=True)
        self.sizes, self.side, self.leader = column("n")[first].astype(np.float64), column("side")[first], column("leader")[0]
        lists = block.column("tokens").combine_chunks()
        tokens, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        own, fragment = np.repeat(owner, ends), np.repeat(column("fragment"), ends)
        self.parts = [(tokens[fragment == f], own[fragment == f]) for f in np.unique(fragment)]

    def near(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The others' positions, and whether the leader is linked with them."""
        one = np.searchsorted(self.keys, self.leader)
        others = np.flatnonzero(np.arange(len(self.keys)) != one)
        return others, _linked(np.array([one]), others, self.sizes, self.parts, percent)[0]

    def named(self, links: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"a": pa.array([self.keys[x] for x, _ in links], pa.int64()), "b": pa.array([self.keys[y] for _, y in links], pa.int64())})


def _hot_join(rows: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """Inner join with a durable table that has one row for each key and in its column rows how often rows has that key."""
    total = side.agg(F.sum("rows")).first()[0] or 0
    hot = side.filter(F.col("rows") * MOST_HOT > total)
    if hot.isEmpty():
        return rows.join(side, on)
    hot = F.broadcast(hot)
    cold = side.filter(F.col("rows") * MOST_HOT <= total)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))


def links(members: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """a, b: keys of links that join all that links within groups (leader, key, n) join."""
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int")
    sizes = durable(members.groupBy("leader").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("rows")))
    groups = _hot_join(members, sizes, "leader").select("leader", "key", "n", "blocks")
    tokens = fragments.select("key", F.col("n"), "fragment", "tokens")

    def whole_group(block: pa.Table) -> pa.Table:
        own = _Block(block)
        others, near = own.near(percent)
        leader, inside = int(np.searchsorted(own.keys, own.leader)), np.zeros(len(own.keys), bool)
        inside[others[near]] = inside[leader] = True
        found = _joining(own.sizes, others[~near], others, inside, own.parts, percent)
        return own.named([(leader, int(y)) for y in others[near]] + found)

    small = groups.filter("blocks = 1").select("leader", "key")
    small = small.unionByName(sizes.filter("blocks = 1").select("leader", F.col("leader").alias("key"))).withColumn("side", F.lit(0))
    out = small.join(tokens, "key").groupBy("leader").applyInArrow(whole_group, "a bigint, b bigint")
    if sizes.filter("blocks > 1").isEmpty():
        return out.distinct()

    def with_leader(block: pa.Table) -> pa.Table:
        own = _Block(block)
        others, near = own.near(percent)
        return pa.table({"leader": pa.array([own.leader] * len(others), pa.int64()), "key": pa.array(own.keys[others], pa.int64()), "near": pa.array(near, pa.bool_())})

    large = sizes.filter("blocks > 1").withColumn("parts", F.ceil(F.greatest(F.col("rows") / NEAR_MEMBERS, F.col("blocks"))).cast("int"))
    dealt = _hot_join(members, durable(large), "leader")
    dealt = dealt.select("leader", "key", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("i"))
    each = dealt.select("leader", F.col("leader").alias("key"), "i").distinct()
    told = durable(dealt.unionByName(each).withColumn("side", F.lit(0)).join(tokens, "key").groupBy("leader", "i").applyInArrow(with_leader, "leader bigint, key bigint, near boolean"))
    out = out.unionByName(told.filter("near").select(F.col("leader").alias("a"), F.col("key").alias("b")))
    far = told.filter("not near").groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("rows_in"), F.count(F.lit(1)).alias("rows"))
    far = durable(far.join(sizes.select("leader", "blocks"), "leader"))
    if far.isEmpty():
        return out.distinct()

    def against_all(block: pa.Table) -> pa.Table:
        own = _Block(block)
        return own.named(_joining(own.sizes, np.flatnonzero(own.side & 1), np.flatnonzero(own.side & 2), own.side & 4 > 0, own.parts, percent))

    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = _hot_join(told, far, "leader")
    rows = placed.filter("not near").select("leader", "key", at("rows_in").alias("i"), every("blocks").alias("j"), F.lit(1).alias("side"))
    columns = placed.select("leader", "key", every("rows_in").alias("i"), at("blocks").alias("j"), F.when(F.col("near"), 6).otherwise(2).alias("side"))
    both = rows.unionByName(columns).groupBy("leader", "i", "j", "key").agg(F.bit_or("side").alias("side"))
    return out.unionByName(both.join(tokens, "key").groupBy("leader", "i", "j").applyInArrow(against_all, "a bigint, b bigint")).distinct()


def _prefixes(fragments: DataFrame, percent: int) -> DataFrame:
    """token, key, n, common: the shingles of the prefixes that more than one class has.

    Shingles that no other class has come first among those of the first fragments, and among the others; only their number matters.
    """
    need = F.col("n") - _least_overlap(F.col("n"), percent) + 1
    late = (F.col("fragment") >= FIRST).cast("int")
    used = fragments.filter((late == 0) | (F.col("first") < need)).select("key", "n", "first", late.alias("late"), F.explode("tokens").alias("token"))
    counts = durable(used.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    own = Window.partitionBy("key")
    shared = _hot_join(used, counts, "token").withColumn("shared", F.count(F.lit(1)).over(own)).withColumn("early", F.sum(1 - F.col("late")).over(own)).withColumn("sum", F.sum("rows").over(own))
    every = F.when(F.col("first") < need, F.col("n")).otherwise(F.col("first"))
    before = F.when(F.col("late") == 0, F.col("first") - F.col("early")).otherwise(F.col("n") - F.col("shared") + F.col("early"))
    place = before + F.row_number().over(Window.partitionBy("key", "late").orderBy("rows", "token"))
    common = (F.col("sum") + every - F.col("shared")) / every
    return shared.withColumn("place", place).filter(F.col("place") <= need).select("token", "key", "n", common.alias("common"))


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles, component_id, and stays: whether the row is the first of its component (smallest doc_id, then hash of the text)."""
    rows = stored(_classes(docs, n))
    of_docs = rows.filter(F.col("n").isNotNull()).select("doc_id", "t", "key", "n", "first")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")
    classes = durable(rows.groupBy("key").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.sum("shared").alias("shared"), F.min(F.when(F.col("n").isNotNull(), order)).alias("rep")).filter("n > 0"))
    open_ = classes.filter(F.col("first") - F.coalesce("shared", F.lit(0)) <= F.col("n") - _least_overlap(F.col("n"), percent)).select(F.col("rep.doc_id").alias("__id"), F.col("rep.t").alias("__t"))
    size = open_.agg(F.sum(F.coalesce(F.octet_length(F.col("__id").cast("string")), F.lit(0)) + 48)).first()[0] or 0
    if size <= MAX_BROADCAST:
        open_ = F.broadcast(open_)
    of_open = lambda df: F.col("doc_id").eqNullSafe(F.col("__id")) & (df["t"] == F.col("__t"))
    twice = of_docs.join(open_, of_open(of_docs), "left_semi").groupBy("doc_id", "t").count().filter("count > 1")
    repeats = not twice.isEmpty()
    texts = docs.select("doc_id", text_hash().alias("t"), "text")
    fragments = _fragments(texts.join(open_, of_open(texts), "left_semi"), n)
    fragments = stored(fragments.dropDuplicates(["key", "n", "fragment"]) if repeats else fragments)
    prefixes = durable(_prefixes(fragments, percent))
    leaders = durable(prefixes.groupBy("token").agg(F.max(F.struct("common", "n", "key"))["key"].alias("leader"), F.count(F.lit(1)).alias("rows")))
    members = durable(_hot_join(prefixes, leaders, "token").filter("key <> leader").select("leader", "key", "n").distinct())
    final = components(links(members, fragments, percent))
    discard(fragments)  # the components are checkpointed
    reps = classes.join(final, classes["key"] == final["node"], "left").select("key", "n", "rep", F.coalesce("root", "key").alias("root"))
    lowest = reps.groupBy("root").agg(F.min("rep").alias("lowest"))
    named = reps.join(lowest, "root").select("key", "n", "lowest")
    out = of_docs.join(named, ["key", "n"], "left")
    stays = F.col("lowest").isNull() | F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("t") == F.col("lowest.t"))
    out = durable(out.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), F.coalesce("lowest.doc_id", "doc_id").alias("component_id"), stays.alias("stays")))
    discard(rows)
    return out


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) for each row."""
    return _joined(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component: the smallest doc_id, of equal ones the smallest hash of the text.

    A row without doc_id stays where no linked one has a doc_id and it has the smallest hash; repeated rows stay once, and so do those without words.
    """
    stay = _joined(docs, n, percent).filter("stays").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]) & (F.xxhash64(docs["text"]) == stay["__t"]), "left_semi")
    if stay.groupBy("__id", "__t").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")


def op6_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents", "doc_id"))


QUERIES = {"op6_vertical_jaccard": op6_vertical_jaccard}
