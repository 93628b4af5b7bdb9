"""Quality rules, then an isolation forest on the statistics they are made of.

Each text gives a few counts; fixed rules on them reject outright. What passes is scored by
an isolation forest: random splits of the statistics isolate unusual documents on short
paths. The forest is fitted on labelled good documents. The score beyond which a document goes is the one with
the best balance of errors on the labelled ones (the share of bad ones that stay plus the share of good ones that
go), among those at which at least KEEP of the good ones stay; without bad ones, at least KEEP_ALONE stay.

The forest and its threshold come from at most MAX_LABELLED labelled documents (those with the smallest
hashes of doc_id, a bound that does not grow with the corpus; of rows that share a doc_id the one with the
smallest statistics); only their statistics reach the driver. Statistics and scores cover every document and the whole of its text, one pass, no shuffle.

Defined results: a null or empty text has no words and fails; without labelled good
documents nothing but the rules rejects; where a document is labelled several times the
lowest quality counts; repeated rows are judged alike. n_repeat_words compares 64-bit hashes of windows.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

MAX_LABELLED = 20_000
KEEP, KEEP_ALONE = 0.99, 0.999
TREES, SAMPLE, DEPTH = 100, 256, 10
WINDOW = 8
#: Rows whose texts are held in Python at once.
BATCH = 1000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Odd, so that its powers never vanish.
MIX = 0x9E3779B97F4A7C15

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text holds more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(MIX) + ids[k : k + n]
    if len(set(h.tolist())) == n:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return int((np.cumsum(hit) > 0).sum())


def statistics(raw: bytes | None) -> tuple:
    """COUNTS, then upper-case ASCII letters, lines with words, sentence ends and words equal to the one before, of a UTF-8 text."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - sum(map(raw.count, (bytes([c]) for c in SPACES)))
    if not raw.isascii():
        chars -= int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum())
    symbols = sum(map(raw.count, (bytes([c]) for c in SYMBOLS)))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated_words(words), upper, len(lines), raw.count(b".") + raw.count(b"!") + raw.count(b"?"), sum(map(operator.eq, words, words[1:]))


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])


def features(s: np.ndarray) -> np.ndarray:
    """Rates that do not depend on length, from rows of statistics()."""
    s = s.astype(float)
    n, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 6], 1)
    rates = np.stack([s[:, 2] / n, s[:, 3] / lines, s[:, 4] / n, s[:, 5] / np.maximum(s[:, 1], 1), s[:, 7] / n, s[:, 8] / n], axis=1)
    return np.column_stack([np.log1p(s[:, 1] / n), np.log1p(50 * rates)])


class Forest:
    """Random splits of the box that labelled rows span, grown on the good ones.

    Splits are drawn over the box and not over the good rows alone, so that a value no good
    row has, of a feature in which they are all alike, soon leaves them. The shorter a row's mean path, the
    more unusual it is.
    """

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.sample, self.depth = min(sample, len(rows)), depth
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], box, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, box: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree: feature (-1 at ends), split value, path length at the ends; node i has 2i+1 and 2i+2 below it."""
        size = 2 ** (self.depth + 1) - 1
        feature, split, path = np.full(size, -1, np.int8), np.zeros(size), np.zeros(size, np.float32)
        todo = [(0, 0, rows, box)]
        while todo:
            at, depth, x, (low, high) = todo.pop()
            open_ = np.flatnonzero(high > low)
            if depth == self.depth or len(x) <= 1 or not len(open_):
                path[at] = depth + _average_path(len(x))
                continue
            f = rng.choice(open_)
            feature[at], split[at] = f, rng.uniform(low[f], high[f])
            left, cut = x[:, f] < split[at], np.eye(len(low), dtype=bool)[f]
            todo += [(2 * at + 1, depth + 1, x[left], (low, np.where(cut, split[at], high))), (2 * at + 2, depth + 1, x[~left], (np.where(cut, split[at], low), high))]
        return feature, split, path

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; unusual rows are near 1."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at].astype(np.int64)
                below = 2 * at + 1 + (rows[every, np.maximum(f, 0)] >= split[at])
                at = np.where(f >= 0, below, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_average_path(self.sample), 1e-9))


def _average_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def threshold(scores: np.ndarray, good: np.ndarray, keep: float = KEEP, alone: float = KEEP_ALONE) -> float:
    """The score beyond which rows go: the best balance of errors at which at least a share keep of the good rows stays.

    Without bad rows, the lowest at which a share alone of the good ones stays. Of equal balances the one that rejects
    fewer good rows is taken, and of scores that reject the same rows the middle of the gap to the next one.
    """
    own, bad = np.sort(scores[good]), np.sort(scores[~good])
    least = max(1, math.ceil((keep if len(bad) else alone) * len(own)))
    cuts = np.unique(scores)
    cuts = cuts[cuts >= own[least - 1]]
    if len(bad):
        lost, missed = len(own) - np.searchsorted(own, cuts, "right"), np.searchsorted(bad, cuts, "right")
        errors = lost * len(bad) + missed * len(own)
        stay = cuts[errors == errors.min()][-1]
    else:
        stay = cuts[0]
    beyond = scores[scores > stay]
    return float((stay + min([*beyond.tolist(), stay + 0.02])) / 2)


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "quality", "s"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "quality", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, quality int, s array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep: float = KEEP) -> tuple[Forest, float] | None:
    """The forest and the score beyond which documents go; None without labelled good documents."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    measured = _measured(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"))
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("quality", "s")).alias("x")).select("x.*").collect()
    if not rows:
        return None
    s, good = np.array([r["s"] for r in rows]), np.array([r["quality"] for r in rows]) > 0
    order = np.lexsort((*s.T, good))  # rows come in any order; the forest must not depend on it
    s, good = s[order], good[order]
    passed = ~base_failed(s)
    s, good = s[passed], good[passed]
    if not good.any():
        return None
    forest = Forest(features(s[good]), np.stack([features(s).min(0), features(s).max(0)]))
    return forest, threshold(forest.score(features(s)), good, keep)


def judge(raws: list[bytes | None], model: tuple[Forest, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, base_failed, score and kept of texts."""
    s = np.array([statistics(x) for x in raws], np.int64).reshape(len(raws), 9)
    failed = base_failed(s)
    score = model[0].score(features(s)) if model else np.zeros(len(s))
    return s, failed, score, ~failed & (score <= (model[1] if model else 1.0))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, BATCH at a time."""
    for whole in batches:
        yield from (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the forest's score for each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            s, failed, score, kept = judge(batch.column("raw").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that neither the rules nor the forest reject."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            raws = [None if x is None else x.encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(judge(raws, model.value)[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_isolation_forest": op4_isolation_forest}
