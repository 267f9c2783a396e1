"""Quality rules: an isolation forest over rule statistics.

One pass over whole texts gives the rule statistics of each document.  Random splits isolate
a document in few steps when its statistics are unusual; the mean path length over the trees
becomes an anomaly score between 0 and 1.  The forest is grown on a bounded sample of the
documents that are labelled good; the score's threshold is calibrated on all labelled
documents, by a histogram of their scores.  Documents that fail the base rules are never kept.

A split is drawn from the range of the rows in its node widened by a margin on both sides, on
the scale that the statistic has over all labelled rows.  A cut in the margin leaves one side
without rows: what lies beyond the rows that the tree knows is isolated there, after the
splits that led to it, sooner the further it lies out.  Without the margin a document beyond
the range would take the path of the outermost known row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm.arrow import slices, strings
from eventloom.runtime import ship, written

#: Labelled good rows that the forest is grown on, at most (the first by a hash of doc_id and statistics).
FIT_ROWS = 12_000
TREES, SUBSAMPLE = 200, 256
#: Width of the margin of a split in standard deviations; levels of a tree beyond those that halving its rows needs.
MARGIN, MORE_LEVELS = 2.0, 4
#: Rates are compared by the logarithm of 1 + STRETCH times the rate.
STRETCH = 50.0
SEED = 11
LEAST_WORDS = 50
#: Good labelled rows that calibration may lose at most, as a share.
MOST_LOST = 0.01
#: Bins of the scores' histogram: a power of two, so that no score changes its side of an edge.
BINS = 1 << 14
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_upper", "n_letters", "n_marks", "n_digits", "n_lines", "n_distinct")
_UPPER = bytes(range(65, 91))
#: Columns of ``features``.
_FEATURES = 8
_MARKS = b"!?;:()[]{}=_~^\\/\"+"


def repeat_words(words: list) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more (first included), and distinct words."""
    index: dict = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    k, n = len(index), len(words) - 2
    if n < 2:
        return 0, k
    if k <= 1 << 21:
        keys = (codes[:-2] * k + codes[1:-1]) * k + codes[2:]
    else:  # pairs are numbered first, so that keys stay within 63 bits
        pairs = np.unique(codes[:-1] * k + codes[1:], return_inverse=True)[1]
        keys = pairs[:-1] * k + codes[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum()), k


def statistics(text: str) -> tuple[int, ...]:
    """The rule statistics of one whole text, in the order of _STATISTICS and _MORE."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = text.split("\n")
    worded = [x for x in lines if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    covered, distinct = repeat_words(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    upper = count(_UPPER)
    return (
        len(words), len(text) - spaces, count(_SYMBOLS), len(worded) - len(set(worded)), covered,
        upper, upper + count(bytes(range(97, 123))), count(_MARKS), count(b"0123456789"), len(worded), distinct,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = np.array([statistics(t) for t in strings(batch.column("text"))], np.int64).reshape(-1, 11)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(rows[:, i]) for i in range(11)], names=[*names, *_STATISTICS, *_MORE]
        )


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the rule statistics (long) of every row; null counts as empty."""
    ship(docs.sparkSession)
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"{s} long" for s in (*_STATISTICS, *_MORE)]
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(_measure, ", ".join(fields))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(x: np.ndarray) -> np.ndarray:
    """Rule statistics (rows of _STATISTICS and _MORE) to what the trees split: word length, logarithms of rates, variety."""
    w = np.maximum(x[:, 0], 1).astype(float)
    chars = np.maximum(x[:, 1], 1).astype(float)
    rates = np.column_stack([
        x[:, 2] / w, x[:, 3] / np.maximum(x[:, 9], 1), x[:, 4] / w,
        x[:, 5] / np.maximum(x[:, 6], 1), x[:, 7] / w, x[:, 8] / chars,
    ])
    return np.column_stack([x[:, 1] / w, np.log1p(STRETCH * rates), np.log1p(x[:, 10]) - np.log1p(x[:, 0])])


def _norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), cut, children, path length at leaves.

    ``scale``: a width for each feature (of the rows' own spread if it isn't given); a split is
    drawn from the node's range and ``MARGIN`` widths on both sides.
    """

    def __init__(self, x: np.ndarray, scale: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.margin = MARGIN * np.maximum(x.std(axis=0) if scale is None else scale, 1e-9)
        depth = int(np.ceil(np.log2(max(self.size, 2)))) + MORE_LEVELS
        self.trees = [self._grow(x[draw.choice(len(x), self.size, replace=False)], depth, draw) for _ in range(trees)]

    def _grow(self, x: np.ndarray, depth: int, draw) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            k = len(feature)
            for values, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (length, level + _norm(len(rows)))):
                values.append(v)
            if level >= depth or len(rows) < 2:
                return k
            f = int(draw.integers(x.shape[1]))
            c = float(draw.uniform(rows[:, f].min() - self.margin[f], rows[:, f].max() + self.margin[f]))
            below = rows[:, f] < c
            feature[k], cut[k] = f, c
            left[k] = node(rows[below], level + 1)
            right[k] = node(rows[~below], level + 1)
            return k

        node(x, 0)
        return (np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(length))

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over the trees."""
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            moving = np.arange(len(x))
            while len(moving):
                f = feature[at[moving]]
                moving = moving[f >= 0]
                f = f[f >= 0]
                if not len(moving):
                    break
                here = at[moving]
                at[moving] = np.where(x[moving, f] < cut[here], left[here], right[here])
            total += length[at]
        return total / len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1: the shorter its paths, the higher."""
        return 2.0 ** (-self.paths(x) / max(_norm(self.size), 1e-9))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in (*_STATISTICS, *_MORE)]).reshape(-1, 11)


def calibrate(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Threshold that catches the most bad rows less lost good ones, losing at most MOST_LOST of the good.

    ``bins`` (ascending) are numbers of score bins, ``good`` and ``bad`` the rows in each; bin b ends with score b / BINS.
    """
    if not good.sum():
        return 1.0
    above = lambda n: 1 - np.cumsum(n) / max(1, n.sum())
    lost = np.round(above(good), 12)
    value = np.where(lost <= MOST_LOST, above(bad) - 10 * lost, -np.inf) if bad.sum() else -1.0 * (lost > MOST_LOST)
    return float(bins[int(value.argmax())]) / BINS


def histogram(known: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score bins of all rows of ``known`` (quality and statistics), ascending, and their good and bad rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(features(_matrix(batch))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(np.ceil(score * BINS).astype(np.int32))], names=["quality", "bin"])

    binned = known.select("quality", *_STATISTICS, *_MORE).mapInArrow(run, f"quality {known.schema['quality'].dataType.simpleString()}, bin int")
    rows = binned.groupBy("bin").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")).orderBy("bin").collect()
    return tuple(np.array([r[c] for r in rows], np.int64) for c in ("bin", "good", "bad"))


def fit(measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Forest | None, float]:
    """Forest from at most ``rows`` good labelled rows that the base rules let through, threshold from all labelled ones.

    A doc_id with several labels has the lowest quality. Labelled documents that stand several
    times count as often in the threshold; the sample's bound holds whatever repeats.
    """
    ship(measured.sparkSession)
    columns = ["doc_id", "quality", *_STATISTICS, *_MORE]
    chosen = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = written(measured.filter(~base_failed()).join(chosen, "doc_id").select(*columns), "labelled-statistics")
    x = [F.col(c) for c in columns]
    good = known.filter("quality > 0")
    share = min(1.0, 2 * rows / max(1, good.count()))  # about twice the rows by hash, of those the first by hash
    place = F.pmod(F.xxhash64(F.lit(SEED), *x), F.lit(1 << 30))
    some = good.filter(place < int(share * (1 << 30))).orderBy(place, *x).limit(rows)
    table = some.toPandas()
    if len(table) < 2:
        return None, 1.0
    forest = Forest(features(table[[*_STATISTICS, *_MORE]].to_numpy()), spread(known))
    return forest, calibrate(*histogram(known, forest))


def spread(known: DataFrame) -> np.ndarray:
    """Standard deviation of each feature over all rows of ``known``, from sums that tasks send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_matrix(batch)) if len(batch) else np.zeros((0, _FEATURES))
            sums = [[float(len(x))], x.sum(axis=0), (x**2).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = known.select(*_STATISTICS, *_MORE).mapInArrow(run, "sums array<double>")
    total = [r.x or 0.0 for r in parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]
    n, first, second = total[0], np.array(total[1 : 1 + _FEATURES]), np.array(total[1 + _FEATURES :])
    return np.round(np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)), 9)  # rounded: sums arrive in any order


def judge(measured: DataFrame, model: tuple[Forest | None, float]) -> DataFrame:
    """``measured`` with base_failed, anomaly (0 to 1) and kept."""
    forest, threshold = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(features(_matrix(batch))) if forest and len(batch) else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "anomaly"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields)
    scored = measured.mapInArrow(run, f"{fields}, anomaly double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold))


def op2(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs``: doc_id, the base statistics, base_failed, kept.

    Null and empty texts have no word and fail the base rules; texts of any length count whole;
    repeated rows stay, rows of equal statistics are judged alike; without labelled good rows every
    row that the base rules let through is kept; an empty table gives no row; other columns,
    whatever their names, are not looked at.
    """
    measured = written(measure(docs, "doc_id"), "statistics")
    return judge(measured, fit(measured, labels)).select("doc_id", *_STATISTICS, "base_failed", "kept", "anomaly")
