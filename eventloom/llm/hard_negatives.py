"""Hard negatives by bounds along a spanning tree of anchors.

Every anchor is scored against all rows, by inner products of integer vectors.  Anchors are dealt
to groups of bounded size, rows to blocks, and a task holds one group while a block's rows stream
by.  Inside a group the anchors are the nodes of a minimum spanning tree: a row's score at a node
lies within the score at the parent plus or minus the edge's length times the row's norm
(Cauchy-Schwarz), so a row is scored again only where that interval meets what is still looked
for there; elsewhere the interval itself is handed on to the children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventloom import ranges
from eventloom.llm.arrow import release
from eventloom.runtime import ship, written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between so many hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a group, rows that are bounded at once, rows of a block at most.
GROUP, SLICE, BLOCK = 512, 2048, 4_000_000
#: Squared norms from which on scores might not fit a long.
_TOO_LONG = float(1 << 62)
#: Up to here sums of products are exact in doubles.
_EXACT = float(1 << 53)

_ROW = "uid long, vec_id long, label long, q array<long>"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (uid, vec_id, label, q) that take part, as a written table.

    vectors: vec_id, label, q (array of long).  Left out: rows without vec_id (no result could
    name them), label or vector, with a null in it, or with a squared norm of 2**62 or more.
    """
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull()
    rows = vectors.filter(whole & F.forall("q", lambda x: x.isNotNull()) & (square < _TOO_LONG))
    typed = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q"))
    return written(typed, "vectors")


def _grouped(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``anchors`` with ``part``: groups of about ``size`` of one label and a near projection; their number."""
    signed = F.aggregate(F.transform("q", lambda x, i: F.when(F.xxhash64(i) % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    near = F.least(F.greatest(signed, F.lit(-(2.0**30))), F.lit(2.0**30)).cast("long")
    keyed = anchors.withColumn("_key", F.col("label").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(1 << 31) + near)
    lower = ranges.bounds(keyed, "_key", -(-keyed.count() // size))
    # many anchors may have one key: those of a range are dealt on by hash
    ranged = written(keyed.withColumn("_b", ranges.bucket(F.col("_key"), lower)).drop("_key"), "anchor-ranges")
    cuts = ranged.groupBy("_b").agg(F.ceil(F.count("*") / F.lit(size)).alias("_k")).withColumn("_end", F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = written(cuts, "anchor-groups")
    n = cuts.agg(F.max("_end")).first()[0] or 0
    part = F.col("_end") - F.col("_k") + F.pmod(F.xxhash64("uid"), F.col("_k"))
    return ranged.join(F.broadcast(cuts), "_b").withColumn("part", part.cast("int")).drop("_b", "_k", "_end"), n


class _Group:
    """Anchors of one task: their vectors, and for each set of them a spanning tree."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.uid, self.vec_id, self.label = (table[c].to_numpy().astype(np.int64) for c in ("uid", "vec_id", "label"))
        self.q = _matrix(table["q"].combine_chunks())
        self.windows = [np.array([_window(s) for s in w or []], np.int64).reshape(-1, 2) for w in table["found"].to_pylist()]
        self.norm = np.sqrt((self.q.astype(float) ** 2).sum(axis=1))

    def tree(self, members: np.ndarray) -> list[tuple[int, int, float]]:
        """(node, parent or -1, length of the edge) in an order where parents come first."""
        points = self.q[members].astype(float)
        left = np.ones(len(members), bool)
        near, via = np.full(len(members), np.inf), np.full(len(members), -1)
        order = []
        for _ in members:
            at = int(np.argmin(np.where(left, near, np.inf))) if order else 0
            if not left[at]:  # only infinite distances are left
                at = int(np.argmax(left))
            left[at] = False
            order.append((int(members[at]), int(members[via[at]]) if via[at] >= 0 else -1, float(near[at]) if via[at] >= 0 else 0.0))
            away = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
            closer = left & (away < near)
            near[closer], via[closer] = away[closer], at
        return order


def _window(score: int) -> tuple[int, int]:
    """Integer scores between LOW and HIGH hundredths of a positive's score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers; vectors that are shorter than the longest one are filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class _Best:
    """Of the rows seen so far, those that are among the first ``most`` in one of an anchor's windows."""

    def __init__(self, windows: np.ndarray, most: int):
        self.windows, self.most = windows, most
        self.least = windows[:, 0].astype(float)  # a row with a lower score isn't needed in this window
        self.score, self.vec_id, self.uid = (np.zeros(0, np.int64) for _ in range(3))

    def wanted(self, low: np.ndarray, high: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Of the rows that may be taken (``able``), those whose score between low and high may be among the first."""
        hit = np.zeros(len(low), bool)
        for (_, top), least in zip(self.windows, self.least):
            if least > top:
                continue
            here = able & (high >= least) & (low <= top)
            sure = here & (low >= least) & (high <= top)
            if np.count_nonzero(sure) > self.most:  # so many are at least as high as the last of these
                here &= high >= np.partition(low[sure], -self.most)[-self.most]
            hit |= here
        return hit

    def add(self, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        score, vec_id, uid = (np.concatenate(x) for x in ((self.score, score), (self.vec_id, vec_id), (self.uid, uid)))
        order = np.lexsort((uid, vec_id, -score))
        score, vec_id, uid = score[order], vec_id[order], uid[order]
        keep = np.zeros(len(score), bool)
        for i, (low, top) in enumerate(self.windows):
            first = np.flatnonzero((score >= low) & (score <= top))[: self.most]
            keep[first] = True
            if len(first) == self.most:
                self.least[i] = max(low, score[first[-1]])
        self.score, self.vec_id, self.uid = score[keep], vec_id[keep], uid[keep]


def _scored(group: _Group, trees: list, best: dict[int, _Best], same: bool, part: pa.RecordBatch) -> int:
    """Take a slice of rows into the anchors' bests; the number of scores that were computed."""
    uid, vec_id, label = (part.column(c).to_numpy().astype(np.int64) for c in ("uid", "vec_id", "label"))
    q = _matrix(part.column("q"), group.q.shape[1])
    anchors = group.q if group.q.shape[1] == q.shape[1] else np.pad(group.q, ((0, 0), (0, q.shape[1] - group.q.shape[1])))
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    exact = norm.max(initial=0.0) * group.norm.max(initial=0.0) < _EXACT
    rows, points = (q.astype(float), anchors.astype(float)) if exact else (q, anchors)
    computed = 0
    for its_label, order in trees:
        some = label == its_label if same else np.ones(len(label), bool)
        if not some.any():
            continue
        mine = rows if some.all() else rows[some]
        uids, ids, labels, norms = uid[some], vec_id[some], label[some], norm[some]
        low, high = {}, {}
        for node, parent, edge in order:
            if parent < 0:
                low[node], high[node] = np.full(len(uids), -np.inf), np.full(len(uids), np.inf)
            else:
                away = edge * norms * (1 + 1e-9) + 1
                low[node], high[node] = low[parent] - away, high[parent] + away
            able = uids != group.uid[node] if same else labels != group.label[node]
            hit = np.ones(len(uids), bool) if parent < 0 else best[node].wanted(low[node], high[node], able)
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            score = (mine[at] @ points[node]).astype(np.int64)
            computed += len(at)
            low[node][at] = score - np.abs(score) * 1e-15
            high[node][at] = score + np.abs(score) * 1e-15
            may = able[at]
            best[node].add(score[may], ids[at][may], uids[at][may])
    return computed


def _search(same: bool, most: int):
    """A cell's rows (anchors first) to each anchor's best rows: of its own label, or of others within its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, group, trees, best = [], None, [], {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                anchors.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            if group is None:
                if not anchors:
                    return
                group = _Group(anchors)
                every = np.arange(len(group.uid))
                sets = [every[group.label == x] for x in np.unique(group.label)] if same else [every]
                trees = [(int(group.label[m[0]]), group.tree(m)) for m in sets]
                whole = np.array([[np.iinfo(np.int64).min, np.iinfo(np.int64).max]])
                best = {i: _Best(whole if same else group.windows[i], most) for i in every}
            for a in range(cut, batch.num_rows, SLICE):
                _scored(group, trees, best, same, batch.slice(a, min(SLICE, batch.num_rows - a)))
        release()
        if group is None:
            return
        sizes = [len(best[i].uid) for i in range(len(group.uid))]
        joined = lambda f: np.concatenate([getattr(best[i], f) for i in range(len(group.uid))])
        columns = [np.repeat(group.uid, sizes), np.repeat(group.vec_id, sizes), joined("uid"), joined("vec_id"), joined("score")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "anchor_id", "uid", "vec_id", "score"])

    return run


def _grid(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, same: bool, most: int) -> DataFrame:
    """(anchor, anchor_id, uid, vec_id, score): each group of ``anchors`` (with ``part`` and ``found``) against each block of ``rows``."""
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<long>")
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    right = rows.select("*", none.alias("found"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), block.alias("block"), F.lit(1).alias("kind"))
    cell = (F.col("part") * blocks + F.col("block")).cast("int")
    dealt = left.unionByName(right).repartitionById(groups * blocks, cell).sortWithinPartitions("kind")
    found = dealt.select("uid", "vec_id", "label", "q", "found", "kind").mapInArrow(_search(same, most), "anchor long, anchor_id long, uid long, vec_id long, score long")
    return found


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label, q (integer vectors; see ``usable`` for rows that take no part; shorter
    ones count as filled with zeros).  Anchors are rows whose vec_id ``every`` divides.  Higher
    scores come first, ties by smaller vec_id.  An anchor's positives are its first rows of the
    same label, itself left out; for each of them the first rows of other labels follow that
    score between LOW and HIGH hundredths of it.  Repeated rows count one by one, a repeated
    vec_id too; negative positive scores give no row; no anchors give an empty table; other
    columns aren't looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select("vec_id", "label", "q"))
    anchors, groups = _grouped(rows.filter(F.col("vec_id") % every == 0), group)
    none = F.lit(None).cast("array<long>")
    n, tasks = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, groups)
    blocks = max(1, -(-n // BLOCK), -(-tasks // groups))
    anchors = written(anchors, "anchors")
    near = _grid(rows, anchors.withColumn("found", none), groups, blocks, True, positives)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "uid"))
    firsts = written(near.withColumn("_i", place("anchor")).filter(F.col("_i") <= positives), "positives").withColumnRenamed("_i", "place")
    held = firsts.groupBy("anchor").agg(F.collect_set("score").alias("found")).withColumnRenamed("anchor", "uid")
    far = _grid(rows, anchors.join(held, "uid").select(*anchors.columns, "found"), groups, blocks, False, negatives)
    pairs = firsts.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ps, ns = F.col("positive_score").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")
    met = far.join(pairs, "anchor").filter((ps * LOW <= ns * 100) & (ns * 100 <= ps * HIGH))
    ranked = met.withColumn("rank", place("anchor", "place")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Contract columns of hard negatives of ``embeddings`` (vec_id, embedding, label).

    Null labels, vectors and components and those that aren't finite take no part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return mine(rows.select("vec_id", turned.alias("label"), q.alias("q")))


ORACLE = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
