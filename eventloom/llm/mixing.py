"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in a seeded random order and cut into blocks: a document is in
the block of ``block_words`` words in which it begins.  A source gives its blocks once for every
whole time that its target holds its size, and for what is left over some blocks of a seeded
permutation: as many as reach the words that are left, the last one in part.  These numbers of
blocks are the exact quotas.

A binary tree deals them to output shards: at every node the vector of blocks left by source is
split between the left and the right shards by an exact multivariate hypergeometric draw, so
each shard gets a random but exact vector and all counts add up.  A shard then owns, of each
source, an interval of places in the permutation (intervals of different shards are disjoint),
draws the blocks at those places, and shuffles its documents locally.  What a document gives to
the mix follows from the blocks that were drawn and from nothing else.

Every draw is seeded by (seed, node), so reruns and lost executors give the same mix.  A
source of any size is ordered by hash buckets, whose sums are added up first; no task holds
a source.  Sources are the mix's dimension: one row of four numbers a source goes to the driver
and, below a node of the tree, only the sources that have blocks there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventloom.llm.rows import free_name, join_one, located
from eventloom.runtime import ship, written

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 20240
BLOCK_WORDS = 4096
SHARD_BLOCKS = 256
#: Blocks of all sources, about: numpy's draws end below 10**9. Larger corpora have larger blocks.
MOST_BLOCKS = 1 << 28
#: Subtrees that are split by tasks of their own.
SUBTREES = 64
#: Rows of one content above which they are spread over several buckets, and rows of a bucket, about.
SAME_ROWS, BUCKET_ROWS = 20_000, 20_000
#: Places of a source's permutation that are added up in one task.
PLACES = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to rows (source, ix, source_size, target): weights share all words.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target stops at REPEATS
    times its source's size; the excess goes to the others by weight until none is above.
    With sources sorted by limit over weight this is one pass: those before the first whose
    limit holds the even share are at their limits.  One row a source: the order over all of
    them is a single sort of this table.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("ix") % len(WEIGHTS) + 1).cast("int"))
    rows = (
        sizes.withColumn("ix", F.row_number().over(by_name) - 1)
        .withColumn("w", weight)
        .withColumn("limit", F.col("source_size") * REPEATS)
        .withColumn("total", F.sum("source_size").over(every))
    )
    order = Window.orderBy((F.col("limit") / F.col("w")), "ix")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(after)
    rows = rows.withColumn("share", share).withColumn("fits", F.col("limit") >= F.col("share") * F.col("w"))
    rows = rows.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("w"), "ix", "share"))).over(every)["share"])
    return rows.select("source", "ix", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def _split(counts: np.ndarray, left: int, seed: int, node: int) -> np.ndarray:
    """Blocks of each source among the ``left`` blocks that go to the left shards."""
    draw = np.random.default_rng([seed, node])
    return draw.multivariate_hypergeometric(counts, left, method="marginals")


def _descend(node: int, first: int, shards: int, counts: np.ndarray, offsets: np.ndarray, seed: int, stop: int) -> Iterator[tuple]:
    """Nodes (node, first shard, shards, counts, offsets) with at most ``stop`` shards, left to right."""
    if shards <= stop:
        yield node, first, shards, counts, offsets
        return
    half = shards // 2
    left = _split(counts, int(counts.sum()) * half // shards, seed, node)
    yield from _descend(2 * node, first, half, left, offsets, seed, stop)
    yield from _descend(2 * node + 1, first + half, shards - half, counts - left, offsets + left, seed, stop)


def _shards(node: int, first: int, shards: int, ix: np.ndarray, counts: np.ndarray, offsets: np.ndarray, seed: int) -> Iterator[tuple]:
    """(shard, ix, counts, offsets) below a node; sources without a block are left out on the way down."""
    for n, at, size, c, o in _descend(node, first, shards, counts, offsets, seed, max(1, shards // 16)):
        has = np.flatnonzero(c)
        if size == 1:
            yield at, ix[has], c[has], o[has]
        else:
            yield from _shards(n, at, size, ix[has], c[has], o[has], seed)


def _leaves(seed: int, shards: int, stop: int, counts: np.ndarray):
    def leaves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in part["id"]:
                top = _descend(1, 0, shards, counts, np.zeros(len(counts), np.int64), seed, stop)
                node, first, n, c, o = next(islice(top, int(k), None))
                has = np.flatnonzero(c)
                for shard, ix, c, o in _shards(node, first, n, has, c[has], o[has], seed):
                    yield pd.DataFrame({"shard": shard, "ix": ix, "n": c, "at": o})

    return leaves


def _multiplier(blocks: int, seed: int = 0) -> int:
    """Of the affine permutation of ``blocks`` block numbers: coprime, near a seeded place."""
    a = max(1, int(blocks * np.random.default_rng([seed, blocks]).uniform(0.25, 0.75)))
    while gcd(a, blocks) != 1:
        a += 1
    return a


def _permutations(seed: int):
    """(ix, blocks) to (ix, blocks, a, back, b): the block at place p of round r is (a * p + b + r * SHIFT) mod blocks; back inverts a."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for ix, n in zip(part["ix"], part["blocks"]):
                a = _multiplier(int(n), seed)
                rows.append((ix, n, a, pow(a, -1, int(n)), (int(ix) * 7919 + seed) % int(n)))
            yield pd.DataFrame(rows, columns=["ix", "blocks", "a", "back", "b"])

    return run


#: By how much the blocks of a permutation are turned from one round to the next.
SHIFT = 104_729


def permuted(spark: SparkSession, sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """(ix, blocks, a, back, b) of sources (ix, blocks > 0), see _permutations."""
    ship(spark)
    return sizes.select("ix", "blocks").mapInPandas(_permutations(seed), "ix long, blocks long, a long, back long, b long")


def deal(spark: SparkSession, blocks: list[int], seed: int = SEED, shard_blocks: int = SHARD_BLOCKS, places: list[int] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Rows (shard, ix, round, block): the blocks at the first ``places[ix]`` places of each source, dealt to shards.

    places: ``blocks`` (every block once) if not given; place p is place p mod blocks[ix] of round
    p div blocks[ix]. rules: rows of ``permuted``.
    """
    ship(spark)
    counts = np.array(blocks if places is None else places, np.int64)
    if rules is None:
        rules = permuted(spark, spark.createDataFrame([(i, b) for i, b in enumerate(blocks) if b], "ix long, blocks long"), seed)
    total = int(counts.sum())
    shards = max(1, -(-total // shard_blocks))
    stop = max(1, shards // SUBTREES)
    subtrees = sum(1 for _ in _descend(1, 0, shards, np.array([total]), np.zeros(1, np.int64), seed, stop))
    leaves = spark.range(0, subtrees, 1, subtrees).mapInPandas(_leaves(seed, shards, stop, counts), "shard long, ix long, n long, at long")
    at = leaves.select("shard", "ix", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at")).join(rules, "ix")
    place, turn = F.col("at") % F.col("blocks"), F.expr("at div blocks")
    block = (F.col("a") * place + F.col("b") + turn * SHIFT) % F.col("blocks")
    return at.select("shard", "ix", turn.cast("long").alias("round"), block.alias("block"))


class Mix:
    """A mix of ``docs`` (doc_id, text, source, ...): call ``rows``, ``pieces()`` or ``documents()``.

    A null text has no words; null is a source of its own; repeated rows are rows like others
    (which of them is taken doesn't matter); texts of any length count whole; an empty table gives
    an empty mix.  Documents without words are never taken.  Other columns are carried along
    whatever their names.

    rows: doc_id, _at, ix, size, place (words before it in its source), draws (array of round,
    shard, words: what is taken), one for every row of ``docs``.  sources: source, ix,
    source_size, target.
    """

    def __init__(self, docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS):
        self.spark, self.seed = docs.sparkSession, seed
        self.docs, self.at = located(docs)
        text = F.col("text").cast("string")
        sized = self.docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("h"), F.col(self.at).alias("_at"),
        )
        sized = written(sized, "sizes")
        self.sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
        total = self.sources.agg(F.sum("source_size")).first()[0] or 0
        self.block_words = max(block_words, -(-total // MOST_BLOCKS))
        quota = F.least((F.col("target") + 0.5).cast("long"), F.col("source_size") * REPEATS)
        plan = (
            self.sources.withColumn("quota", quota).filter("source_size > 0")
            .select("ix", F.expr("quota div source_size").alias("whole"), F.expr("quota % source_size").alias("rest"), F.ceil(F.col("source_size") / self.block_words).cast("long").alias("blocks"))
        )
        rules = written(permuted(self.spark, plan, seed), "mix-permutations")
        ids = self.sources.select(F.col("source").alias("_s"), "ix")
        rows = written(self._placed(sized.join(ids, sized.source.eqNullSafe(F.col("_s"))).drop("source", "_s"), sized.count()), "mix-rows")
        worded = rows.filter("size > 0").withColumn("block", F.expr(f"place div {self.block_words}"))
        plan = written(self._quotas(worded, plan.join(rules.drop("blocks"), "ix")), "mix-quotas")
        found = plan.select("ix", "blocks", "places").collect()
        blocks, places = np.zeros((2, max([r.ix + 1 for r in found], default=0)), np.int64)
        for r in found:
            blocks[r.ix], places[r.ix] = r.blocks, r.places
        dealt = deal(self.spark, blocks, seed, shard_blocks, places, rules)
        cut = plan.select("ix", F.struct("whole", "last", "words", "start").alias("cut"))
        draws = dealt.join(cut, "ix").groupBy("ix", "block").agg(F.collect_list(F.struct("round", "shard", "cut")).alias("drawn"))  # REPEATS at most

        def taken(d: Column) -> Column:
            """Words of a document: all of them, but for the last block of the round that isn't whole."""
            last = (d["round"] == d["cut"]["whole"]) & (F.col("block") == d["cut"]["last"])
            upto = F.least(F.col("size"), d["cut"]["words"] - (F.col("place") - d["cut"]["start"]))
            return F.struct(d["round"].alias("round"), d["shard"].alias("shard"), F.when(last, upto).otherwise(F.col("size")).alias("words"))

        drawn = F.filter(F.transform(F.coalesce("drawn", F.array().cast(draws.schema["drawn"].dataType)), taken), lambda d: d["words"] > 0)
        columns = ["doc_id", "_at", "ix", "size", "place", "draws"]
        some = worded.join(draws, ["ix", "block"], "left").withColumn("draws", F.array_sort(drawn)).select(*columns)
        none = rows.filter("size = 0").withColumn("draws", F.array().cast(some.schema["draws"].dataType))
        self.rows = some.unionByName(none.select(*columns))

    def _placed(self, rows: DataFrame, n: int) -> DataFrame:
        """``rows`` with place: the words before it in its source's random order.

        Rows of equal doc_id and text have the same place in the order; many of them are spread over buckets of
        their own, where only they are.
        """
        buckets = max(64, n // BUCKET_ROWS)
        same = rows.groupBy("h").agg(F.count("*").alias("_n")).filter(F.col("_n") > SAME_ROWS)
        rows = join_one(rows, same, "h", "_n", n, "left")
        many = F.col("_n").isNotNull()
        bucket = F.when(many, F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) + buckets).otherwise(F.pmod("h", F.lit(buckets)))
        part = F.when(many, F.pmod(F.xxhash64("_at"), F.floor(F.col("_n") / BUCKET_ROWS) + 1)).otherwise(F.lit(0))
        rows = rows.withColumns({"_b": bucket, "_p": part})
        key = Window.partitionBy("ix", "_b", "_p").orderBy("h", "doc_id", "size", "_at")
        inside = F.sum("size").over(key.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        sums = rows.groupBy("ix", "_b", "_p").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("ix").orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.select("ix", "_b", "_p", (F.sum("words").over(upto) - F.col("words")).alias("before"))
        placed = rows.withColumn("inside", inside).join(sums, ["ix", "_b", "_p"])
        return placed.select("doc_id", "_at", "ix", "size", (F.col("before") + F.col("inside")).alias("place"))

    def _quotas(self, worded: DataFrame, plan: DataFrame) -> DataFrame:
        """``plan`` with places (blocks that the source gives) and of the one that is cut: last (its number), words, start (its first document's place)."""
        sums = worded.groupBy("ix", "block").agg(F.sum("size").alias("size"), F.min("place").alias("start")).join(plan.filter("rest > 0"), "ix")
        turned = F.pmod(F.col("block") - F.col("b") - F.col("whole") * SHIFT, F.col("blocks"))
        sums = sums.withColumn("p", F.col("back") * turned % F.col("blocks")).withColumn("g", F.expr(f"p div {PLACES}"))
        group = Window.partitionBy("ix", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = Window.partitionBy("ix").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        heads = sums.groupBy("ix", "g").agg(F.sum("size").alias("words")).select("ix", "g", (F.sum("words").over(upto) - F.col("words")).alias("before"))
        sums = sums.withColumn("inside", F.sum("size").over(group) - F.col("size")).join(heads, ["ix", "g"])
        sums = sums.withColumn("before", F.col("before") + F.col("inside")).filter("before < rest")
        last = sums.groupBy("ix").agg(F.max(F.struct("p", "block", (F.col("rest") - F.col("before")).alias("words"), "start")).alias("l"))
        places = F.col("whole") * F.col("blocks") + F.coalesce(F.col("l.p") + 1, F.lit(0))
        return plan.join(last, "ix", "left").select("ix", "blocks", "whole", places.alias("places"), F.col("l.block").alias("last"), "l.words", "l.start")

    def pieces(self) -> DataFrame:
        """Rows (shard, order, doc_id, _at, ix, size, round, words): what each shard takes.

        order: by it a shard's rows are shuffled. words: how many of the document's first words
        are taken in this round, all of them but for one document of a source.
        """
        order = F.xxhash64(F.lit(self.seed), "shard", "ix", "round", "place")
        pieces = self.rows.select("doc_id", "_at", "ix", "size", "place", F.explode("draws").alias("d")).select("doc_id", "_at", "ix", "size", "place", "d.*")
        return pieces.withColumn("order", order).drop("place")

    def documents(self) -> DataFrame:
        """The mix: documents' columns and shard, order; a document taken again is a row again.

        Where documents have such columns, the names get underscores after them.  The document at a source's
        last block's end is cut after its last taken word (its n_chars follows).  The rows of one document
        follow one another.
        """
        docs, names = self.docs, list(self.docs.columns)
        own = {}
        for c in ("shard", "order", "words", "size"):
            own[c] = free_name(names, c)
            names.append(own[c])
        words, size = F.col(own["words"]), F.col(own["size"])
        draw, some = free_name(names, "draw"), free_name(names, "draws")
        taken = self.rows.filter(F.size("draws") > 0).select(F.col("_at").alias(self.at), F.col("size").alias(own["size"]), F.struct("ix", "place", "draws").alias(some))
        text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 0), 1, words.cast("int")), "")
        changed = {"text": F.when(words < size, text).otherwise(F.col("text"))}
        if "n_chars" in docs.columns:
            changed["n_chars"] = F.when(words < size, F.char_length(text)).otherwise(F.col("n_chars"))
        rows = docs.join(taken, self.at).withColumn(draw, F.explode(F.col(some)["draws"]))
        order = F.xxhash64(F.lit(self.seed), F.col(draw)["shard"], F.col(some)["ix"], F.col(draw)["round"], F.col(some)["place"])
        rows = rows.withColumns({own["shard"]: F.col(draw)["shard"], own["order"]: order, own["words"]: F.col(draw)["words"]})
        return rows.withColumns(changed).drop(self.at, own["words"], own["size"], draw, some)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs``: doc_id, size, source_size, target, taken; and shards, where it was dealt, by round."""
    mix = Mix(docs.select("doc_id", "text", "source"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mix.rows.join(mix.sources.drop("source"), "ix").select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))
