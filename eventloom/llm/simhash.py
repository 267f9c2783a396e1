"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Fingerprints that differ in at
most three bits differ in at most one bit of some segment, and so share one of its 32
one-wildcard variants (position, segment without that bit).  Distinct fingerprints are
indexed under 64 variants each; an equality of variants proposes, the Hamming distance
verifies.

A variant with more than ``BUCKET`` fingerprints isn't compared whole: its members agree in
31 bits of one segment and are cut again in the other one, first in halves of 16 bits, then
in quarters of 8, by the same argument, so that what is compared at the last level holds at
most 2**11 distinct fingerprints.  Inside a bucket only a spanning forest of the verified
links is returned, never all pairs.

A text may have fingerprints of several families, whose shingle hashes are mixed differently.
Texts are then linked by any family whose fingerprints are near: each one is as exact, and what
bits of one family miss by chance another one may meet.

Edits of a text change few of its words but many of its shingles: texts that share 80 % of their
five-word shingles differ in about one of eight bits of a shingle fingerprint, and are seldom at
three bits or nearer. ``loose`` fingerprints are of a text's distinct words (the lower ``WORD_BITS``)
and of its pairs of neighbouring words (the others), of which such texts differ in one of sixteen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm.arrow import raw, slices
from eventloom.llm.components import components
from eventloom.llm.rows import join_one, located, slot_table, that_may_be
from eventloom.runtime import ship, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of a variant that are compared with one another at once.
BUCKET = 256
#: Fingerprints whose variants are made in one task.
EXPLODED = 20_000
#: Families of loose fingerprints where near copies matter more than the work (the pipeline).
FAMILIES = 4
#: Bits of a loose fingerprint that are of distinct words.
WORD_BITS = 48
#: Hashes whose bits are counted at once (counts have 16 bits).
_COUNTED = 1 << 15


def fingerprint(data: bytes, family: int = 0, loose: bool = False) -> int:
    """Fingerprint of one text (UTF-8); no words: 0."""
    return _fingerprint(_parts(data) if loose else (_hashes(data),), family)


def _fingerprint(parts: tuple[np.ndarray, ...], family: int) -> int:
    """A family's bits of all shingles, or the loose ones of words and pairs."""
    bits = [_majority(_mixed(hashes, family)) for hashes in parts]
    if len(bits) == 1:
        return bits[0]
    low = (1 << WORD_BITS) - 1
    return bits[0] & low | bits[1] & ~low


def _mixed(hashes: np.ndarray, family: int) -> np.ndarray:
    """Hashes of a family: family 0 has them as they are, others by SplitMix64's finaliser."""
    if not family:
        return hashes
    z = hashes + np.uint64(family * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; of no hash none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _COUNTED):
        bits = np.unpackbits(hashes[i : i + _COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the distinct words, and of every pair of neighbours (of one word: the word)."""
    distinct = set(data.lower().split())
    words = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    return words, _hashes(data, 2)


def _hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included. bytes.split() cuts at the six ASCII spaces."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprints(docs: DataFrame, *keep: str, families: int = 1, loose: bool = False) -> DataFrame:
    """Columns ``keep``, fp (the 64 bits as a long) and more (those of families 1 and on) of every row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.zeros((batch.num_rows, families), np.uint64)
            for row, data in zip(found, raw(batch.column("text"))):
                parts = _parts(data) if loose else (_hashes(data),)
                row[:] = [_fingerprint(parts, k) for k in range(families)]
            found = found.view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (families - 1)), pa.array(found[:, 1:].ravel()))
            names = [name for name in batch.schema.names if name != "text"]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 0].copy()), more], names=[*names, "fp", "more"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, fp long, more array<long>")


def _variants(column, bits: int, shift: int, tag):
    """Array of ``bits`` keys of the segment at ``shift``: tag and position, then the segment without that bit."""
    first = F.shiftleft(F.lit(tag).cast("long") * 32, 32)
    segment = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return [
        segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))).bitwiseOR(first + F.lit(i << 32))
        for i in range(bits)
    ]


def _first_keys(fps: DataFrame) -> DataFrame:
    """Keys of the two segments: a key's tag is twice the family, and one more for the upper segment."""
    keys = _variants(F.col("fp"), 32, 0, F.col("family") * 2) + _variants(F.col("fp"), 32, 32, F.col("family") * 2 + 1)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _finer_keys(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, fp) of too large buckets under (key, sub, fp); the cut is of the bits not yet agreed in.

    key's tag (key >> 37; its parity) names the segment that agrees: the other one is cut. At level 2,
    sub's tag names the 16 bits of it that agree, and the other 16 are cut.
    """
    width = 16 if level == 1 else 8
    open_bits = F.when(F.shiftrightunsigned("key", 37) % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    if level == 2:
        open_bits = F.when(F.shiftrightunsigned("sub", 37) == 0, F.shiftrightunsigned(open_bits, 16)).otherwise(
            open_bits.bitwiseAND(F.lit(0xFFFF))
        )
    keys = _variants(F.col("open"), width, 0, 0) + _variants(F.col("open"), width, width, 1)
    held = ["key"] if level == 1 else ["key", "sub"]
    new = "sub" if level == 1 else "sub2"
    return rows.withColumn("open", open_bits).select("fp", *held, F.explode(F.array(*keys)).alias(new))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fps: list of long) to links (a, b) of a spanning forest of each list's verified links."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for fps in batch.column(0).to_pylist():
            values = np.unique(np.array(fps, np.int64)).view(np.uint64)
            left = np.arange(len(values))
            while len(left) > 1:  # breadth first from any fingerprint that isn't reached yet
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    far = np.bitwise_count(values[front][:, None] ^ values[left][None, :]) > DISTANCE
                    hit = ~far.all(axis=0)
                    if not hit.any():
                        break
                    via = front[np.argmin(far[:, hit], axis=0)]
                    a += values[via].view(np.int64).tolist()
                    b += values[left[hit]].view(np.int64).tolist()
                    front, left = left[hit], left[~hit]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(rows: DataFrame, keys: list[str]) -> DataFrame:
    lists = rows.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps")
    return lists.mapInArrow(_forest, "a long, b long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those of a family at DISTANCE or nearer.

    fps: rows (fp), distinct, or (fp, family) of several families. Pairs that share a variant are verified, directly or through a
    chain of verified links inside the same bucket.
    """
    ship(fps.sparkSession)
    out = None
    keys = ["key"]
    fps = fps if "family" in fps.columns else fps.withColumn("family", F.lit(0))
    fps = fps.repartition(max(1, -(-fps.count() // EXPLODED)), "fp")  # each row becomes 64
    rows = _first_keys(fps)
    for level in (1, 2, 3):
        sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        limit = bucket if level < 3 else 1 << 12  # at level 3, 13 bits are open, so no bucket is larger
        # keys are made a second time rather than kept; what is alone under its key isn't sent again
        met = that_may_be(rows, slot_table(sizes, keys[-1], sizes.count()), keys[-1])
        found = _compare(met.join(sizes.filter(F.col("n") <= limit), keys), keys)
        out = found if out is None else out.unionByName(found)
        large = sizes.filter(F.col("n") > limit)
        if level == 3 or large.isEmpty():
            return out
        rows = _finer_keys(met.join(large.drop("n"), keys), level)
        keys = keys + ["sub" if level == 1 else "sub2"]
    return out


def _links_of_families(rows: DataFrame, bucket: int) -> DataFrame:
    """Links (a, b) of all families of ``rows`` (fp, more), and of a text's fingerprint with those of its others that lead anywhere."""
    views = rows.select("fp", "more").distinct().select("fp", F.posexplode(F.concat(F.array("fp"), "more")).alias("family", "view"))
    views = written(views.distinct(), "fingerprint-views")
    found = written(links(views.select(F.col("view").alias("fp"), "family").distinct(), bucket), "links-of-families")
    others = views.filter("family > 0").select("view", F.col("fp").alias("own"))
    ends = found.select(F.explode(F.array("a", "b")).alias("view")).distinct().withColumn("_end", F.lit(True))
    leading = written(others.groupBy("view").agg(F.count("*").alias("n")).join(ends, "view", "left").filter("n > 1 or _end").select("view", "n"), "leading-views")
    own = join_one(that_may_be(others, slot_table(leading, "view", leading.count()), "view"), leading, "view", "n", others.count())
    return found.unionByName(own.select(F.col("own").alias("a"), F.col("view").alias("b")))


def near_duplicates(docs: DataFrame, *keep: str, bucket: int = BUCKET, families: int = 1, loose: bool = False) -> DataFrame:
    """Every row's ``keep`` columns (doc_id among them), fp, component (its smallest fp) and component_id.

    component_id: the smallest doc_id that is reachable over links (of any of ``families``, which are ``loose`` or of
    shingles), the row's own included.
    Null or empty texts have fingerprint 0 and are linked like any other; a null doc_id is
    never a component_id unless its whole component has none; repeated rows and ties stay, one
    row each; texts of any length count whole; other columns than ``keep`` are not looked at; an
    empty table gives none.
    """
    if "doc_id" not in keep:
        keep = ("doc_id", *keep)
    rows = written(fingerprints(docs, *keep, families=families, loose=loose), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fps")
    joined = written(components(links(fps.select("fp"), bucket) if families == 1 else _links_of_families(rows, bucket)), "components")
    own = fps.join(joined, fps.fp == joined.node, "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("component")
    )
    own = written(own, "fps-by-component")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    of = join_one(own.select("component", "fp", "n"), least, "component", "k", own.count()).select("fp", "n", "component", "component_id")
    return join_one(rows, of, "fp", "n", rows.count()).select(*keep, "fp", "component", "component_id")


def one_of_each(docs: DataFrame, families: int = 1, loose: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the smallest doc_id (nulls last, ties by place).

    Links are those of ``families`` families, ``loose`` ones or of shingles.
    """
    docs, at = located(docs)
    rows = near_duplicates(docs.select("doc_id", "text", F.col(at).alias("_at")), "doc_id", "_at", families=families, loose=loose)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_at"))
    stay = rows.groupBy("component").agg(first.alias("first")).select(F.col("first._at").alias(at))
    return docs.join(stay, at, "left_semi").drop(at)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns doc_id, fingerprint, component_id for every row of ``docs`` (see near_duplicates)."""
    return near_duplicates(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
