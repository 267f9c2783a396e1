"""Packing along a space-filling curve.

Token ids of a document are hashed (with signs) into a short vector; the unit vector is
projected to few dimensions, each cut into 2**BITS steps, and the cell's place on a Hilbert
curve is the document's key.  Documents are range-sorted by key and their ids laid end to end
along the curve, so that a sequence holds neighbouring documents; sequences are cut every
``LENGTH`` ids, and only the very last one is not full.

Ranges of about even numbers of ids are bounded by keys, which end with 15 bits of a hash of
the row's doc_id and place, so that a group of equal documents of any size is spread over ranges.  Rows
of one document that follow one another (a mix that takes it again) can be laid in passes of their
own, so that they don't meet in a sequence.  Ids are encoded once and moved once; a
task streams its range and holds one batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom import ranges
from eventloom.llm.arrow import flat_binary, slices
from eventloom.llm.tokenise import encoder
from eventloom.runtime import ship, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
HASHED, AXES, BITS = 64, 3, 16
SEED = 6
#: Ids that a range holds, about.
RANGE_IDS = 8_000_000
SALT_BITS = 15
#: Bits of the number of a pass, where copies are laid apart.
PASS_BITS = 3


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates (Skilling's transpose form, all rows at once)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            flip = np.where(x[i] & q, q - 1, 0)
            x[0] = x[0] ^ swap ^ flip
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | ((axis ^ turn) >> b & 1)
    return place


def curve_keys(flat: np.ndarray, offsets: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """Hilbert key of each document from its ids; one without ids lies in the middle cell."""
    draw = np.random.default_rng(SEED)
    slot = draw.integers(0, HASHED, vocabulary_size)
    sign = draw.integers(0, 2, vocabulary_size) * 2.0 - 1
    projection = draw.standard_normal((HASHED, AXES))
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n) * HASHED, np.diff(offsets))
    vectors = np.bincount(doc + slot[flat], weights=sign[flat], minlength=n * HASHED).reshape(n, HASHED)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = np.round(vectors / np.where(norms > 0, norms, 1) @ projection, 6)
    cells = np.minimum((1 << BITS) / (1 + np.exp(-1.7 * points)), (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def _passes(docs: list[int | None], last: tuple[int | None, int]) -> list[int]:
    """For each row the number of rows of the same document right before it. last: doc_id and number of the row before."""
    out = []
    for doc in docs:
        last = doc, last[1] + 1 if doc is not None and doc == last[0] else 0
        out.append(last[1])
    return out


def _encode(vocabulary: str, end_id: int, apart: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        last = None, 0
        size = max(coder.tokenizer.get_vocab_size(), end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for batch in slices(batches):
            flat, offsets = coder.encode(batch.column("text"))
            keys = curve_keys(flat, offsets, size)
            flat = np.insert(flat, offsets[1:], end_id).astype(kind)
            offsets = offsets + np.arange(len(offsets))
            salted = keys << SALT_BITS | batch.column("salt").to_numpy(zero_copy_only=False)
            if apart:
                docs = batch.column("doc_id").to_pylist()
                passes = np.array(_passes(docs, last), np.int64)
                last = docs[-1], int(passes[-1])
                salted = np.minimum(passes, (1 << PASS_BITS) - 1) << (63 - PASS_BITS) | salted >> PASS_BITS
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(salted), pa.array(np.diff(offsets)), flat_binary(flat, offsets)],
                names=["doc_id", "key", "n", "ids"],
            )

    return run


def _lay(bases: dict[int, int], length: int, wide: bool):
    """Pieces of the documents of each range, which begins at ``bases`` ids from the start of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in slices(batches, "ids"):
            rows = []
            docs = batch.column("doc_id").to_pylist()
            for doc, bucket, data in zip(docs, batch.column("bucket").to_pylist(), batch.column("ids").to_pylist()):
                if bucket != now:
                    now, at = bucket, bases[bucket]
                ids = np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - at % length)
                    rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), at // length, at % length))
                    start, at = start + n, at + n
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH, range_ids: int = RANGE_IDS, apart: bool = False) -> DataFrame:
    """Rows _COLUMNS (long): the pieces of every document's ids, each id in exactly one.

    A null text is empty and has the end id only; texts of any length are packed whole; repeated
    rows and ties are documents of their own, in the order of their rows; an empty table gives no
    piece; columns other than doc_id and text, whatever their names, are not looked at.  With ``apart`` rows
    of one doc_id that follow one another lie in different passes along the curve (up to 2**PASS_BITS).
    """
    spark = docs.sparkSession
    ship(spark)
    size = encoder(vocabulary).tokenizer.get_vocab_size()
    salt = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.monotonically_increasing_id()), F.lit(1 << SALT_BITS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("salt", salt)
    coded = written(rows.mapInArrow(_encode(vocabulary, end_id, apart), "doc_id long, key long, n long, ids binary"), "coded")
    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // range_ids))
    lower = ranges.even_bounds(coded, "key", "n", parts)
    bucket = ranges.bucket(F.col("key"), lower)
    sums = {r.bucket: r.n for r in coded.select("n", bucket.alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    bases, at = {}, 0
    for b in sorted(sums):  # one number a range
        bases[b], at = at, at + sums[b]
    laid = (
        ranges.dealt(coded.withColumn("bucket", bucket), len(lower) + 1)
        .sortWithinPartitions("bucket", "key", "doc_id", "n", "ids")
    )
    return laid.mapInArrow(_lay(bases, length, size > 1 << 16), ", ".join(f"{c} long" for c in _COLUMNS))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns of every piece of ``docs`` (see pack)."""
    return pack(docs.select("doc_id", "text"))
