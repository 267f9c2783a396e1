"""Token-id files in bit planes.

A file holds the ids of a run of documents.  Ids are cut into blocks of ``BLOCK`` ids; each
block is transposed into its four byte planes or 32 bit planes, and every plane that isn't
all zero is compressed with zstandard by itself.  Layout (little-endian)::

    "EVLTOKS1"                                     magic
    frames                                         compressed planes, one after the other
    documents: n int64 ids, n int64 token counts   each array one zstandard frame
    chunk index: per block and plane, offset int64 and length int64 (length 0: all zero)
    JSON footer                                    block size, planes, counts, places of the above
    footer length int64, "EVLTOKS1"

Readers fetch any block by the index without touching the others.  A file appears under its
name by a rename once it is whole, and a task that runs again writes the same bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom import ranges
from eventloom.llm.arrow import slices
from eventloom.llm.tokenise import encoder
from eventloom.runtime import scratch, ship, written

MAGIC = b"EVLTOKS1"
BLOCK = 1 << 16
LEVEL = 3
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that a file holds, about.
FILE_BYTES = 24_000_000


def planes_of(block: np.ndarray, bits: bool) -> np.ndarray:
    """Rows: the 4 byte planes (lowest first) or 32 bit planes (lowest first) of a block of ids."""
    octets = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(octets.T)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")


def block_of(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    """The ``n`` ids of a block from its planes."""
    if not bits:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)[:n]
    spread = np.unpackbits(planes, axis=1, bitorder="little")[:, :n]
    return np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Writes ids of documents as they come; memory holds one block."""

    def __init__(self, sink, block: int = BLOCK, bits: bool = False):
        self.sink, self.block, self.bits = sink, block, bits
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.at = sink.write(MAGIC)
        self.index: list[tuple[int, int]] = []
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.total = 0

    def _frame(self, data: bytes) -> tuple[int, int]:
        packed = self.pack.compress(data)
        self.sink.write(packed)
        place = (self.at, len(packed))
        self.at += len(packed)
        return place

    def _flush(self, block: np.ndarray) -> None:
        for plane in planes_of(block, self.bits):
            self.index.append(self._frame(plane.tobytes()) if plane.any() else (0, 0))

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        self.ids.append(doc_ids.astype("<i8"))
        self.sizes.append(counts.astype("<i8"))
        self.open.append(flat)
        self.waiting += len(flat)
        self.total += len(flat)
        if self.waiting >= self.block:
            joined = np.concatenate(self.open)
            whole = len(joined) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(joined[i : i + self.block])
            self.open, self.waiting = [joined[whole:].copy()], len(joined) - whole

    def close(self) -> int:
        """Write what is left and the footer; number of ids."""
        if self.waiting:
            self._flush(np.concatenate(self.open))
        empty = [np.zeros(0, "<i8")]
        footer = {
            "block": self.block, "bits": self.bits, "ids": self.total, "documents": sum(map(len, self.ids)),
            "doc_ids": self._frame(np.concatenate(self.ids or empty).tobytes()),
            "doc_counts": self._frame(np.concatenate(self.sizes or empty).tobytes()),
            "index": self._frame(np.array(self.index, "<i8").tobytes()),
        }
        data = json.dumps(footer).encode()
        self.sink.write(data + len(data).to_bytes(8, "little") + MAGIC)
        return self.total


class PlaneReader:
    """Reads a file of PlaneWriter: documents' ids and counts, and any block of token ids."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file, or not a whole one")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self._read(end - 16 - n, n))
        self.unpack = zstandard.ZstdDecompressor()
        self.doc_ids = self._array("doc_ids")
        self.doc_counts = self._array("doc_counts")
        self.index = self._array("index").reshape(-1, 32 if self.footer["bits"] else 4, 2)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _array(self, name: str) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(self._read(*self.footer[name])), "<i8")

    def block(self, k: int) -> np.ndarray:
        size, bits = self.footer["block"], self.footer["bits"]
        n = min(size, self.footer["ids"] - k * size)
        planes = np.zeros((32 if bits else 4, -(-n // 8) if bits else n), np.uint8)
        for i, (at, length) in enumerate(self.index[k].tolist()):
            if length:
                planes[i] = np.frombuffer(self.unpack.decompress(self._read(at, length)), np.uint8)
        return block_of(planes, n, bits)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of each document; a few blocks are in memory, or one document."""
        held, start, k = np.zeros(0, "<u4"), 0, 0
        for i, n in enumerate(self.doc_counts.tolist()):
            parts = [held[start : start + n]]
            missing = n - len(parts[0])
            start += len(parts[0])
            while missing > 0:
                held, k = self.block(k), k + 1
                parts.append(held[:missing])
                start = len(parts[-1])
                missing -= start
            yield i, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _open(uri: str):
    found, path = fs.FileSystem.from_uri(uri)
    return found, path


#: A null doc_id in files.
NULL_ID = -(1 << 63)


def ordered_buckets(docs: DataFrame, bytes_a_bucket: int = FILE_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text) with bucket, and the number of buckets: ascending doc_id (nulls first), about even text sizes.

    An id whose rows hold more than a bucket's bytes has buckets of its own, over which its rows
    are spread. The bounds are one number a bucket; texts are moved once, when the buckets are dealt out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    sizes = written(rows.select(key.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b")), "text-sizes")
    total = sizes.agg(F.sum("b")).first()[0] or 0
    parts = max(1, -(-total // bytes_a_bucket))
    most = max(bytes_a_bucket, total // ranges.MOST_RANGES)  # so that few ids have more
    hot = sizes.groupBy("key").agg(F.sum("b").alias("b"), F.count("*").alias("n")).filter((F.col("b") > most) & (F.col("n") > 1)).collect()
    lower = set(ranges.even_bounds(sizes, "key", "b", parts))
    for r in hot:
        lower |= {k for k in (r.key, r.key + 1) if NULL_ID < k < 1 << 63}
    lower = sorted(lower)
    width = [1] * (len(lower) + 1)
    for r in hot:
        width[bisect_right(lower, r.key)] = -(-r.b // most)
    first = np.cumsum([0, *width]).tolist()
    bucket = ranges.bucket(key, lower)
    if hot:
        at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), bucket + 1)
        bucket = at(first[:-1]) + F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), at(width)).cast("int")
    return rows.withColumn("bucket", bucket), first[-1]


def write_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, bits: bool = False) -> DataFrame:
    """Encode every text (null: empty), append ``end_id``, write one file a bucket; the manifest.

    Manifest rows: bucket, path, ids, documents, start (ids in all files before). Documents are
    in ascending doc_id order over the files, ties by text within a file.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, n = ordered_buckets(docs)
    target_fs, target = _open(folder)
    target_fs.create_dir(target, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        now, sink, writer, done = None, None, None, []

        def finish() -> None:
            nonlocal writer
            if writer is None:
                return
            ids = writer.close()
            sink.close()
            found.move(f"{path}/{name}.{mark}", f"{path}/{name}")
            done.append((now, f"{folder}/{name}", ids, sum(map(len, writer.ids))))
            writer = None

        found, path = _open(folder)
        for part in slices(batches):
            buckets = part.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if buckets[a] != now:
                    finish()
                    now, mark = int(buckets[a]), uuid.uuid4().hex
                    name = f"ids-{now:06d}.planes"
                    sink = found.open_output_stream(f"{path}/{name}.{mark}")
                    writer = PlaneWriter(sink, bits=bits)
                piece = part.slice(a, b - a)
                flat, offsets = coder.encode(piece.column("text"))
                flat = np.insert(flat, offsets[1:], end_id)
                docs_here = piece.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                writer.add(docs_here, np.diff(offsets) + 1, flat)
        finish()
        if done:
            columns = list(zip(*done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["bucket", "path", "ids", "documents"],
            )

    sorted_rows = ranges.dealt(rows, n).sortWithinPartitions("bucket", "doc_id", "text")
    manifest = written(sorted_rows.mapInArrow(run, "bucket int, path string, ids long, documents long"), "token-manifest")
    files = sorted(manifest.collect(), key=lambda r: r.bucket)
    starts = np.concatenate([[0], np.cumsum([r.ids for r in files], dtype=np.int64)])
    return spark.createDataFrame(
        [(r.bucket, r.path, r.ids, r.documents, int(s)) for r, s in zip(files, starts)],
        "bucket int, path string, ids long, documents long, start long",
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            found, place = _open(path)
            with found.open_input_file(place) as source:
                reader = PlaneReader(source)
                crcs = np.fromiter((zlib.crc32(np.ascontiguousarray(ids)) for _, ids in reader.documents()), np.int64, len(reader.doc_ids))
                counts = reader.doc_counts
                ids = pa.array(reader.doc_ids, mask=reader.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    ship(manifest.sparkSession)
    n = (manifest.agg(F.max("bucket")).first()[0] or 0) + 1
    return ranges.dealt(manifest.select("bucket", "path", "start"), n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns doc_id, start, n_tokens, ids_crc32, from the files written for ``docs``.

    A null or empty text has the end id only; texts of any length are written whole; repeated rows
    are documents of their own; null doc_ids come first; an empty table gives no file and no row;
    other columns, whatever their names, are not looked at.
    """
    return read_documents(write_files(docs.select("doc_id", "text"), scratch(spark, "token-files")))
