"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point).  A trigram's vector
binds its letters' vectors, each permuted (rotated) by its place; a document's vector bundles
(adds) the vectors of all its trigrams, and a language's prototype those of its documents.
A document has the language whose prototype is nearest by cosine.

Letters are compared in lower case; every run of other characters is one gap, which has a
vector like a letter.  Prototypes are learned from a bounded sample of labelled rows; lang,
source and doc_id are never seen by a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm.arrow import slices, strings
from eventloom.llm.rows import free_name
from eventloom.runtime import ship

DIMENSIONS = 1024
#: Labelled rows that are learned from, about, in equal parts by language (by a hash of doc_id and row; of less all are taken).
TRAIN_ROWS = 6_000
#: A language's part at least, however many languages there are.
LEAST_ROWS = 100
SEED = 3
#: The share of the labelled rows that is never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Documents that are put into one dense matrix product.
BLOCK = 256

_TABLES: dict = {}


def _character_table() -> np.ndarray:
    """Per code point: the code point of its lower case if it is a letter, else 0 (the gap)."""
    if "lower" not in _TABLES:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
        _TABLES["lower"] = table
    return _TABLES["lower"]


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1/-1 vector of a letter's code point (0: the gap)."""
    key = (code, dimensions)
    if key not in _TABLES:
        bits = np.random.default_rng([SEED, code]).integers(0, 2, dimensions)
        _TABLES[key] = (2 * bits - 1).astype(np.int8)
    return _TABLES[key]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet (code points), trigram codes, their document, and which documents have a letter."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    codes = _character_table()[np.frombuffer(joined, np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    lettered = np.bincount(doc[codes > 0], minlength=len(texts)) > 0
    # a gap on both sides of each text, and one for each run of other characters
    first = np.cumsum(sizes + 2) - (sizes + 2)
    padded = np.zeros(len(codes) + 2 * len(texts), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 2)
    padded[np.arange(len(codes)) + 1 + 2 * doc] = codes
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
    keep[first] = True
    padded, owner = padded[keep], owner[keep]
    flags = np.zeros(int(padded.max(initial=0)) + 1, bool)
    flags[padded] = True
    alphabet = np.flatnonzero(flags)
    rank = np.zeros(len(flags), np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    x, k = rank[padded], len(alphabet)
    same = (owner[2:] == owner[:-2]) & lettered[owner[2:]] if len(owner) > 2 else np.zeros(0, bool)
    grams = ((x[:-2] * k + x[1:-1]) * k + x[2:])[same] if len(owner) > 2 else np.zeros(0, np.int64)
    return alphabet, grams, owner[2:][same] if len(owner) > 2 else grams, lettered


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors (rows) and which documents have a letter; without one: the zero vector."""
    alphabet, grams, owner, lettered = _trigrams(texts)
    k = len(alphabet)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(grams):
        return out, lettered
    if k**3 <= 1 << 24:
        present = np.zeros(k**3, bool)
        present[grams] = True
        types = np.flatnonzero(present)
        place = np.zeros(k**3, np.int64)
        place[types] = np.arange(len(types))
        column = place[grams]
    else:
        types, column = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    for a in range(0, len(types), 8192):  # bounded: at most 8,192 trigram vectors at a time
        part = types[a : a + 8192]
        vectors = (twice[part // (k * k)] * once[part // k % k] * letters[part % k]).astype(np.float32)
        here = (column >= a) & (column < a + 8192)
        counts = np.bincount(owner[here] * len(part) + column[here] - a, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ vectors
    return out, lettered


def _vectors(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i in range(0, len(texts), BLOCK):
        yield i, *bundle(texts[i : i + BLOCK])


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        for i, vectors, lettered in _vectors(strings(batch.column("text"))):
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(norms > 0, norms, 1)
            for j in np.flatnonzero(lettered):
                sums.setdefault(langs[i + j], np.zeros(DIMENSIONS))
                sums[langs[i + j]] += unit[j]
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "v"]
    )


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from text and non-null lang of rows that aren't held out."""
    ship(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    part = max(LEAST_ROWS, rows // max(1, len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, part / r.n) * (1 << 30))) for r in counts], "lang string, share long")
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.monotonically_increasing_id()), F.lit(1 << 30))  # of each row, whatever repeats
    sample = labelled.withColumn("drawn", drawn).join(F.broadcast(shares), "lang").filter("drawn < share")
    parts = sample.select("lang", "text").mapInArrow(_learn, "lang string, v array<double>")
    # one row a language and task, added up by component before anything goes to the driver
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.i] = r.x
    names = sorted(found)
    prototypes = np.stack([found[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    return names, np.round(prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12), 9)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``label`` (a learned value; UNKNOWN without a letter or model) and ``score`` (cosine, 0 to 1).

    Columns of ``docs`` with these names are replaced. Of prototypes that are equally near the first by name counts.
    """
    ship(docs.sparkSession)
    names, prototypes = model
    matrix = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, scores = [], []
            for _, vectors, lettered in _vectors(strings(batch.column("text"))):
                norms = np.linalg.norm(vectors, axis=1)
                if not names:
                    labels += [UNKNOWN] * len(norms)
                    scores.append(np.zeros(len(norms)))
                    continue
                cosines = vectors @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                labels += [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores.append(np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0))
            columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(labels, pa.string()), pa.array(np.concatenate(scores).astype(np.float64))],
                names=[*batch.schema.names, label, score],
            )

    kept = docs.drop(label, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{label}` string, `{score}` double")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns; ``lang`` is the predicted one where it was null.

    Without any learned language all rows stay as they are.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs
    label, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    found = predict(docs, model, label, score).filter(F.col(label) != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", label)).drop(label, score)


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, lang_pred, score for every row of ``docs``.

    Null, empty and letterless texts are ``und`` with score 0, as is everything when no row can be
    learned from; texts of any length count whole; repeated rows stay; an empty table gives no row;
    other columns, whatever their names, are not looked at.
    """
    found = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
