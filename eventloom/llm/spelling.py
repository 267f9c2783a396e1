"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols.  Two words that differ by one edit have reduced words that
are equal or differ by one edit, so one of them is in the other one's full neighbourhood (every
deletion, replacement and insertion of a symbol, and the reduced word itself).  Neighbourhoods are
joined with the reduced vocabulary, and what meets is verified on the words themselves.

Reduced words are never spelled out: a word's key is a polynomial over its symbols modulo 2**64,
from which each neighbour's key follows in constant time, so that very long words cost no more
than their number of neighbours.  Equal keys of different reduced words only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm.arrow import release
from eventloom.llm.rows import slot_table, that_may_be
from eventloom.runtime import ship, written

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Code points and occurrences that a word has at least.
LENGTH, TIMES = 5, 3
#: One in so many (document, run) has a letter left out.
NOISE = 97
#: Keys of a batch.
KEYS = 1 << 19
_LETTERS = r"[^A-Za-z\x{C0}-\x{FF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _values(symbols: int) -> np.ndarray:
    """A 64-bit value for each symbol, by SplitMix64."""
    z = np.arange(1, symbols + 1, dtype=np.uint64) * _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def own_keys(symbols: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Key of each row of symbols (all rows of one length)."""
    with np.errstate(over="ignore"):
        return _mixed((values[symbols] * _powers(symbols.shape[1])).sum(axis=1, dtype=np.uint64))


def neighbour_keys(symbols: np.ndarray, values: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the neighbours that edit the places begin..end-1 of each row, each neighbour once.

    The row itself belongs to place 0, an insertion after the last symbol to the last place + 1.
    """
    n, size = symbols.shape
    with np.errstate(over="ignore"):
        power = _powers(size + 1)
        terms = values[symbols] * power[:size]
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        every = np.arange(n)
        if begin == 0:
            yield every, _mixed(whole[:, 0])
        inner = slice(begin, min(end, size))
        at = np.arange(begin, min(end, size))
        if len(at):
            gone = before[:, inner] + (whole - before[:, begin + 1 : at[-1] + 2]) * _BACK
            same_next = np.zeros((n, len(at)), bool)
            upto = min(end, size - 1)
            same_next[:, : max(0, upto - begin)] = symbols[:, begin:upto] == symbols[:, begin + 1 : upto + 1]
            rows, places = np.nonzero(~same_next)  # of equal symbols in a row the last one goes
            yield rows, _mixed(gone[rows, places])
        upto = min(end, size + 1)
        for s, value in enumerate(values):
            if len(at):
                rows, places = np.nonzero(symbols[:, inner] != s)
                yield rows, _mixed((whole - terms[:, inner] + value * power[inner])[rows, places])
            more = before[:, begin:upto] + value * power[begin:upto] + (whole - before[:, begin:upto]) * _BASE
            fresh = np.ones(more.shape, bool)
            fresh[:, : len(at)] = symbols[:, inner] != s  # before an equal symbol is the same as after it
            rows, places = np.nonzero(fresh)
            yield rows, _mixed(more[rows, places])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, code points as rows) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)
        yield at, points


def _keyed(symbols: int, around: bool):
    """Rows (wid, word) to (wid, key): a word's own key, or those of its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _values(symbols)
        for batch in batches:
            wid = batch.column("wid").to_numpy()
            for at, points in _by_length(batch.column("word").to_pylist()):
                ids, reduced = wid[at], (points % symbols).astype(np.int64)
                if not around:
                    yield _rows(ids, own_keys(reduced, values))
                    continue
                size = reduced.shape[1]
                step = max(1, KEYS // ((size + 1) * symbols * 2))  # words at a time, or places of one
                width = max(1, KEYS // (symbols * 2))
                for a in range(0, len(ids), step):
                    for p in range(0, size + 1, width):
                        for rows, keys in neighbour_keys(reduced[a : a + step], values, p, min(size + 1, p + width)):
                            if len(rows):
                                yield _rows(ids[a : a + step][rows], keys)
        release()

    return run


def _rows(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["wid", "key"])


def vocabulary(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n) of all distinct words of LENGTH code points and TIMES occurrences at least.

    Runs of letters of whole texts, A-Z in lower case; one in ``noise`` (document, run) by CRC-32
    loses a letter.  Null texts have none; a null doc_id counts as empty.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split(lower, _LETTERS)).alias("w"))
    # a run of fewer letters is no word, with or without one of them
    runs = runs.filter(F.char_length("w") >= LENGTH).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.char_length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.filter(F.char_length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= TIMES)


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(wid, word, n, near, near_n): each word with each word that is one edit away. words: wid, word, n; distinct."""
    ship(words.sparkSession)
    keys = written(words.select("wid", "word").mapInArrow(_keyed(symbols, False), "wid long, key long").withColumnRenamed("wid", "vid"), "reduced-words")
    around = words.select("wid", "word").repartition(max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_keyed(symbols, True), "wid long, key long")
    met = that_may_be(around, slot_table(keys, "key", keys.count()), "key")
    pairs = met.join(keys, "key").filter("wid <> vid").select("wid", "vid")
    others = words.select(F.col("wid").alias("vid"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(words, "wid").join(others, "vid").filter(F.levenshtein("word", "near", 1) == 1).select("wid", "word", "n", "near", "near_n", "vid")


def _roots(forms: DataFrame) -> DataFrame:
    """(wid, root) of every word that has a form (wid, form_wid), by pointer doubling: a form's count is
    twice the word's at least, so chains are short and end.
    """
    at = written(forms.select("wid", F.col("form_wid").alias("to")), "forms")
    while True:
        further = at.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        moved = written(at.join(further, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        at = moved.select("wid", "to")
        if moved.filter("moved").isEmpty():
            return at.withColumnRenamed("to", "root_wid")


def group(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the vocabulary of ``docs`` (doc_id, text).

    form: the near word of largest n (ties: the smallest in code-point order), if that is twice
    the word's n or more, else null; root: the end of the chain of forms.  Repeated rows count
    once each; no words give an empty table; other columns aren't looked at.
    """
    words = written(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    words = written(words.withColumn("wid", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near", "vid")).alias("best")
    near = written(near_pairs(words, symbols).groupBy("wid").agg(F.countDistinct("vid").alias("n_near"), best), "near-words")
    known = words.join(near, "wid", "left")
    leads = -F.col("best.less") >= 2 * F.col("n")
    own = written(known.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[
        F.when(leads, c).alias(name) for c, name in ((F.col("best.near"), "form"), (-F.col("best.less"), "form_n"), (F.col("best.vid"), "form_wid"))
    ]), "word-forms")
    roots = _roots(own.filter("form_wid is not null")).join(words.select(F.col("wid").alias("root_wid"), F.col("word").alias("_root")), "root_wid")
    out = own.join(roots.select("wid", "_root"), "wid", "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns word, form, root, n, n_near, form_n over whole ``docs``."""
    return group(docs)


#: CRC-32 by a table made from its polynomial; near words by equal words without one letter.
ORACLE = """WITH RECURSIVE k AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
w AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT d, w, count(*) AS n, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END)) AS bytes FROM w WHERE length(w) >= 5 GROUP BY 1, 2),
h AS MATERIALIZED (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, k),
v AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, CAST(h % length(w) AS INTEGER)) || substring(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON less = v.word UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON less = v.word),
b AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(struct_pack(near, near_n), struct_pack(m := -near_n, near)) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.near_n >= 2 * v.n THEN best.near END AS form, CASE WHEN best.near_n >= 2 * v.n THEN best.near_n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL"""
