"""Places of rows, free column names, and joins that don't gather a hot key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.runtime import written

#: Keys that ``join_one`` broadcasts, at most, and the rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 20_000, 256
#: Bits of a slot table: so many a key, and in all at most.
SLOTS_A_KEY, MOST_SLOTS = 64, 1 << 25
#: Words of 64 row places each that are broadcast at a time.
MOST_WORDS = 1 << 20


def free_name(columns, name: str) -> str:
    """``name``, with underscores after it until none of ``columns`` has it (in any case)."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with file and row index of each row, and that column's name (one that ``docs`` hasn't).

    A table is written if the rows don't come from files.
    """
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput()
    if not any(hidden.apply(i).name() == "_metadata" for i in range(hidden.size())):
        docs = written(docs, "contents")
    place, name = docs.metadataColumn("_metadata"), free_name(docs.columns, "_at")
    return docs.withColumn(name, F.concat_ws("#", place["file_path"], place["row_index"])), name


def join_one(rows: DataFrame, per: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their key's row of ``per``, without gathering a hot key's rows.

    per: one row a key (not null); its column ``count`` is at most the number of the key's rows
    among the ``total`` rows. Keys with a share of 1 / HOT_KEYS or more are broadcast, which are at most
    HOT_KEYS; the rows of all others are few and are shuffled. ``how``: inner or left.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = per.filter(F.col(count) >= least), per.filter(F.col(count) < least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots))


def slot_table(keys: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(words of set bits: w, bits; number of slots) for about ``n`` keys: at most MOST_SLOTS / 64 rows."""
    slots = min(MOST_SLOTS, max(1024, 1 << (SLOTS_A_KEY * max(1, n) - 1).bit_length()))
    bits = keys.select(_slot(column, slots).alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    return written(bits.groupBy("w").agg(F.bit_or("bit").alias("bits")), "slots"), slots


def that_may_be(rows: DataFrame, table: tuple[DataFrame, int], column: str) -> DataFrame:
    """The rows whose key's slot is set: all rows with one of the table's keys, and few others.

    The table is broadcast (see slot_table for its bound).
    """
    words, slots = table
    s, w, b = (free_name(rows.columns, x) for x in ("_s", "_w", "_b"))
    met = rows.withColumn(s, _slot(column, slots)).withColumn(w, F.shiftright(s, 6))
    met = met.join(F.broadcast(words.select(F.col("w").alias(w), F.col("bits").alias(b))), w)
    return met.filter(F.expr(f"shiftright(`{b}`, cast(`{s}` & 63 as int)) & 1 = 1")).drop(s, w, b)


def _place(at: str) -> tuple[Column, Column]:
    """File and row index of a place as ``located`` writes it."""
    row = F.substring_index(at, "#", -1)
    return F.expr(f"left(`{at}`, length(`{at}`) - length(substring_index(`{at}`, '#', -1)) - 1)"), row.cast("long")


def fetched(docs: DataFrame, at: str, places: DataFrame, then: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """``then`` of exactly those rows of ``docs`` (see located) that stand at ``places`` (column ``at``); a table a range of files.

    Nothing of any other row leaves its scan, whatever the number of places.  They are bits, in words of
    64 rows of a file; ranges of files with up to MOST_WORDS words are read one after the other,
    each file in its range only, with the range's words broadcast.  One row a file (name, words) goes to the driver.
    """
    file, row = _place(at)
    bits = places.select(file.alias("file"), F.shiftright(row, 6).alias("w"), F.expr(f"shiftleft(1L, cast(substring_index(`{at}`, '#', -1) as bigint) & 63)").alias("bit"))
    words = written(bits.groupBy("file", "w").agg(F.bit_or("bit").alias("bits")), "places")
    pieces = words.groupBy("file", F.expr(f"w div {MOST_WORDS}").alias("piece")).agg(F.count("*").alias("n")).orderBy("file", "piece").collect()
    runs, held = [], MOST_WORDS
    for p in pieces:
        if held + p.n > MOST_WORDS:
            runs.append([])
            held = 0
        runs[-1].append((p.file, p.piece))
        held += p.n
    key, word, bit = (free_name(docs.columns, x) for x in ("_key", "_bits", "_bit"))
    found = []
    for run in runs:
        (low, first), (high, last) = run[0], run[-1]
        order, inside = F.struct("file", F.expr(f"w div {MOST_WORDS}")), docs
        own = words.filter((order >= F.struct(F.lit(low), F.lit(first).cast("long"))) & (order <= F.struct(F.lit(high), F.lit(last).cast("long"))))
        own = own.groupBy(F.xxhash64("file", "w").alias(key)).agg(F.bit_or("bits").alias(word))
        if len(runs) > 1:
            path = docs.metadataColumn("_metadata")["file_path"]
            inside = docs.filter((path >= low) & (path <= high))
        met = inside.withColumns({key: F.xxhash64(file, F.shiftright(row, 6)), bit: row.bitwiseAND(F.lit(63)).cast("int")}).join(F.broadcast(own), key)
        rows = then(met.filter(F.expr(f"shiftright(`{word}`, `{bit}`) & 1 = 1")).drop(key, word, bit))
        found.append(rows if len(runs) == 1 else written(rows, "fetched"))
    return found
