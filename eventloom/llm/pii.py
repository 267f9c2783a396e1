"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find spans that are always redacted.  Wider generators propose candidate spans of
every kind with high recall; candidates may overlap one another and base spans.  Boosted trees
score a candidate by its format (digits, separators, checks) and context (what stands before
and after), never by the marks of the base rule.  Positives are the corpus's base spans with
those marks hidden and a mention before them, and generated formats; negatives are candidates
outside the base rule that nothing mentions or disguises, and generated formats with a flaw.  Others are left
out: they may be either.  Each of the four groups weighs the same in a kind, so it doesn't
matter how common a kind is.  Trees are grown on one half of the corpus; on the other half a
threshold per kind is calibrated, which selects the spans that are added.  Of spans that touch,
base ones stay, then those of the kind that is listed first.

All features are small integers, so all candidates of the corpus collapse to counts of at
most ``COMBINATIONS`` feature rows a half; those counts, over all data, are what is learned
from.  The trees become SQL expressions.  A match's place is a running sum of the lengths of
the pieces and matches before it, as rows of one document.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventloom.runtime import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in Java's dialect: the same matches as the plain forms, in linear time. A run of
#: a class that can only match from its beginning is entered there (or where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate generators by kind.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,5}+",
    "card": r"[0-9](?:[\x20.\-/]{0,2}[0-9])++",
    "phone": r"(?:\+|\(|(?<![0-9]))[0-9][\x20()./0-9-]{5,40}[0-9]",
}
#: A text without a match of the guard has none of the pattern (cheap, so it is asked first).
GUARDS = {"email": "@", "phone": "+"}
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
BEFORE, AFTER = 24, 4
#: Feature rows at most: the product of the features' ranges (see _features).
COMBINATIONS = 4 * 5 * 3 * 2**10
ROUNDS, RATE = 24, 0.4
SEED = 4
#: Weight of each group of training rows in a kind.
GROUP_WEIGHT = 1000.0
#: Share of a kind's accepted weight that must be positives.
PRECISION = 0.95
MENTIONS = {
    "email": r"(?i)(?:mail|contact|write to|@)[^A-Za-z0-9]*$",
    "ip": r"(?i)\b(?:ip|host|address|server)\b[^0-9\n]*$",
    "card": r"(?i)\b(?:card|visa|credit|payment|iban)\b[^0-9\n]*$",
    "phone": r"(?i)(?:phone|\bcall|\btel|\bmobile|\bfax|\bdial)\b[^0-9\n]*$",
}


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, guard: Column | None, made) -> Column:
    """Array of ``made(x)``, in order, for the leftmost non-overlapping matches x of ``pattern``.

    x: m, and b and a, the pieces before and after it. A match's place is the sum of the pieces'
    and matches' lengths before it; ``_placed`` adds them up.
    """
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    parts = F.split(text, pattern, -1)
    both = _let(parts, lambda p: F.arrays_zip(hits.alias("m"), p.alias("b"), F.slice(p, 2, 1 << 30).alias("a")))
    spans = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), made)
    some = F.regexp_like(text, F.lit(pattern))
    return F.when(some if guard is None else guard & some, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.coalesce(term(i), F.lit(0))) % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_like(p, F.lit(OCTET)))


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    if kind == "phone":
        return n.between(9, 15)
    return n.between(12, 19) & luhn(_digits(m))


FEATURES = ("kind", "digits", "separators", "luhn", "octets", "plus", "at", "tail", "grouped", "mention", "glued", "even", "disguised")


def _features(kind: str, m: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate: kind (4), digits (5), separators (3) and ten flags."""
    digits = _digits(m)
    n = F.char_length(digits)
    other = F.char_length(m) - n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).otherwise(4),
        "separators": F.when(other == 0, 0).when(other < 4, 1).otherwise(2),
        "luhn": F.when(n.between(2, 40), flag(luhn(digits))).otherwise(0) if kind in ("card", "phone") else F.lit(0),
        "octets": flag(_octets(m)) if kind == "ip" else F.lit(0),
        "plus": flag(F.startswith(m, F.lit("+"))),
        "at": flag(F.contains(m, F.lit("@"))),
        "tail": flag(F.regexp_like(m, F.lit(r"[A-Za-z]{2}$"))),
        "grouped": flag(F.regexp_like(m, F.lit(r"[0-9]{3}[\x20.)-]+[0-9]{3}"))),
        "mention": flag(F.regexp_like(before, F.lit(MENTIONS[kind]))),
        "glued": flag(F.regexp_like(before, F.lit(r"[A-Za-z0-9_=.%-]$")) | F.regexp_like(after, F.lit(r"^[A-Za-z0-9_=%]"))),
        "disguised": flag(F.regexp_like(m, F.lit(r"[\[(](?:at|dot)[\])]"))) if kind == "email" else F.lit(0),
        "even": flag(n.between(12, 19)) if kind == "card" else flag(n.between(9, 15)),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


_HIT = "struct<k: int, base: boolean, i: int, lead: int, n: int, f: struct<{}>>".format(", ".join(f"{f}: int" for f in FEATURES))


def _hits(text: Column, kind: str, base: bool) -> Column:
    """Array of _HIT: matches of the kind's base pattern or generator; a base match that fails has n < 0."""
    none = F.lit(None).cast(_HIT.split("f: ", 1)[1][:-1])

    def made(x: Column, i: Column) -> Column:
        n = F.char_length(x["m"])
        if base:
            n, f = F.when(_valid(kind, x["m"]), n).otherwise(-n), none
        else:
            f = _features(kind, x["m"], F.right(x["b"], F.lit(BEFORE)), F.left(x["a"], F.lit(AFTER)))
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), F.lit(base).alias("base"), i.alias("i"), F.char_length(x["b"]).alias("lead"), n.alias("n"), f.alias("f"))

    guard = F.contains(text, F.lit(GUARDS[kind])) if base and kind in GUARDS else None
    found = _found(text, (PATTERNS if base else GENERATORS)[kind], guard, made)
    return F.coalesce(found.cast(f"array<{_HIT}>"), F.array().cast(f"array<{_HIT}>"))


def propose(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: row, doc_id; spans: row, fold, k, start, end, base, f).

    A span stands once: base says whether the base rule has it, f (null if no generator proposes
    it) are its features. fold: half of the corpus, by a hash of the text. One pass over the texts
    writes lengths and features of what matches; places are running sums within a document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = F.concat(*[_hits(F.col("text"), kind, base) for kind in KINDS for base in (True, False)])
    fold = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(2)).cast("int")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", fold.alias("fold"), every.alias("hits"))
    rows = written(rows, "pii-matches")
    return rows.select("row", "doc_id"), written(_placed(rows), "pii-spans")


def _placed(rows: DataFrame) -> DataFrame:
    """The spans of the documents in ``rows`` (see propose)."""
    hits = rows.filter(F.size("hits") > 0).select("row", "fold", F.explode("hits").alias("h")).select("row", "fold", "h.*").repartition("row")
    upto = Window.partitionBy("row", "k", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.abs("n")
    placed = hits.withColumn("end", F.sum(F.col("lead") + length).over(upto)).withColumn("start", F.col("end") - length).filter("n >= 0")
    return placed.groupBy("row", "fold", "k", "start", "end").agg(F.bool_or("base").alias("base"), F.max("f").alias("f"))


class Boosted:
    """Depth-two trees of a logistic loss over counted feature rows, and thresholds by kind.

    held: (x, positive, total) of rows that the trees aren't grown on, for the thresholds.
    """

    def __init__(self, x: np.ndarray, positive: np.ndarray, total: np.ndarray, held: tuple | None = None):
        self.trees: list[tuple] = []
        raw = np.zeros(len(x))
        for _ in range(ROUNDS if len(x) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(x, positive - total * p, np.maximum(total * p * (1 - p), 1e-9))
            self.trees.append(tree)
            raw += self._value(tree, x)
        if held is not None:
            x, positive, total = held
            raw = sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))
        p = 1 / (1 + np.exp(-raw))
        self.thresholds = [self._threshold(p[x[:, 0] == k], positive[x[:, 0] == k], total[x[:, 0] == k]) if len(x) else 2.0 for k in range(len(KINDS))]

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, where = 1e-9, None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                if gain > best:
                    best, where = gain, (f, int(cut))
        return where

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int = 2) -> tuple:
        where = self._split(x, g, h) if depth else None
        if where is None:
            return (round(float(RATE * g.sum() / (h.sum() + 1)), 9),)
        low = x[:, where[0]] <= where[1]
        return (*where, self._tree(x[low], g[low], h[low], depth - 1), self._tree(x[~low], g[~low], h[~low], depth - 1))

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    @staticmethod
    def _threshold(p: np.ndarray, positive: np.ndarray, total: np.ndarray) -> float:
        """The least score from which on the accepted candidates have PRECISION; 2 if there is none."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(positive[order]) / np.maximum(np.cumsum(total[order]), 1)
        last = np.append(np.diff(p[order]) != 0, True) if len(p) else np.zeros(0, bool)
        good = np.flatnonzero(last & (right >= PRECISION))
        return round(float(p[order][good[-1]]) - 1e-6, 9) if len(good) else 2.0

    def _expression(self, tree: tuple, f: Column) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        return F.when(f[FEATURES[tree[0]]] <= tree[1], self._expression(tree[2], f)).otherwise(self._expression(tree[3], f))

    def accepts(self, f: Column) -> Column:
        """Whether a candidate with features ``f`` is redacted."""
        if not self.trees:
            return F.lit(False)
        raw = reduce(lambda a, b: a + b, [self._expression(t, f) for t in self.trees])
        least = F.element_at(F.array(*map(F.lit, self.thresholds)), f["kind"] + 1)
        sound = F.array(f["tail"] == 1, f["octets"] == 1, (f["luhn"] == 1) & (f["even"] == 1), f["even"] == 1)
        return F.element_at(sound, f["kind"] + 1) & (1 / (1 + F.exp(-raw)) >= least)


def _generated(kind: int) -> tuple[list[tuple], list[tuple]]:
    """Feature rows of a kind that are private (sound, mentioned or disguised, not glued), and the same ones with one flaw."""
    free = {"digits": range(5), "separators": range(3), "grouped": (0, 1), "luhn": (0, 1)}
    must = {"tail": 1} if KINDS[kind] == "email" else {"octets": 1} if KINDS[kind] == "ip" else {"even": 1}
    if KINDS[kind] == "card":
        must |= {"luhn": 1}
        free["digits"] = (3, 4)
    elif KINDS[kind] == "phone":
        free["digits"] = (2, 3)
    else:
        free["luhn"] = (0,)
    if KINDS[kind] == "email":
        free["disguised"] = (0, 1)
    right = []
    for values in product(*free.values()):
        row = dict.fromkeys(FEATURES, 0) | {"kind": kind, "mention": 1} | dict(zip(free, values)) | must
        right.append(row)
    wrong = [r | flaw for r in right for flaw in ({"mention": 0}, {"glued": 1}, *({m: 0} for m in must)) if not (r["disguised"] and "mention" in flaw)]
    right += [r | {"mention": 0} for r in right if r["disguised"]]
    unique = lambda rows: sorted({tuple(r[f] for f in FEATURES) for r in rows})
    return unique(right), unique(wrong)


def _training(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positives and totals to learn from, of counted feature rows (see the module's text)."""
    at = {f: i for i, f in enumerate(FEATURES)}
    hidden = x.copy()
    hidden[:, [at["plus"], at["at"]]] = 0
    shown = hidden.copy()
    shown[:, at["mention"]], shown[:, at["glued"]] = 1, 0
    found = []
    for kind in range(len(KINDS)):
        mine = x[:, 0] == kind
        alone = mine & (x[:, at["mention"]] == 0) & (x[:, at["disguised"]] == 0)
        right, wrong = (np.array(rows, float) for rows in _generated(kind))
        groups = [
            (shown[mine], positive[mine], 1), (right, np.ones(len(right)), 1),
            (hidden[alone], (total - positive)[alone], 0), (wrong, np.ones(len(wrong)), 0),
        ]
        for rows, weight, y in groups:
            if weight.sum() > 0:
                weight = GROUP_WEIGHT * weight / weight.sum()
                found.append(np.column_stack([rows, y * weight, weight]))
    table = np.concatenate(found)
    return table[:, :-2], table[:, -2], table[:, -1]


def fit(spans: DataFrame) -> Boosted:
    """Trees from the counts of one half's candidates by features, thresholds from the other half's."""
    rows = spans.filter("f is not null").select("fold", "base", "f.*")
    counts = rows.groupBy("fold", *FEATURES).agg(F.count_if("base").alias("positive"), F.count("*").alias("total")).orderBy("fold", *FEATURES).collect()
    table = np.array([[r.fold] + [r[f] for f in FEATURES] + [r.positive, r.total] for r in counts], float).reshape(-1, len(FEATURES) + 3)
    grown, held = (_training(t[:, 1:-2], t[:, -2], t[:, -1]) for t in (table[table[:, 0] == 0], table[table[:, 0] == 1]))
    return Boosted(*grown, held)


def chosen(spans: DataFrame, model: Boosted) -> DataFrame:
    """Base spans, and the accepted candidates that touch none of them nor one another (kinds first as listed): row, k, start, end, base."""
    rows = spans.select("row", "k", "start", "end", "base", F.coalesce(model.accepts(F.col("f")), F.lit(False)).alias("good")).filter("base or good")
    before = Window.partitionBy("row").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kept", F.col("base"))
    for k in range(len(KINDS)):  # spans of one kind never touch
        rows = rows.withColumn("_e", F.max(F.when(F.col("kept"), F.col("end"))).over(before)).withColumn("_s", F.min(F.when(F.col("kept"), F.col("start"))).over(after))
        touched = F.coalesce(F.col("_e") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_s") < F.col("end"), F.lit(False))
        rows = rows.withColumn("kept", F.col("kept") | ((F.col("k") == k) & ~touched)).drop("_e", "_s")
    return rows.filter("kept").drop("good", "kept")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, k, end, base, in order; k: place in KINDS) for every row of ``docs``.

    Base spans always stay. Null and empty texts have no span; repeated rows stay; an empty table
    gives no row; other columns are not looked at. Long texts take time in proportion to their
    length and matches.
    """
    rows, spans = propose(docs)
    one = F.struct("start", "k", "end", "base")
    lists = chosen(spans, fit(spans)).groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start: bigint, k: int, end: bigint, base: boolean>>")
    return rows.join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs``: base counts and digest, all spans (see detect)."""
    found = detect(docs.select("doc_id", "text")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id", *[F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
