"""Exact SentencePiece BPE ids by backtracking over longest matches.

A merge-type encoding is the only sequence of pieces in which any two neighbours, merged again
from single characters, come out as the same two pieces.  The encoder goes through a text by
longest matches (Aho-Corasick), checks each new piece against the one before it, takes the
next shorter prefix piece where the two don't fit, goes back one piece where no prefix does, and
marks the place in a bitfield so that it is never entered again.

Texts are cut first where no piece holds the two characters on both sides, so that no merge
can cross; each distinct part between two cuts is encoded once by a worker's bounded memo.  Pieces that
share one score (runs of spaces, in the public vocabulary) are ordered by their place in a text,
which two neighbours alone don't tell; a part that holds one of them is merged step by step from
a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm.arrow import release, slices, strings
from eventloom.llm.tokenise import ChunkEncoder, vocabulary_path
from eventloom.runtime import ship

MODEL = "piece_bpe_32k.model"
#: What stands for a space in pieces.
SPACE = "\u2581"
#: Parts that a worker remembers, those that stay when there are more, bytes of all; pairs likewise.
PARTS, KEPT, PART_BYTES, PAIRS = 600_000, 300_000, 24_000_000, 400_000

_ENCODERS: dict = {}


def encoder(name: str) -> "PieceEncoder":
    """The worker's encoder of a model file (a name in the folder of vocabularies, or a path)."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


class PieceEncoder(ChunkEncoder):
    """``encode(texts)`` gives flat ids and offsets, by the memo of its base class; ``decode`` is the library's."""

    def __init__(self, name: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else vocabulary_path(name))
        model, n = self.model, self.model.get_piece_size()
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are segmented again; they aren't supported")
        self.bytes = {}
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
        self.unknown = model.unk_id()
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        shared = Counter(s for p, s in self.score.items() if len(p) > 1)
        self.tied = [p for p, s in self.score.items() if len(p) > 1 and shared[s] > 1]
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.tied = [p for p in self.tied if not any(o in p and o != p for o in self.tied)]
        # classes of characters, and which two may stand together in a piece
        letters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.together[self.classes[ord(a)], self.classes[ord(b)]] = True
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        self.digits = _digits(n)
        # a model that only escapes spaces and puts one before the text needs no call for each text
        plain = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x10000))))
        self.escapes = model.normalize(plain) == self._escaped(plain) and model.normalize("  a  ") == self._escaped("  a  ")
        self._clear()

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the pair of the best score first, the leftmost of equal ones, until none is a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.score:
                    heap.append((-self.score[both], i, both)) if not begun else heapq.heappush(heap, (-self.score[both], i, both))

        begun = False
        for i in range(len(parts)):
            offer(i)
        heapq.heapify(heap)
        begun = True
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _prefix(self, piece: str) -> str | None:
        """The longest piece (or single character) that is a shorter prefix."""
        if piece not in self.shorter:
            found = (piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.ids)
            self.shorter[piece] = next(found, None)
        return self.shorter[piece]

    def _fits(self, last: str | None, piece: str) -> bool:
        """Whether the two stay as they are when they are merged again from characters."""
        if last is None:
            if piece not in self.sound:
                self.sound[piece] = self.merged(piece) == [piece]
            return self.sound[piece]
        key = (last, piece)
        if key not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merged(last + piece) == [last, piece]
        return self.pairs[key]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text (escaped, prefixed) by backtracking."""
        if not text:
            return []
        if len(text) == 1:
            return [text]
        if any(p in text for p in self.tied):
            return self.merged(text)
        longest = [1] * len(text)
        for end, size in self.matches.iter(text):
            begin = end - size + 1
            if size > longest[begin]:
                longest[begin] = size
        closed, open_places = False, bytearray(b"\xff") * (len(text) // 8 + 1)
        fits, prefix, size = self._fits, self._prefix, len(text)
        taken: list[str] = []
        at, last, piece = 0, None, text[: longest[0]]
        while at < size:
            while piece is not None:
                end = at + len(piece)
                if (not closed or open_places[end >> 3] >> (end & 7) & 1) and fits(last, piece):
                    break
                piece = prefix(piece)
            if piece is not None:
                taken.append(piece)
                at, last = end, piece
                if at < size:
                    piece = text[at : at + longest[at]]
            else:  # nothing fits here: no way leads through this place
                closed = True
                open_places[at >> 3] &= ~(1 << (at & 7))
                piece = taken.pop()
                at, last = at - len(piece), taken[-1] if taken else None
                piece = prefix(piece)
        return taken

    @staticmethod
    def _escaped(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of parts of texts."""
        flat: list[int] = []
        lengths = []
        known, before = self.ids.get, 0
        for chunk in chunks:
            for piece in self.pieces(chunk):
                i = known(piece)
                if i is not None:
                    flat.append(i)
                elif self.bytes:
                    flat.extend([self.bytes[b] for b in piece.encode()])
                else:
                    flat.append(self.unknown)
            lengths.append(len(flat) - before)
            before = len(flat)
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def _forget(self) -> None:
        """Keep the parts that were used most; what is kept counts for less the next time."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:KEPT])
        length = self.length[keep]
        at = np.cumsum(length) - length
        self.flat = self.flat[np.repeat(self.start[keep] - at, length) + np.arange(int(length.sum()))]
        self.known = self.known.take(pa.array(keep))
        self.start, self.length, self.uses = at, length, self.uses[keep] // 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and ``len(texts) + 1`` offsets.

        Texts are cut between characters that no piece holds side by side, and at their ends.
        """
        escaped = list(map(self._escaped if self.escapes else self.model.normalize, texts))
        sizes = np.fromiter(map(len, escaped), np.int64, len(escaped))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        if not starts[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        if self.known.nbytes > PART_BYTES:
            self._clear()
        elif len(self.known) > PARTS:
            self._forget()
        whole = "".join(escaped)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.together[classes[:-1], classes[1:]]
        cut[starts] = True
        width = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        at = np.flatnonzero(cut)
        offsets = ends[at] + at  # in bytes: one a character, and what it has more
        parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        coded = parts.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        self.uses += np.bincount(places, minlength=len(self.uses))
        start, length = self.start[places], self.length[places]
        upto = np.cumsum(length)
        gather = np.repeat(start - (upto - length), length) + np.arange(int(upto[-1]))
        return self.flat[gather], np.concatenate([[0], upto])[np.searchsorted(at, starts)]

    def listed(self, flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by commas."""
        digits, sizes = self.digits
        size = sizes[flat]
        upto = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(flat.astype(np.int64) * digits.shape[1] - upto[:-1], size) + np.arange(int(upto[-1]))
        out = digits.ravel()[gather].tobytes()
        return [out[upto[a] : max(upto[a], upto[b] - 1)] for a, b in zip(offsets[:-1], offsets[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number below ``n`` in decimal digits with a comma after it, and how many bytes that is."""
    text = [f"{i}," for i in range(n)]
    sizes = np.fromiter(map(len, text), np.int64, n)
    return np.array(text, f"S{sizes.max()}").view(np.uint8).reshape(n, -1), sizes


def encoded(docs: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """``keep`` columns and ids (array of int) of every whole text; null or empty texts have no ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, offsets = encoder(model).encode(strings(batch.column("text")))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], ids], names=[*keep, "ids"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, ids array<int>")


def decoded(rows: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """``keep`` columns and text of rows of ids, by the library's decoder; null ids give an empty text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = encoder(model)
            texts = pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], texts], names=[*keep, "text"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"{fields}, text string")


def digests(docs: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    Ids are those of the whole text without begin and end ids; they are decoded again by the
    library.  Null and empty texts have no ids; texts of any length count whole; repeated
    rows stay; an empty table gives none; other columns than ``keep`` and text aren't looked at.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = encoder(model)
            flat, offsets = own.encode(strings(batch.column("text")))
            of_ids = [hashlib.sha256(x).hexdigest() for x in own.listed(flat, offsets)]
            ids, ends = flat.tolist(), offsets.tolist()
            of_text = [hashlib.sha256(own.decode(ids[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:])]
            columns = [*[batch.column(k) for k in keep], pa.array(np.diff(offsets), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``."""
    return digests(docs, "doc_id")
