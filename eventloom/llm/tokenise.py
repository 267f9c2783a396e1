"""Batch tokenisation through the ``tokenizers`` library with a bounded chunk memo.

A text is cut at places that are always token boundaries of the vocabulary's own
pre-tokeniser, every distinct chunk is encoded once by the library, and a batch is
assembled by one vectorised gather.  The ids are those of ``Tokenizer.encode`` on the
whole text (``tests/llm`` holds the two against each other).

Runs on executors: one encoder per Python worker, of bounded size.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries after which a worker's memo forgets all but the KEPT that were used most.
MEMO_LIMIT, KEPT = 260_000, 130_000
#: Bytes of chunk text after which it forgets everything (very long chunks).
MEMO_BYTES = 24_000_000

_ENCODERS: dict = {}


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; ``EVENTLOOM_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("EVENTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "ChunkEncoder":
    """The worker's encoder for a vocabulary file name (or a path of one)."""
    if name not in _ENCODERS:
        _ENCODERS[name] = ChunkEncoder(name)
    return _ENCODERS[name]


#: White space other than single inner spaces and newlines: such texts are encoded whole.
IRREGULAR = (
    r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$"
)
#: Where a vocabulary lower-cases and takes runs of letters and runs of symbols for words (WORDS), a chunk
#: of composed letters, then symbols without an apostrophe, is two words, whatever its case.
LETTERS, SYMBOLS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = f"^[{LETTERS}]*[{SYMBOLS}]*$"
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
)
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Chunks of one call of the library; they are joined by a separator that is a token of its own.
JOINED = 400


class ChunkEncoder:
    """``encode(texts)`` gives flat ids and offsets; control strings in texts are ordinary text.

    Cutting rule, by pre-tokeniser:

    * white space dropped (``Split`` with inverted removal): cut at ASCII white space, and, where all else
      is as in WORDS, between composed letters and the symbols that end a chunk;
    * byte level with its own pattern: cut before a single inner space, and around a single
      inner newline.  Texts with any other white space are encoded whole.
    """

    #: A tokenizer for chunks that match PLAIN; encoders without one take every chunk the same way.
    plain = None

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else vocabulary_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = "Split" in str(self.tokenizer.pre_tokenizer)
        self.separator = " \x01 " if self.drops_space else "\n"
        mark = self._ids([self.separator])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.plain = self._plain()
        self._clear()

    def _plain(self):
        """The same merges for words that need no normaliser and no pattern; None where words aren't WORDS."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        if self.mark is None or spec["normalizer"] != WORDS[0] or spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [WORDS[1], BYTES]}:
            return None
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTES]}
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": split}))

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        coded = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in coded]

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the entries that were used most; what is kept counts for less the next time."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:KEPT])
        length = self.length[keep]
        at = np.cumsum(length) - length
        self.flat = self.flat[np.repeat(self.start[keep] - at, length) + np.arange(int(length.sum()))]
        self.known = self.known.take(pa.array(keep))
        self.start, self.length, self.uses = at, length, self.uses[keep] // 2

    def _encode_chunks(self, chunks: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of chunks without white space; a leading newline counts as one."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.drops_space:
            plain, lead = chunks, np.zeros(len(chunks), np.int64)
        else:
            plain = [c[1:] if c[:1] == "\n" else " " + c for c in chunks]
            lead = np.fromiter((c[:1] == "\n" for c in chunks), np.int64, len(chunks))
        if self.mark is None or any("\x01" in c for c in plain):
            parts = self._ids(plain)
        else:
            runs = [self.separator.join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
            parts = []
            for ids in self._ids(runs, tokenizer):
                cuts = np.flatnonzero(ids == self.mark)
                parts.append((ids, cuts))
            flat = np.concatenate([ids for ids, _ in parts])
            lengths = np.concatenate([np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1 for ids, cuts in parts])
            if len(lengths) == len(plain):
                flat = flat[flat != self.mark]
                return self._led(flat, lengths, lead)
            parts = self._ids(plain)
        lengths = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        return self._led(np.concatenate(parts), lengths, lead)

    def _led(self, flat: np.ndarray, lengths: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the newline id before the chunks that begin with one."""
        if lead.any():
            at = (np.cumsum(lengths) - lengths)[lead > 0]
            flat = np.insert(flat, at, self.mark)
        return flat, lengths + lead

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Place in the store of every distinct chunk."""
        found = pc.index_in(distinct, value_set=self.known)
        places = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = distinct.take(pa.array(missing))
            if self.plain is not None:  # words first, then the chunks that need the whole tokenizer
                easy = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
                order = np.argsort(~easy, kind="stable")
                missing, new, n = missing[order], new.take(pa.array(order)), int(easy.sum())
                done = [self._encode_chunks(new[:n].to_pylist(), self.plain), self._encode_chunks(new[n:].to_pylist())]
                flat, lengths = (np.concatenate(x) for x in zip(*done))
            else:
                flat, lengths = self._encode_chunks(new.to_pylist())
            places[missing] = len(self.start) + np.arange(len(missing))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, new])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int64)])
        return places

    def _words(self, distinct: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of distinct chunks, with the start and length of each, put together from their words."""
        easy = pc.match_substring_regex(distinct, PLAIN)
        cut = pc.replace_substring_regex(distinct, f"^([{LETTERS}]+)([{SYMBOLS}]+)$", r"\1 \2")
        words = pc.split_pattern(pc.if_else(easy, pc.utf8_lower(cut), distinct), pattern=" ")
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        places = self._places(coded.dictionary)
        self.uses += np.bincount(places, np.bincount(index, np.repeat(times, sizes), len(places)), len(self.uses)).astype(np.int64)
        places = places[index]
        start, length = self.start[places], self.length[places]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return flat, bounds[:-1], np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and ``len(texts) + 1`` offsets. Null: no id."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.known.nbytes > MEMO_BYTES:
            self._clear()
        elif len(self.known) > MEMO_LIMIT:
            self._forget()
        whole = np.zeros(0, np.int64)
        if self.drops_space:
            pieces = pc.ascii_split_whitespace(texts)
        else:
            odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, ""))
            whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            marked = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
            # the first chunk of a text is kept as if a newline stood before it; that id is cut off below
            pieces = pc.split_pattern(pc.replace_substring_regex(marked, r"^", "\n", max_replacements=1), pattern=" ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        if self.plain is not None:
            flat, start, length = self._words(coded.dictionary, np.bincount(index, minlength=len(coded.dictionary)))
            start, length = start[index], length[index]
        else:
            places = self._places(coded.dictionary)[index]
            self.uses += np.bincount(places, minlength=len(self.uses))
            start, length = self.start[places], self.length[places]
            flat = self.flat
        if not self.drops_space:
            first = bounds[:-1]
            start[first] += 1
            length[first] -= 1
            if len(whole):
                parts = self._ids(texts.take(pa.array(whole)).to_pylist())
                sizes = np.fromiter((len(x) for x in parts), np.int64, len(parts))
                start[first[whole]] = len(flat) + np.cumsum(sizes) - sizes
                length[first[whole]] = sizes
                flat = np.concatenate([flat, *parts])
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        gather = np.repeat(start - (ends - length), length)
        gather += np.arange(total)
        return flat[gather], np.concatenate([[0], ends])[bounds]
