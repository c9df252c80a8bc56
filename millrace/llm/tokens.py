"""Whole-text tokenization with the ``tokenizers`` library, memoised by white-space-delimited chunk.

A chunk of text between two places where the tokenizer's pre-tokenizer always cuts gives the same ids wherever it
stands, so each distinct chunk goes through the library once and a text's ids are a join of its chunks' ids. Cutting,
finding the distinct chunks and joining are done for many texts at once in Arrow arrays; a memo keeps chunks met before.
New chunks of Latin letters go to the library's model alone, many as one text in which no merge crosses them. Texts with
white space of which the cuts are not plain (runs, tabs, other Unicode spaces) go through the library whole.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa

#: Chunks in a generation of a worker's memo, of which two are kept: some 150 MB together.
MEMO_ENTRIES = 450_000
#: New chunks that go through the library as one text; larger ones take longer for each chunk.
JOINED = 100

#: White space other than space and line feed.
OTHER_SPACES = (
    "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u2001", "\u2002",
    "\u2003", "\u2004", "\u2005", "\u2006", "\u2007", "\u2008", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000",
)

#: Marks that follow a word as a piece of their own. No apostrophe, which begins pieces of letters.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies spell bytes with: printable ones stand for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


#: A byte that no UTF-8 text has. Its letter can stand between words that go to the model together.
_APART = 255
#: UTF-16 units of the letters of all bytes.
_BYTE_LETTERS = np.array([_byte_letters().get(b, b) for b in range(256)], np.uint16)
_MARKS = np.isin(np.arange(256), np.frombuffer(PUNCTUATION.encode(), np.uint8))
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])

_encoders: dict[tuple[str, int], ChunkEncoder] = {}


class ChunkEncoder:
    """Texts to little-endian id bytes (``dtype``: two bytes for vocabularies up to 65,536 ids, else four)."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.memo_entries = memo_entries
        self.kind = self._kind(spec)
        self.plain, self.lower = self._words(spec, self.kind)
        if self.plain:
            self._join_words(spec["model"])
        if self.kind == "spaced":  # a space belongs to the word after it
            self.separator, self.odd = "\n", ("  ", "\n\n", " \n", "\n ", "\0", *OTHER_SPACES)
        elif self.kind == "dropped":  # white space only delimits
            self.separator, self.odd = " \x01 ", ("\x01",)
        if self.kind:
            ids = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
            self.separator_id = ids[0] if len(ids) == 1 else None
            if self.separator_id is None:
                self.kind = ""

    @staticmethod
    def _kind(spec: dict) -> str:
        """Which cuts are certain: after the pre-tokenizer's description, or none."""
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "" if normalizer else "spaced"
        steps = pre.get("pretokenizers", [])
        split = steps[0] if pre.get("type") == "Sequence" and steps else {}
        white = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if split.get("behavior") == "Removed" and split.get("invert") and "[^\\s" in json.dumps(split["pattern"]).replace("\\\\", "\\"):
            return "dropped" if normalizer and white in normalizer.get("normalizers", []) else ""
        return ""

    @staticmethod
    def _words(spec: dict, kind: str) -> tuple[bool, bool]:
        """Whether a word and the marks behind it are pieces of their own that go to the model as spelled bytes, and lower-cased."""
        model = spec["model"]
        if not kind or model.get("type") != "BPE" or not all(x["special"] for x in spec.get("added_tokens", [])):
            return False, False
        letters, last, suffix = [chr(x) for x in _BYTE_LETTERS], chr(_BYTE_LETTERS[_APART]), model.get("end_of_word_suffix") or ""
        if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return False, False
        if not all(x in model["vocab"] and x + suffix in model["vocab"] for x in letters):
            return False, False
        if not suffix and any(last in x for x in model["vocab"] if x != last):
            return False, False  # no letter to put between words
        if kind == "spaced":
            return True, False
        steps = spec["pre_tokenizer"]["pretokenizers"]
        split, last = steps[0]["pattern"].get("Regex", ""), steps[1] if len(steps) == 2 else {}
        changes = [x["type"] for x in spec["normalizer"]["normalizers"]]
        bytes_only = last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space")
        letters = "[\\p{L}]+" in split and "[^\\s\\p{L}\\p{N}]+" in split
        known = set(changes) <= {"NFC", "Replace", "Lowercase"} and changes.count("Replace") == 1
        return bytes_only and letters and known, "Lowercase" in changes

    def _join_words(self, model: dict) -> None:
        """The library's model alone, for many words as one text: with the ids that end a word (or stand between two)."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.words, self.letters = Tokenizer(self.tokenizer.model), _BYTE_LETTERS.copy()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.closing = np.zeros(self.size, bool)
        if self.suffix:  # the model puts it behind each word, so those must be cut
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
            self.letters[10] = 10
            self.closing[[k for x, k in model["vocab"].items() if x.endswith(self.suffix)]] = True
        else:
            self.letters[10] = self.letters[_APART]
            self.closing[model["vocab"][chr(self.letters[10])]] = True

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _chunks(self, texts: Sequence[str]) -> tuple[list[str], pa.Array, np.ndarray]:
        """The distinct chunks of some texts, the places of all chunks among those, and each text's first chunk (behind: the end)."""
        column = pa.array(texts, pa.large_string())
        bounds, data = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1), column.buffers()[2]
        units = np.frombuffer(data, np.uint8, bounds[-1])
        lines = units == 10
        begins = lines | (units == 32)
        if self.kind == "spaced":
            begins[1:] |= lines[:-1]  # a line feed is a chunk
        if self.plain:
            begins[self._marks_behind_letters(units)] = True
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1])), data).dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "dropped":
            chunks = [x[1:] if x[0] in " \n" else x for x in chunks]
        return chunks, coded.indices, np.searchsorted(starts, bounds)

    @staticmethod
    def _marks_behind_letters(units: np.ndarray) -> np.ndarray:
        """Where punctuation follows a Latin letter in UTF-8: all of U+00C0 to U+027F but two signs are letters.

        U+0130 is left out too: in lower case it ends in a mark of its own, which is one piece with those behind it.
        """
        at = np.flatnonzero(_MARKS[units])
        at = at[np.searchsorted(at, 2) :]  # the others are too near to the start to ask
        last, lead = units[at - 1], units[at - 2]
        wide = (last >= 128) & (lead >= 0xC3) & (lead <= 0xC9)
        wide &= ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)) | (lead == 0xC4) & (last == 0xB0))
        return at[_LETTERS[last] | wide]

    def _learn_words(self, chunks: list[str]) -> list[str]:
        """Encode the chunks of Latin letters, with a space before them or not, by the library's model alone; the others are returned.

        Those are pieces of their own. They go to the model together, apart from each other by a letter that merges with none, or
        by the cuts that the model's suffix needs.
        """
        found, rest, lower = [], [], self.lower
        for chunk in chunks:
            word = chunk.lower() if lower else chunk
            if word.lstrip(" ").isalpha() and (word.isascii() or max(chunk) < "\u0250"):
                found.append((chunk, word))
            else:
                rest.append(chunk)
        for start in range(0, len(found), JOINED):
            part = found[start : start + JOINED]
            units = np.frombuffer("\n".join([word for _, word in part]).encode(), np.uint8)
            spelled = self.letters[units].astype("<u2").tobytes().decode("utf-16-le")
            ids = np.array(self.words.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.closing[ids])
            self._remember([chunk for chunk, _ in part], ids, *((cuts[:-1] + 1,) * 2 if self.suffix else (cuts, cuts + 1)))
        return rest

    def _remember(self, chunks: list[str], ids: np.ndarray, stops: np.ndarray, starts: np.ndarray) -> None:
        """Put the ids into the memo: all chunks but the last one end at ``stops``, all but the first begin at ``starts``."""
        raw, step = ids.tobytes(), self.dtype.itemsize
        begins = [0, *(starts * step).tolist()]
        ends = [*(stops * step).tolist(), len(raw)]
        self.memo.update((c, raw[a:b]) for c, a, b in zip(chunks, begins, ends, strict=True))

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks joined by a separator that is a token of its own, and cut the ids there."""
        if self.plain:
            chunks = self._learn_words(chunks)
        for start in range(0, len(chunks), JOINED):
            part = chunks[start : start + JOINED]
            joined = self.separator.join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) != len(part) - 1:  # a chunk held the separator's id
                self.memo.update(zip(part, self.whole(part), strict=True))
                continue
            self._remember(part, ids, cuts, cuts + 1)

    def _is_odd(self, text: str) -> bool:
        """Whether a text's cuts aren't plain. Substring searches, as they are far faster than one pattern."""
        if self.kind == "spaced" and (text[0] in " \n" or text[-1] in " \n"):
            return True
        return any(x in text for x in self.odd)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The id bytes of each text."""
        if not self.kind:
            return self.whole(texts)
        collecting = gc.isenabled()
        gc.disable()  # lists of millions of strings are no cycles, and take long to walk
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The id bytes of chunks, which are in the memo then."""
        memo, before = self.memo, self.before
        memo[""] = b""
        held = list(map(memo.get, chunks))
        missing = [k for k, raw in enumerate(held) if raw is None]
        unknown = []
        for k in missing:
            raw = before.get(chunks[k])
            if raw is None:
                unknown.append(chunks[k])
            else:
                memo[chunks[k]] = raw
        new = list(dict.fromkeys(unknown))
        if self.kind == "spaced" and "\n" in new:
            new.remove("\n")
            memo["\n"] = self.whole(["\n"])[0]
        if new:
            self._learn(new)
        for k in missing:
            held[k] = memo[chunks[k]]
        return held

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.memo) > self.memo_entries:  # the last generation is kept and gives back what is met again
            self.memo, self.before = {}, self.memo
        out, plain, odd = [b""] * len(texts), [], []
        for k, text in enumerate(texts):
            if text:
                (odd if self._is_odd(text) else plain).append(k)
        if plain:
            chunks, places, edges = self._chunks([texts[k] for k in plain])
            held = self._ids(chunks)
            ends = np.fromiter(accumulate(map(len, held), initial=0), np.int64, len(held) + 1)
            joined = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(held))]
            ).take(places)
            stops = np.frombuffer(joined.buffers()[1], np.int64, len(places) + 1)[edges].tolist()
            ids = memoryview(joined.buffers()[2] or b"")
            for k, start, stop in zip(plain, stops, stops[1:]):
                out[k] = bytes(ids[start:stop])
        if odd:
            for k, raw in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
                out[k] = raw
        return out


def encoder(path: str, memo_entries: int = MEMO_ENTRIES) -> ChunkEncoder:
    """The worker process's encoder of this file; it keeps its memo between tasks."""
    if (path, memo_entries) not in _encoders:
        _encoders[path, memo_entries] = ChunkEncoder(path, memo_entries)
    return _encoders[path, memo_entries]


def text_slices(batch: pa.RecordBatch, column: str = "text", characters: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts (null: empty) of some ``characters`` together, with the first row of each."""
    texts = batch.column(batch.schema.names.index(column)).to_pylist()
    start = size = 0
    for k, text in enumerate(texts):
        texts[k] = text = text or ""
        size += len(text)
        if size >= characters:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]
