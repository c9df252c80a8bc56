"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no piece crosses (a run of word-boundary marks with what follows it, and characters
that occur in no longer piece). Distinct segments are merged together in flat numpy arrays: symbol ids, and the
segment each belongs to. A round looks up the score rank of every adjacent pair, takes each segment's least rank
(segmented minimum), merges all leftmost non-overlapping pairs of that rank at once and compacts the arrays; segments
without a pair left drop out. This equals the library's one-at-a-time order as long as a merge's result can't be
part of a better pair; results that can (found from the model when it is loaded) are merged one at a time, leftmost
first. Segments of over 512 characters are cut
where no piece reaches across, and such parts as are still so long are merged with an agenda of pairs instead, which
gives the same ids. Characters without a piece become byte pieces. Leading marks that no word piece took are joined last, as the
model has its mark runs at the lowest score.

Decoding joins the pieces' bytes through a table, bytes of byte pieces included, drops the mark put before the text
and turns marks into spaces.

Rows: null text counts as empty and gives begin and end ids alone; repeated rows repeat; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import text_slices

MARK = "▁"
#: Segments kept by a worker before its memo is emptied: some 150 MB.
MEMO_ENTRIES = 500_000
_NONE = np.int64(1) << 40
#: Characters from which on a segment is cut where no piece reaches, and its parts are merged one pair at a time.
LONG = 512

_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of one BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            spec.ParseFromString(source.read())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        self.plain = (
            trainer.model_type == 2 and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
            and norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces and kinds <= {1, 2, 3, 6}
        )
        if not self.plain:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback are supported")
        library = SentencePieceProcessor(model_file=path)
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.memo_entries, self.memo = memo_entries, {}
        names = [p.piece for p in spec.pieces]
        normal = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == 1}
        self.bytes_of = [b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        self.byte_ids = np.zeros(256, np.int64)
        for k, p in enumerate(spec.pieces):
            if p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[k] = k, bytes([value])
        self.unknown = next(k for k, p in enumerate(spec.pieces) if p.type == 2)
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that cross a word boundary are not supported")
        # Pieces of marks alone, if all share the lowest score, are joined at the end.
        runs = {len(p): k for p, k in normal.items() if p.strip(MARK) == "" and len(p) > 1}
        least = min((spec.pieces[k].score for p, k in normal.items() if len(p) > 1 and k not in runs.values()), default=0)
        tail = {spec.pieces[k].score for k in runs.values()}
        if runs and not (len(tail) == 1 and max(tail) < least):
            raise ValueError("mark runs of this model are not supported")
        self.runs = runs
        self._index(spec, normal)
        longer = [p for p in normal if len(p) > 1]
        self.newline_cuts = all("\n" not in p for p in longer)
        self.neighbours = {p[k : k + 2] for p in longer for k in range(len(p) - 1)}
        self.names = names

    def _parts(self, segment: str) -> list[str]:
        """A long segment cut between characters that stand side by side in no piece, so that no merge joins them."""
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.neighbours]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)]

    def _index(self, spec, normal: dict[str, int]) -> None:
        """Symbols are piece ids; other characters get numbers above. Pairs: sorted keys, result and rank."""
        self.char_ids = {p: k for p, k in normal.items() if len(p) == 1}
        merged = [(p, k) for p, k in normal.items() if len(p) > 1 and k not in set(self.runs.values())]
        scores = sorted({spec.pieces[k].score for _, k in merged}, reverse=True)
        rank = {score: r for r, score in enumerate(scores)}
        self.rank_of = np.full(len(spec.pieces), -1, np.int64)
        keys, results = [], []
        unsafe = np.zeros(len(spec.pieces), bool)
        for p, k in merged:
            self.rank_of[k] = rank[spec.pieces[k].score]
        for p, k in merged:
            for cut in range(1, len(p)):
                a, b = normal.get(p[:cut]), normal.get(p[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    results.append(k)
                    for part in (a, b):
                        unsafe[part] |= self.rank_of[part] >= self.rank_of[k]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_result = np.array(results, np.int64)[order]
        self.unsafe = unsafe
        # Open addressing would be no faster than a two-level table: rows of the first symbol.
        self.pair_rank = self.rank_of[self.pair_result]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of each adjacent pair; rank _NONE where there is no such piece."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left < len(self.names)) & (right < len(self.names))
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_result[at]

    def segments_of(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if not self.newline_cuts:
            return re.findall(f"{MARK}+[^{MARK}]*", marked)
        if MARK * 2 in marked or "\0" in marked:
            return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", marked)
        return marked.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")

    def merge(self, segments: Sequence[str]) -> list[np.ndarray]:
        """The ids of each segment, by merge rounds over all of them together."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        values, inverse = np.unique(codes, return_inverse=True)
        extra = len(self.names)
        table = np.array([self.char_ids.get(chr(v), extra + k) for k, v in enumerate(values)], np.int64)
        symbol = table[inverse] if len(codes) else codes
        owner = np.repeat(np.arange(len(segments)), lengths)
        done_symbol, done_owner, done_at = [], [], []
        place = np.arange(len(symbol))
        rank, result = self._pairs(symbol[:-1], symbol[1:]) if len(symbol) > 1 else (np.empty(0, np.int64),) * 2
        rank = np.where(owner[1:] == owner[:-1], rank, _NONE)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            padded = np.append(rank, _NONE)
            best = np.minimum.reduceat(padded, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            over = np.repeat(best == _NONE, sizes)
            if over.any():  # compaction: finished segments leave
                done_symbol.append(symbol[over])
                done_owner.append(owner[over])
                done_at.append(place[over])
                stay = ~over
                symbol, owner, place, padded, result = symbol[stay], owner[stay], place[stay], padded[stay], np.append(result, 0)[stay]
                if not len(symbol):
                    break
                best, sizes = best[best != _NONE], sizes[best != _NONE]
                starts = sizes.cumsum() - sizes
            else:
                result = np.append(result, 0)
            match = padded == np.repeat(best, sizes)
            at = np.flatnonzero(match)
            # Of pairs that overlap in a row, every other one from the left; of unsafe results, the first alone.
            begin = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
            group = begin.cumsum() - 1
            firsts = np.flatnonzero(begin)
            at = at[(np.arange(len(at)) - firsts[group]) % 2 == 0]
            risky = self.unsafe[result[at]]
            if risky.any():
                lead = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
                at = at[~risky | lead]
            symbol[at] = result[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # Only pairs beside a merge change their rank.
            moved = np.zeros(len(symbol), bool)
            moved[at] = True
            symbol, owner, place, moved = symbol[keep], owner[keep], place[keep], moved[keep]
            rank, result = padded[keep][:-1], result[keep][:-1]
            fresh = np.flatnonzero(moved[:-1] | moved[1:])
            new_rank, new_result = self._pairs(symbol[fresh], symbol[fresh + 1])
            rank[fresh] = np.where(owner[fresh] == owner[fresh + 1], new_rank, _NONE)
            result[fresh] = new_result
            # A kept pair whose right symbol is in the next segment stays without rank.
            rank[owner[1:] != owner[:-1]] = _NONE
        if not done_symbol:
            return [np.empty(0, np.int64)] * len(segments)
        symbol, owner, place = (np.concatenate(x) for x in (done_symbol, done_owner, done_at))
        order = np.argsort(place, kind="stable")
        symbol, owner = symbol[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(segments) + 1))
        out = np.split(symbol, edges[1:-1])
        odd = np.unique(owner[symbol >= extra])
        for k in odd.tolist():
            out[k] = self._with_bytes(out[k], extra, values)
        mark = self.char_ids.get(MARK)
        for k, segment in enumerate(segments):
            if segment[:1] == MARK and len(out[k]) > 1 and out[k][0] == mark and out[k][1] == mark:
                out[k] = self._with_runs(out[k], mark)
        return out

    def merge_one_by_one(self, segment: str) -> np.ndarray:
        """The ids of one segment by an agenda of pairs: for segments so long that rounds would be many."""
        extra = len(self.names)
        values = sorted({ord(c) for c in segment})
        number = {v: self.char_ids.get(chr(v), extra + k) for k, v in enumerate(values)}
        symbol = [number[ord(c)] for c in segment]
        before, after = list(range(-1, len(symbol) - 1)), [*range(1, len(symbol)), -1]
        agenda: list[tuple[int, int, int, int, int]] = []
        known = {}

        def offer(a: int, b: int) -> None:
            pair = (symbol[a], symbol[b])
            if pair not in known:
                rank, result = self._pairs(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = (int(rank[0]), int(result[0]))
            if known[pair][0] != _NONE:
                heapq.heappush(agenda, (known[pair][0], a, b, *pair))

        for k in range(len(symbol) - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, left, right = heapq.heappop(agenda)
            if symbol[a] != left or symbol[b] != right or after[a] != b:
                continue
            symbol[a], symbol[b] = known[left, right][1], -1
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        ids = np.array([s for s in symbol if s >= 0], np.int64)
        if (ids >= extra).any():
            ids = self._with_bytes(ids, extra, np.array(values))
        mark = self.char_ids.get(MARK)
        return self._with_runs(ids, mark) if len(ids) > 1 and ids[0] == mark and ids[1] == mark else ids

    def _with_bytes(self, ids: np.ndarray, extra: int, values: np.ndarray) -> np.ndarray:
        parts = []
        for k in ids.tolist():
            if k < extra:
                parts.append([k])
            else:
                parts.append(self.byte_ids[list(chr(values[k - extra]).encode("utf-8", "surrogatepass"))].tolist())
        return np.array([x for part in parts for x in part], np.int64)

    def _with_runs(self, ids: np.ndarray, mark: int) -> np.ndarray:
        other = np.flatnonzero(ids != mark)
        n = int(other[0]) if len(other) else len(ids)
        lengths: list[int] = []
        for _ in range(n):  # of equal scores the leftmost pair is joined first
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        lead = [self.runs.get(x, mark) for x in lengths]
        return np.concatenate([np.array(lead, np.int64), ids[n:]])

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text with begin and end ids, as little-endian uint32 bytes."""
        if len(self.memo) > self.memo_entries:
            self.memo = {}
        memo = self.memo
        memo[""] = b""
        cut = [self.segments_of(t) if t else [] for t in texts]
        for segments in cut:
            if any(len(s) > LONG for s in segments):
                segments[:] = [part for s in segments for part in (self._parts(s) if len(s) > LONG else (s,))]
        new = list({s for segments in cut for s in segments if s not in memo})
        for segment in [s for s in new if len(s) > LONG]:
            memo[segment] = self.merge_one_by_one(segment).astype("<u4").tobytes()
        new = [s for s in new if len(s) <= LONG]
        for first in range(0, len(new), 50_000):
            part = new[first : first + 50_000]
            memo.update(zip(part, (x.astype("<u4").tobytes() for x in self.merge(part)), strict=True))
        get = memo.__getitem__
        begin, end = (np.array([k], "<u4").tobytes() for k in (self.begin, self.end))
        return [begin + b"".join(map(get, segments)) + end for segments in cut]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian uint32 ids."""
        get = self.bytes_of.__getitem__
        raw = b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def codec(path: str) -> PieceCodec:
    """The worker process's codec of this model; it keeps its memo between tasks."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id", full: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model)
        for batch in batches:
            for first, texts in text_slices(batch):
                ids = pieces.encode(texts)
                back = [pieces.decode(x) for x in ids]
                columns = [
                    batch.column(0).slice(first, len(ids)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>, decoded string" if full else ""))
