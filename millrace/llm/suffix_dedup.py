"""Exact substring deduplication by a sparse suffix array, built with a common-prefix-aware distributed merge sort.

A byte is removed if a ``length``-byte string that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Strings never cross documents and are judged on the input.

1. Suffix starts. Sorting every suffix of a corpus moves many times its size, so suffixes start at anchors only: in
   every window of ``length`` bytes the leftmost of the ``gram``-byte strings with the least hash (winnowing). Equal
   windows have their anchor at the same place, so no repeat is lost. Anchors whose gram is found once in the whole
   corpus cannot belong to a repeat and drop out; grams are exchanged as 64-bit hashes for that, nothing else.
2. Runs. Where the texts are, the suffix of each remaining anchor is taken: its bytes to the right, then those to the
   left in reverse order, both as far as the anchor's own windows reach, behind the gram's hash. A run of them is
   sorted; equal suffixes fold to the earliest, and the others are wholly covered by it. The sorted run is
   front-coded (length of the prefix shared with the suffix before, and the rest), cut by bucket of the hash, and
   exchanged. Equal suffixes of some megabytes of text fold before that, where anchors are found, so the anchors of a very
   common passage are few rows for each task.
3. Merge. The runs of a bucket are merged by a loser tree that knows, of every contender, the prefix it shares with
   the last winner; contenders are compared by these lengths, and bytes only from there on. Out come the suffixes in
   order with their common prefix lengths, as a suffix array and LCP array of the bucket.
4. Windows. For each offset of a window around its anchor, intervals of the LCP array hold the anchors that agree to
   the right; those that agree to the left too (64-bit hashes of the bytes within the interval) are one class. All but
   the earliest window of a class are repeats.

A task holds one bucket's front-coded runs; a suffix shared by any number of documents is one row for each run. There is
a bucket for some ``BUCKET_ROWS`` anchors, so buckets don't grow with the corpus, and they are dealt to tasks evenly.

Hot grams. All suffixes of one gram are in one bucket. Grams with over ``HOT_ROWS`` anchors and a millionth of all (a
phrase that very many documents share, each in other surroundings; fewer than a million by that) therefore go
another way: their anchors are found again where the texts are, so no text is exchanged for them. Each window around
such an anchor is known by two 64-bit hashes of its bytes, equal suffixes and equal windows fold within a task's slice
of texts, and what is left is aggregated by hash; all but the earliest window of a class are repeats.

Rows: null text counts as empty; rows that repeat a doc_id and text are judged as one document and each is returned;
rows that share a doc_id with other texts are ordered by text hash; a null doc_id comes before all others; an empty
table gives an empty result. Cut texts are decoded from the bytes that stay, without characters of which a part went.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm import scratch

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 24
_PLACE_MASK = np.uint64((1 << _PLACE_BITS) - 1)
_BLOCK = 1 << 20  # bytes that are hashed at once
BUCKET_ROWS = 100_000
HOT_ROWS = 20_000


def _byte_hashes() -> np.ndarray:
    """A 64-bit number for each byte, by the splitmix generator."""
    x = np.arange(1, 257, dtype=np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_HASH = _byte_hashes()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes, by doubling."""
    hashes, width = _BYTE_HASH[data], 1
    while 2 * width <= gram:
        hashes = _joined(hashes[:-width], hashes[width:])
        width *= 2
    if width < gram:
        hashes = _joined(hashes[: len(data) - gram + 1], hashes[gram - width :])
    return hashes


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _ODD
    out += right
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``data``: anchor places, first and last window start of each, and the gram's hash."""
    hashes = gram_hashes(data, gram)
    least = (hashes & ~_PLACE_MASK) | np.arange(len(hashes), dtype=np.uint64)
    width, most = 1, length - gram + 1
    while 2 * width <= most:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < most:
        least = np.minimum(least[: len(hashes) - most + 1], least[most - width :])
    place = (least & _PLACE_MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], first, last, hashes[place[first]]


def document_anchors(texts: Sequence[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, place, greatest and least offset of its windows, hash) of all anchors of some documents."""
    out: list[tuple[np.ndarray, ...]] = []
    block: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not block:
            return
        sizes = np.array([len(x) for _, _, x in block])
        data = np.frombuffer(b"".join(x for _, _, x in block), np.uint8)
        ends = sizes.cumsum()
        place, first, last, hashes = anchors(data, length, gram)
        # Of a run of windows with one anchor, those that lie in the anchor's own document stay.
        owner = np.searchsorted(ends, place, side="right")
        begins = ends - sizes
        first, last = np.maximum(first, begins[owner]), np.minimum(last, ends[owner] - length)
        keep = last >= first
        number = np.array([d for d, _, _ in block])[owner]
        shift = np.array([o for _, o, _ in block])[owner] - begins[owner]
        out.append(tuple(x[keep] for x in (number, place + shift, place - first, place - last, hashes)))
        block.clear()

    held = 0
    for d, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), _BLOCK):
            part = text[start : start + _BLOCK + length - 1]
            if len(part) < length:
                continue
            if held + len(part) > 2 * _BLOCK:
                flush()
                held = 0
            block.append((d, start, part))
            held += len(part)
    flush()
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Form:
    """How a suffix is laid out: hash, bytes to the right, bytes to the left reversed, offsets of its windows."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.left = length - gram  # greatest offset of a window's start before its anchor
        self.right_at, self.left_at = 8, 8 + length
        self.offsets_at = self.left_at + self.left
        self.width = -(-(self.offsets_at + 2) // 8) * 8

    def suffixes(self, data: np.ndarray, begin: np.ndarray, place: np.ndarray, high: np.ndarray, low: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The matrix of suffixes at ``begin + place`` of the joined documents ``data``."""
        out = np.zeros((len(place), self.width), np.uint8)
        # Selected hashes are small ones; mixed again they spread evenly over the buckets.
        out[:, :8] = _joined(hashes, hashes ^ (hashes >> np.uint64(32))).astype(">u8").view(np.uint8).reshape(-1, 8)
        at = (begin + place)[:, None]
        right, left = np.arange(self.length), np.arange(self.left)
        found = data[np.minimum(at + right, len(data) - 1)]
        out[:, 8 : self.left_at] = np.where(right < (self.length - low)[:, None], found, 0)
        found = data[np.maximum(at - 1 - left, 0)]
        out[:, self.left_at : self.offsets_at] = np.where(left < high[:, None], found, 0)
        out[:, self.offsets_at], out[:, self.offsets_at + 1] = high, low
        return out


_HEAD = struct.Struct("<IIIQ")


def front_coded(rows: np.ndarray, owner: np.ndarray, at: np.ndarray) -> bytes:
    """A sorted run of suffixes (no two equal) as shared prefix lengths, owners, places and the bytes behind, packed.

    An owner is a row of one or more numbers.
    """
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    body = b"".join((shared.tobytes(), owner.astype("<i8").tobytes(), at.astype("<i8").tobytes(), rest.tobytes()))
    return _HEAD.pack(len(rows), rows.shape[1], owner.size // max(1, len(rows)), len(body)) + pa.compress(body, codec="zstd", asbytes=True)


class _Run:
    """A front-coded run, decoded one suffix at a time."""

    def __init__(self, raw: bytes):
        n, self.width, numbers, size = _HEAD.unpack_from(raw)
        raw = pa.decompress(raw[_HEAD.size :], decompressed_size=size, codec="zstd", asbytes=True)
        self.n, self.raw, self.k = n, raw, -1
        self.shared = raw[:n]
        self.owner = np.frombuffer(raw, "<i8", numbers * n, n).reshape(n, numbers)
        self.at = np.frombuffer(raw, "<i8", n, n + 8 * numbers * n)
        self.next = n + 8 * (numbers + 1) * n
        self.text = b""

    def advance(self) -> bool:
        self.k += 1
        if self.k >= self.n:
            return False
        shared = self.shared[self.k]
        end = self.next + self.width - shared
        self.text = self.text[:shared] + self.raw[self.next : end]
        self.next = end
        return True


def _compare(a: bytes, b: bytes, known: int) -> tuple[int, bool]:
    """(common prefix length, whether a goes first) of two strings that share ``known`` bytes."""
    x, y = a[known:], b[known:]
    if x == y:
        return len(a), True
    n = len(x)
    p, q = int.from_bytes(x, "big"), int.from_bytes(y, "big")
    return known + (8 * n - (p ^ q).bit_length()) // 8, p < q


def merge_runs(blobs: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs by a loser tree over common prefixes: rows, owners, places, prefix shared with the row before.

    Each contender keeps ``known``, the prefix it shares with the last winner. The larger one wins unread, as all
    contenders follow that winner; where two are equal, bytes are compared from there on, and the loser keeps the
    prefix that it shares with the one that beat it.
    """
    runs = [run for run in map(_Run, blobs) if run.advance()]
    count = len(runs)
    known = [0] * count
    texts, owners, places, shared = [], [], [], []
    if count == 0:
        return np.empty((0, 0), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    alive = [True] * count
    text = [run.text for run in runs]
    size = 1
    while size < count:
        size *= 2
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two contenders; the loser's known prefix is brought up to date."""
        if a < 0 or not alive[a]:
            return b, a
        if b < 0 or not alive[b]:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        common, first = _compare(text[a], text[b], known[a])
        if first:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    level = [*range(count), *[-1] * (size - count)]
    node = size
    while len(level) > 1:
        node //= 2
        above = []
        for k in range(0, len(level), 2):
            winner, loser = play(level[k], level[k + 1])
            losers[node + k // 2] = loser
            above.append(winner)
        level = above
    winner = level[0]
    while winner >= 0 and alive[winner]:
        run = runs[winner]
        texts.append(text[winner])
        shared.append(known[winner])
        owners.append(run.owner[run.k])
        places.append(run.at[run.k])
        if run.advance():
            text[winner], known[winner] = run.text, run.shared[run.k]
        else:
            alive[winner] = False
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if other >= 0 and alive[other]:
                if not alive[winner]:
                    winner, losers[node] = other, winner
                elif known[winner] != known[other]:
                    if known[other] > known[winner]:
                        winner, losers[node] = other, winner
                else:
                    winner, losers[node] = play(winner, other)
            node //= 2
    rows = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return rows, np.array(owners, np.int64), np.array(places, np.int64), np.array(shared, np.int64)


def pack_place(place: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A place and the offsets of its windows (7 bits each)."""
    return (place << 14) | (high << 7) | low


def unpack_place(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, high, low)"""
    return at >> 14, (at >> 7) & 127, at & 127


def _spans(owner: np.ndarray, twin: np.ndarray, place: np.ndarray, flags: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(owner, twin, first byte, end) of the runs of flagged offsets of each anchor."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return owner[row], twin[row], place[row] - (high - 1), place[row] - low + length


def repeated_windows(form: _Form, rows: np.ndarray, owner: np.ndarray, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the windows of a merged bucket that occur earlier; an owner is a doc_id and a twin."""
    place, high, low = unpack_place(at)
    owner, twin = owner.reshape(-1, 2).T
    flags = np.zeros((len(rows), form.left + 1), bool)
    right = shared - 8
    right[0] = -8
    alone = np.append(right < form.gram, True)
    busy = ~(alone[:-1] & alone[1:])
    by = np.lexsort((place, twin, owner))
    order = np.empty(len(rows), np.int64)
    # Equal places of a document rank alike: a window is no repeat of itself.
    order[by] = np.append(0, np.any([x[by][1:] != x[by][:-1] for x in (owner, twin, place)], axis=0)).cumsum()
    left = np.zeros(len(rows), np.uint64)
    for a in range(form.left + 1):
        if a:
            left = _joined(left, _BYTE_HASH[rows[:, form.left_at + a - 1]])
        group = (right < form.length - a).cumsum().astype(np.uint64)
        some = np.flatnonzero(busy & (low <= a) & (a <= high))
        if len(some) < 2:
            continue
        key = _joined(left[some], group[some] * _ODD)
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        least = np.minimum.reduceat(order[some[by]], np.flatnonzero(new))
        flags[some[by], a] = order[some[by]] > least[new.cumsum() - 1]
    return _spans(owner, twin, place, flags, form.length)


def _documents(docs: DataFrame, text: str, key: str, carry: bool = False, once: bool = False) -> DataFrame:
    """_key, _twin, _null and _text of each document, and with ``carry`` its other columns as _rest.

    _twin tells apart documents that share a doc_id: the text's hash, or a number next to it where hashes meet. With ``once``, rows that repeat a doc_id and text are one.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("_key"),
        F.col(key).isNull().alias("_null"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
        *([F.struct(*rest).alias("_rest")] if carry else []),
    )
    shared = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key")
    shared = scratch.written(shared, "shared-ids")
    if shared.isEmpty():
        return rows.withColumn("_twin", F.lit(0).cast("bigint"))
    # Only documents that share an id are told apart, by text hash; a window holds texts of one hash, not of one id.
    marked = rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_sha", F.sha2("_text", 256))
    distinct = marked.join(shared, "_key", "left_semi").select("_key", "_hash", "_sha").distinct()
    order = Window.partitionBy("_key", "_hash").orderBy("_sha")
    numbered = distinct.select(
        F.col("_key").alias("_k"), F.col("_sha").alias("_s"), (F.col("_hash") + (F.row_number().over(order) - 1)).alias("_twin")
    )
    numbered = scratch.written(numbered, "twins")
    joined = marked.join(numbered, (F.col("_key") == F.col("_k")) & (F.col("_sha") == F.col("_s")), "left")
    if once:
        folded = joined.filter(F.col("_k").isNotNull()).dropDuplicates(["_key", "_twin"])
        joined = joined.filter(F.col("_k").isNull()).union(folded)
    return joined.select(*rows.columns, F.coalesce("_twin", F.lit(0).cast("bigint")).alias("_twin"))


def _numpy(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _slices(texts: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``size`` bytes of text together."""
    ends = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size)))
        yield start, stop
        start = stop


def _later_twins(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which suffixes equal, byte by byte, one of smaller ``order``."""
    words = rows.view("<u8")
    key = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        key = _joined(key, words[:, k])
    by = np.lexsort((order, key))
    new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
    first = by[np.flatnonzero(new)[new.cumsum() - 1]]
    out = np.zeros(len(rows), bool)
    out[by] = ~new & (rows[by] == rows[first]).all(axis=1)
    return out


def _settled(form: _Form, raw: Sequence[bytes], keys: np.ndarray, twins: np.ndarray, found: Sequence[np.ndarray]) -> np.ndarray:
    """Which of the anchors ``found`` (as :func:`document_anchors` gives them) have a whole suffix equal to an earlier one's."""
    number, place, high, low, hashes = found
    out = np.zeros(len(hashes), bool)
    data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw[:-1])])
    order = np.empty(len(hashes), np.int64)
    order[np.lexsort((place, twins[number], keys[number]))] = np.arange(len(hashes))
    for k in range(0, len(hashes), 50_000):
        part = slice(k, k + 50_000)
        rows = form.suffixes(data, begins[number[part]], place[part], high[part], low[part], hashes[part])
        out[part] = _later_twins(rows, order[part])
    return out


def _candidates(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, _key, at, _twin, settled) of every anchor whose gram hash occurs twice or more.

    Of a gram that repeats within some megabytes of text, one anchor goes to the partition of its hash; the others are
    known to repeat and are dealt evenly, so that a passage in a third of all documents loads no task. Those whose whole
    suffix equals an earlier one's there are settled: all their windows are repeats, and the earlier one stands for them.
    """
    form = _Form(length, gram)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins, texts = _numpy(batch.column(0)), _numpy(batch.column(1)), batch.column(2).cast(pa.binary())
            for a, b in _slices(texts):
                raw = texts.slice(a, b - a).to_pylist()
                anchored = number, place, high, low, hashes = document_anchors(raw, length, gram)
                at = pack_place(place, high, low)
                settled = np.zeros(len(hashes), bool)
                _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
                often = np.flatnonzero(count[which] > 1)
                if len(often):
                    settled[often] = _settled(form, raw, keys[a:b], twins[a:b], [x[often] for x in anchored])
                open_first = np.flatnonzero(~settled)
                _, first, left = np.unique(hashes[open_first], return_index=True, return_counts=True)
                known = np.ones(len(hashes), np.int8)
                known[open_first[first]] = np.where(left > 1, 2, 0)
                route = np.where(known == 1, _joined(hashes, at.view(np.uint64) * _ODD), hashes)
                columns = (route.view(np.int64), known, hashes.view(np.int64), keys[a:b][number], at, twins[a:b][number], settled)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["route", "known", "h", "_key", "at", "_twin", "settled"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, of which the next one decides
        before = None  # the hash of the row before it
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            h = _numpy(batch.column(1))
            same = h[1:] == h[:-1]
            keep = np.append(same, False) | np.concatenate([[before is not None and before == h[0]], same])
            keep |= _numpy(batch.column(0)) > 0
            held, n = batch.slice(len(h) - 1), len(h) - 1
            if n:
                before = h[n - 1]
                yield batch.slice(0, n).filter(pa.array(keep[:n])).select(["h", "_key", "at", "_twin", "settled"])
        if held is not None and (held.column(0)[0].as_py() > 0 or (before is not None and before == held.column(1)[0].as_py())):
            yield held.select(["h", "_key", "at", "_twin", "settled"])

    rows = documents.select("_key", "_twin", "_text").mapInArrow(find, "route bigint, known tinyint, h bigint, _key bigint, at bigint, _twin bigint, settled boolean")
    dealt = rows.repartition("route").sortWithinPartitions("h").select("known", "h", "_key", "at", "_twin", "settled")
    return dealt.mapInArrow(repeated, "h bigint, _key bigint, at bigint, _twin bigint, settled boolean")


def _with_anchors(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """_key, _twin, _text and found, a list of (h, at), of the documents with candidates."""
    grouped = candidates.groupBy(F.col("_key").alias("_k"), F.col("_twin").alias("_t")).agg(F.collect_list(F.struct("h", "at")).alias("found"))
    texts = documents.select("_key", "_twin", "_text")
    joined = texts.join(grouped, (F.col("_key") == F.col("_k")) & (F.col("_twin") == F.col("_t")))
    return joined.select("_key", "_twin", "_text", "found")


def _anchored_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of the rows of :func:`_with_anchors`: joined bytes, and of each anchor its text's begin, owner, hash and at."""
    for batch in batches:
        owners = np.stack((_numpy(batch.column(0)), _numpy(batch.column(1))), 1)
        texts, found = batch.column(2).cast(pa.binary()), batch.column(3)
        for a, b in _slices(texts):
            raw = texts.slice(a, b - a).to_pylist()
            data = np.frombuffer(b"".join(raw), np.uint8)
            begins = np.cumsum([0, *map(len, raw[:-1])])
            lists = found.slice(a, b - a)
            entries = lists.flatten()
            number = np.repeat(np.arange(b - a), pa.compute.list_value_length(lists).to_numpy())
            yield data, begins[number], owners[a:b][number], _numpy(entries.field(0)).view(np.uint64), _numpy(entries.field(1))


def _hot_spans(documents: DataFrame, hot: np.ndarray, length: int, gram: int, salts: int = 16) -> DataFrame:
    """(_k, _t, first, end): repeated windows around anchors of the ``hot`` grams, which are found again in the texts."""
    form = _Form(length, gram)
    names = ["w1", "w2", "_key", "_twin", "first", "end", "open"]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins, texts = _numpy(batch.column(0)), _numpy(batch.column(1)), batch.column(2).cast(pa.binary())
            for a, b in _slices(texts):
                raw = texts.slice(a, b - a).to_pylist()
                found = document_anchors(raw, length, gram)
                some = np.isin(found[4], hot)
                if not some.any():
                    continue
                found = [x[some] for x in found]
                settled = _settled(form, raw, keys[a:b], twins[a:b], found)
                # All windows of a settled anchor are repeats, and make one span.
                number, place, high, low, _ = (x[settled] for x in found)
                zero = np.zeros(len(place), np.int64)
                columns = (zero, zero, keys[a:b][number], twins[a:b][number], place - high, place - low + length, zero.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                number, place, high, low, _ = (x[~settled] for x in found)
                many = high - low + 1
                row = np.repeat(np.arange(len(place)), many)
                offset = high[row] - (np.arange(len(row)) - np.repeat(many.cumsum() - many, many))
                start = place[row] - offset
                key, twin = keys[a:b][number[row]], twins[a:b][number[row]]
                data, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw[:-1])])
                where = begins[number[row]] + start
                one, two = (gram_hashes(x, length)[where] for x in (data, data ^ np.uint8(255)))
                order = np.lexsort((start, twin, key, two, one))
                one, two, key, twin, start = (x[order] for x in (one, two, key, twin, start))
                fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
                columns = (one.view(np.int64), two.view(np.int64), key, twin, start, start + length, fresh)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    schema = "w1 bigint, w2 bigint, _key bigint, _twin bigint, first bigint, end bigint, open boolean"
    found = scratch.written(documents.select("_key", "_twin", "_text").mapInArrow(windows, schema), "hot-windows")
    spans = [F.col("_key").alias("_k"), F.col("_twin").alias("_t"), "first", "end"]
    place = F.struct("_key", "_twin", "first")
    kept = found.filter("open").withColumn("_salt", F.pmod(F.xxhash64("_key", "_twin"), F.lit(salts)).cast("int"))
    classes = kept.groupBy(F.col("w1").alias("_w1"), F.col("w2").alias("_w2")).agg(F.min(place).alias("least"), F.max(place).alias("most"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_other")
    classes = classes.filter(F.col("least") != F.col("most")).select("_w1", "_w2", "least", every)
    same = (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")) & (F.col("_salt") == F.col("_other"))
    later = kept.join(classes, same).filter(place > F.col("least"))
    return found.filter("not open").select(*spans).union(later.select(*spans))


def _even_keys(spark: SparkSession, partitions: int) -> list[int]:
    """For each partition a number that Spark's hash partitioning sends there."""
    wanted = 32 * partitions
    while True:
        numbers = spark.range(wanted).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("p"))
        found = {r.p: r.id for r in numbers.groupBy("p").agg(F.min("id").alias("id")).collect()}
        if len(found) == partitions:
            return [found[p] for p in range(partitions)]
        wanted *= 4


def _runs(documents: DataFrame, candidates: DataFrame, form: _Form, buckets: int, run_rows: int, keys: list[int]) -> DataFrame:
    """(bucket, lane, blob) rows: front-coded runs, and with bucket -1 - x spans that are settled already.

    A lane is one of ``keys``, and sends its buckets to one task.
    """
    joined = _with_anchors(documents, candidates)

    def sort(rows: np.ndarray, owner: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
        words = rows.view(">u8").astype(np.uint64)
        place, _, _ = unpack_place(at)
        order = np.lexsort((place, owner[:, 1], owner[:, 0], *words.T[::-1]))
        rows, owner, at = rows[order], owner[order], at[order]
        same = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1)])
        if same.any():
            place, high, low = (x[same] for x in unpack_place(at))
            twice = (owner[same] == owner[np.flatnonzero(same) - 1]).all(axis=1) & (at[same] == at[np.flatnonzero(same) - 1])
            flags = (np.arange(form.left + 1) >= low[:, None]) & (np.arange(form.left + 1) <= high[:, None]) & ~twice[:, None]
            spans = np.stack(_spans(*owner[same].T, place, flags, form.length)).astype("<i8")
            yield -1 - int(rows[0, 7]), spans.tobytes()
        rows, owner, at = rows[~same], owner[~same], at[~same]
        bucket = _bucket(rows, buckets)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edges, edges[1:]):
            yield int(bucket[a]), front_coded(rows[a:b], owner[a:b], at[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            made = list(sort(*(np.concatenate(x) for x in zip(*parts, strict=True))))
            parts.clear()
            lanes = [keys[b * len(keys) // buckets if b >= 0 else b % len(keys)] for b, _ in made]
            columns = [pa.array([b for b, _ in made], pa.int64()), pa.array(lanes, pa.int64()), pa.array([x for _, x in made], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "lane", "blob"])

        for data, begins, owners, hashes, at in _anchored_slices(batches):
            for k in range(0, len(at), run_rows):
                part = slice(k, k + run_rows)
                place, high, low = unpack_place(at[part])
                rows = form.suffixes(data, begins[part], place, high, low, hashes[part])
                parts.append((rows, owners[part], at[part]))
                held += len(rows)
                if held >= run_rows:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return joined.mapInArrow(run, "bucket bigint, lane bigint, blob binary")


def _bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each suffix: an even share of the range of hashes, so that order is kept."""
    return (np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64) * buckets) >> 32


def _merged(runs: DataFrame, form: _Form, partitions: int) -> DataFrame:
    """(_k, _t, first, end): spans to remove, from merged buckets and those settled before."""

    def out(owner: np.ndarray, twin: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        columns = (owner, twin, first, end)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_k", "_t", "first", "end"])

    def merge(blobs: list[bytes]) -> pa.RecordBatch:
        rows, owner, at, shared = merge_runs(blobs)
        return out(*repeated_windows(form, rows, owner, at, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    yield out(*np.frombuffer(blob, "<i8").reshape(4, -1))
                    continue
                if bucket != current and blobs:
                    yield merge(blobs)
                    blobs = []
                current = bucket
                blobs.append(blob)
        if blobs:
            yield merge(blobs)

    dealt = runs.repartition(partitions, "lane").sortWithinPartitions("bucket").select("bucket", "blob")
    return dealt.mapInArrow(run, "_k bigint, _t bigint, first bigint, end bigint")


def repeated_spans(documents: DataFrame, length: int, gram: int, run_rows: int = 100_000) -> DataFrame:
    """(_k, _t, first, end): spans of repeated windows, which may overlap, written to the shared folder."""
    form, spark = _Form(length, gram), documents.sparkSession
    found = scratch.written(_candidates(documents, length, gram), "repeated-grams")
    candidates = found.filter("not settled")
    count = candidates.count()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // (4 * BUCKET_ROWS))
    buckets = max(4 * partitions, count // BUCKET_ROWS)
    often = candidates.groupBy(F.col("h").alias("_hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HOT_ROWS, count // 1_000_000))
    often = scratch.written(often.select("_hot"), "hot-grams")
    hot = not often.isEmpty()
    plain = candidates.join(F.broadcast(often), F.col("h") == F.col("_hot"), "left_anti") if hot else candidates  # under a million
    spans = _merged(_runs(documents, plain, form, buckets, run_rows, _even_keys(spark, partitions)), form, partitions)
    if hot:
        grams = np.array([r._hot for r in often.collect()], np.int64).view(np.uint64)
        spans = spans.union(_hot_spans(documents, grams, length, gram))
    place, high, low = F.shiftright("at", 14), F.shiftright("at", 7).bitwiseAND(127), F.col("at").bitwiseAND(127)
    done = found.filter("settled").select(F.col("_key").alias("_k"), F.col("_twin").alias("_t"), (place - high).alias("first"), (place - low + length).alias("end"))
    return scratch.written(spans.union(done), "repeated-spans")


def _cut(raw: bytes, first: Sequence[int], end: Sequence[int]) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal removed runs)"""
    kept, done, removed, runs = [], 0, 0, 0
    for a, b in sorted(zip(first, end, strict=True)):
        if a > done or runs == 0:
            kept.append(raw[done:a])
            runs += 1
            done = a
        if b > done:
            removed += b - done
            done = b
    kept.append(raw[done:])
    return b"".join(kept), removed, runs


def _with_spans(docs: DataFrame, length: int, gram: int, text: str, key: str, carry: bool) -> DataFrame:
    """The documents of :func:`_documents` with lists first and end of the spans to remove, or nulls."""
    if not 8 <= gram <= length <= 127 + gram or length > 200:
        raise ValueError("gram must be 8 or more, and length 200 or less and at most gram + 127")
    spans = repeated_spans(_documents(docs, text, key, once=True), length, gram)
    grouped = spans.groupBy("_k", "_t").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end"))
    documents = _documents(docs, text, key, carry)
    return documents.join(grouped, (F.col("_key") == F.col("_k")) & (F.col("_twin") == F.col("_t")), "left")


def _cut_batches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[tuple[int, bytes, int, int]]]]:
    """(first row, [(bytes, what stays, bytes removed, runs)]) for slices of a batch with text, first, end from ``at``."""
    texts = batch.column(at).cast(pa.binary())
    for a, b in _slices(texts):
        columns = (c.slice(a, b - a).to_pylist() for c in (texts, batch.column(at + 1), batch.column(at + 2)))
        yield a, [(len(raw), *_cut(raw, first or (), end or ())) for raw, first, end in zip(*columns, strict=True)]


def remove_repeats(docs: DataFrame, *, length: int = 100, gram: int = 32, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)."""
    joined = _with_spans(docs, length, gram, text, key, carry=False)
    joined = joined.select(F.when(~F.col("_null"), F.col("_key")).alias("doc_id"), "_text", "first", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, made in _cut_batches(batch, 1):
                columns = [
                    batch.column(0).slice(a, len(made)),
                    *(pa.array([m[k] for m in made], pa.int64()) for k in (0, 2, 3)),
                    pa.array([hashlib.sha256(m[1]).hexdigest() for m in made]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, *, length: int = 100, gram: int = 32, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with all their columns, and in the text column what stays (null counts as empty)."""
    joined = _with_spans(docs, length, gram, text, key, carry=True).select("_rest", "_text", "first", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, made in _cut_batches(batch, 1):
                kept = pa.array([m[1].decode("utf-8", "ignore") for m in made])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(made)), kept], names=["_rest", "_kept"])

    schema = StructType([joined.schema["_rest"], StructField("_kept", StringType())])
    cut = joined.mapInArrow(run, schema)
    return cut.select(*(F.col("_kept").alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
