"""Best-fit packing of token pieces into sequences by bin completion.

A document's ids (and an end id) are one piece, or, if longer than the capacity, full pieces and a last shorter one.
What has to be decided depends on the lengths alone, and there are at most ``capacity`` of them: their counts over all
pieces are the whole problem, solved on the driver in memory that does not grow with the corpus. The answer is a list
of patterns (how many pieces of which lengths make one sequence) with a number of copies. Pieces are then dealt to
patterns by their rank among the pieces of their length, which takes no exchange of texts or ids.

The solver (:func:`solve`) works on counts. Best-fit decreasing gives the incumbent, a waste bound the least number of
sequences; where they agree the incumbent is optimal. Otherwise bin completion searches: take the largest length left,
enumerate the undominated fillings of the room beside it, least waste first, and branch on them; a branch is cut
where the sequences so far and the bound of the rest reach the incumbent, and a filling is cut where its waste is
more than an improvement could afford. While more than ``exact_pieces`` pieces are left, the best filling is taken with as many copies as the
counts allow, so that branching is left for the last pieces. ``nodes`` bounds the search, and ``head_nodes`` the fillings looked at for each pattern before the last pieces;
neither drops a piece, as the incumbent packs all of them.

Rows: null and empty texts are a piece of the end id alone; repeated rows and null doc_ids are packed like others;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.tokens import encoder, text_slices

#: Rows of task, length and first rank (24 bytes each) up to which they are broadcast, so that no ids are exchanged.
BROADCAST_ROWS = 250_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), lengths falling
Counts = dict[int, int]


def least_sequences(counts: Counts, capacity: int) -> int:
    """The waste bound: sequences needed even if small pieces could be cut at will around large ones."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    large = sorted((s for s in counts if 2 * s > capacity), reverse=True)
    for limit in {0, *(capacity - s for s in large), *(s for s in counts if 2 * s <= capacity)}:
        alone = sum(counts[s] for s in large if s > capacity - limit)  # nothing of at least limit fits beside
        halves = [s for s in large if s <= capacity - limit]
        n_halves = sum(counts[s] for s in halves)
        room = n_halves * capacity - sum(s * counts[s] for s in halves)
        small = sum(s * n for s, n in counts.items() if limit <= s and 2 * s <= capacity)
        best = max(best, alone + n_halves + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: each length goes to the tightest sequences it fits in."""
    open_at: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    flags = bytearray(capacity + 1)  # whether a sequence with this room is open

    def put(pattern: Pattern, copies: int, room: int) -> None:
        if copies:
            open_at[room].append((pattern, copies))
            flags[room] = True

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = flags.find(1, size)
            if room < 0:
                each = capacity // size
                put(((size, each),), left // each, capacity - each * size)
                if left % each:
                    put(((size, left % each),), 1, capacity - left % each * size)
                left = 0
                continue
            pattern, copies = open_at[room].pop()
            flags[room] = bool(open_at[room])
            each = room // size
            used = min(copies, left // each)
            put((*pattern, (size, each)), used, room - each * size)
            left -= used * each
            if used < copies and left < each and left:
                put((*pattern, (size, left)), 1, room - left * size)
                used, left = used + 1, 0
            put(pattern, copies - used, room)
    return [x for row in open_at.values() for x in row]


def fillings(counts: Counts, room: int, most_waste: int, budget: list[int]) -> list[tuple[int, Pattern]]:
    """Undominated fillings of ``room`` as (waste, pattern), least waste first.

    A filling is dominated if a piece left out fits in place of a smaller one, or of two smaller ones, in it.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    rising = sizes[::-1]
    rest = np.cumsum([s * counts[s] for s in rising])[::-1].tolist() + [0] if sizes else [0]
    found: list[tuple[int, Pattern]] = []

    def left_out(low: int, high: int, used: dict[int, int]) -> bool:
        """Whether a piece of a length from low to high is not in the filling."""
        for k in range(bisect_left(rising, low), len(rising)):
            if rising[k] > high:
                return False
            if used.get(rising[k], 0) < counts[rising[k]]:
                return True
        return False

    def undominated(waste: int, chosen: list[tuple[int, int]]) -> bool:
        used = dict(chosen)
        inside = sorted(used)
        if left_out(1, waste, used) or any(left_out(y + 1, y + waste, used) for y in inside):
            return False
        pairs = ((y, z) for k, y in enumerate(inside) for z in inside[k:] if y != z or used[y] > 1)
        return not any(left_out(y + z, y + z + waste, used) for y, z in pairs)

    def walk(k: int, left: int, chosen: list[tuple[int, int]]) -> None:
        for j in range(max(k, len(sizes) - bisect_right(rising, left)), len(sizes)):
            if budget[0] <= 0 or left - rest[j] > most_waste:  # even all that remains leaves too much waste
                break
            for n in range(min(counts[sizes[j]], left // sizes[j]), 0, -1):
                budget[0] -= 1
                walk(j + 1, left - n * sizes[j], [*chosen, (sizes[j], n)])
        if left <= most_waste and undominated(left, chosen):
            found.append((left, tuple(chosen)))

    walk(0, room, [])
    return sorted(found, key=lambda x: (x[0], [(-s, -n) for s, n in x[1]]))


def _take(counts: Counts, pattern: Pattern, copies: int) -> Counts:
    out = dict(counts)
    for s, n in pattern:
        out[s] -= n * copies
        if not out[s]:
            del out[s]
    return out


def _around(size: int, filling: Pattern) -> Pattern:
    total = Counter(dict(filling))
    total[size] += 1
    return tuple(sorted(total.items(), reverse=True))


def solve(counts: Counts, capacity: int, *, exact_pieces: int = 60, nodes: int = 200_000, head_nodes: int = 300) -> list[tuple[Pattern, int]]:
    """Patterns and copies that pack every piece; see the module's text."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    bound = least_sequences(counts, capacity)
    if sum(c for _, c in incumbent) == bound:
        return incumbent
    head: list[tuple[Pattern, int]] = []
    rest = counts
    while sum(rest.values()) > exact_pieces:
        size = max(rest)
        one = _take(rest, ((size, 1),), 1)
        options = fillings(one, capacity - size, capacity, [head_nodes])
        pattern = _around(size, options[0][1] if options else ())
        copies = min(rest[s] // n for s, n in pattern)
        head.append((pattern, copies))
        rest = _take(rest, pattern, copies)
    tail = best_fit(rest, capacity)
    best, used = [tail], [sum(c for _, c in tail)]
    budget = [nodes]

    def branch(left: Counts, done: list[Pattern]) -> None:
        if not left:
            if len(done) < used[0]:
                best[0], used[0] = [(p, 1) for p in done], len(done)
            return
        if budget[0] <= 0 or len(done) + least_sequences(left, capacity) >= used[0]:
            return
        fit = best_fit(left, capacity)
        if len(done) + sum(c for _, c in fit) < used[0]:
            best[0], used[0] = [*((p, 1) for p in done), *fit], len(done) + sum(c for _, c in fit)
        size = max(left)
        one = _take(left, ((size, 1),), 1)
        spare = (used[0] - 1 - len(done)) * capacity - sum(s * n for s, n in left.items())
        for _, filling in fillings(one, capacity - size, spare, budget):
            branch(_take(one, filling, 1), [*done, _around(size, filling)])

    branch(rest, [])
    searched = head + best[0]
    return min(incumbent, searched, key=lambda plan: sum(c for _, c in plan))


def _places(plan: list[tuple[Pattern, int]]) -> list[tuple[int, ...]]:
    """Rows (length, first rank, rank behind the last, pieces a copy, first sequence, offset in it)."""
    rows, seen, sequence = [], Counter(), 0
    for pattern, copies in plan:
        offset = 0
        for size, each in pattern:
            first = seen[size]
            seen[size] += each * copies
            rows.append((size, first, seen[size], each, sequence, offset))
            offset += size * each
        sequence += copies
    return rows


def cut_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int | None, text: str = "text", key: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, their task and rank in it by length, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, texts in text_slices(batch):
                rows, out = [], []
                for k, raw in enumerate(enc.encode(texts)):
                    ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((first + k, piece, start, len(part), zlib.crc32(part.tobytes()), int(seen[len(part)])))
                        seen[len(part)] += 1
                        if with_ids:
                            out.append(part.astype(np.int32))
                if not rows:
                    continue
                row, piece, start, length, crc, nth = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                columns = [
                    batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc),
                    pa.array(np.full(len(row), task)), pa.array(nth),
                ]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 4096,
    end_id: int | None = 1,
    text: str = "text",
    key: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if wanted."""
    pieces = scratch.written(
        cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, text=text, key=key, with_ids=with_ids), "pieces"
    )
    by_task = scratch.written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most one row per length reaches the driver.
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    columns = "_size bigint, _from bigint, _to bigint, _each bigint, _sequence bigint, _offset bigint"
    places = docs.sparkSession.createDataFrame(_places(solve(counts, capacity)), columns)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    firsts = by_task.select(
        F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    )
    if by_task.count() <= BROADCAST_ROWS:  # beyond, pieces are exchanged by task and length
        firsts = F.broadcast(firsts)
    joined = pieces.join(firsts, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")))
    ranked = joined.withColumn("_rank", F.col("_first") + F.col("nth"))
    # A few rows for each of at most ``capacity`` lengths, at any corpus size.
    here = (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(places), here)
    within = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.expr("(_rank - _from) div _each")).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + within % F.col("_each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
