"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits; bit b is 1 where over half of a text's shingle hashes (XXH64 of the UTF-8 shingle, seed 42) have
bit b. Shingles are runs of ``width`` words of the text with A-Z lower-cased, repeats included, joined by one space;
a text of fewer words is one shingle, and one without words has fingerprint zero.

Links: fingerprints at ``threshold`` (2) or fewer differing bits. The anchors are the words of a covering code of
length 64: nine blocks under the perfect Hamming (7,4) code and one free bit, so that each fingerprint has exactly
one anchor within the covering radius (nearest in every block). Where x and y differ in at most two bits, some z lies
within one bit of both; z's anchor is within the covering radius plus one of each. So every fingerprint is replicated
to the anchors of all words within one bit of it (some 25 of the 65 coincide in part), and any linked pair meets at an
anchor. At an anchor only, the fingerprints are compared.

Copies are folded before: anchors see distinct fingerprints, with no row per copy. A crowded anchor is compared
through its midpoints (fingerprints sharing one z are all linked), which needs a sort rather than all pairs and
finds the same classes. Each anchor gives star links, never all pairs of a class. Classes are joined by alternating
large-star and small-star rounds, which are written to the shared folder.

Similar texts (:func:`similar_groups`, :func:`drop_similar`) are found at the same anchors first; tables of least hashes
find those whose fingerprints differ in more bits, and whole shingle sets decide.

Odd rows: null text counts as empty; a null doc_id takes part, and the class id is the smallest non-null doc_id;
repeated rows give repeated results; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.names import unused
from millrace.llm.salting import salted_join
from millrace.llm.tokens import text_slices

BITS = 64
SEED = 42
_ODD = 0x9E3779B97F4A7C15
#: Fingerprints at one anchor from which on midpoints are sorted instead of comparing all pairs; results are the same.
CROWD = 512


def _spread_bytes() -> np.ndarray:
    """For each byte its eight bits as the eight bytes of a number, lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


_SPREAD = _spread_bytes()


def _shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts, one text after the other, and their count in each."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(xxhash.xxh64_intdigest(joined, SEED))
            counts[k] = 1
            continue
        ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
        begins = [0, *(ends[: -width] + 1).tolist()]
        slices = [joined[a:b] for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)]
        hashes.extend(map(xxhash.xxh64_intdigest, slices, repeat(SEED)))
        counts[k] = len(slices)
    return np.array(hashes, np.uint64), counts


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, one text after the other, and their count in each."""
    hashes, counts = _shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.bincount(owner[first], minlength=len(texts))


def signatures_of(texts: list[str], width: int = 3, lanes: int = 1) -> np.ndarray:
    """The signature of each text, ``lanes`` numbers of 64 bits; lane 0 is the fingerprint.

    Further lanes take the bits of hashes that are mixed anew from the first.
    """
    return _signed(*_shingle_hashes(texts, width), lanes)


def _signed(base: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros((len(counts), lanes), np.uint64)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return out
    mixed = [base]
    for lane in range(1, lanes):
        x = base + np.uint64(_ODD * (2 * lane + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed.append(x ^ (x >> np.uint64(31)))
    raw = np.stack(mixed, 1).astype("<u8").view(np.uint8)
    # Bits are counted in bytes, so in runs of 255 hashes at most; the runs of a text are added after.
    starts = counts[used].cumsum() - counts[used]
    runs = [np.arange(a, a + n, 255) for a, n in zip(starts.tolist(), counts[used].tolist(), strict=True)]
    begins = np.append(np.concatenate(runs), len(raw))
    parts = []
    for k in range(0, len(begins) - 1, 400):  # some 100,000 hashes at once, however long a text is
        edges = begins[k : k + 401]
        counted = np.add.reduceat(_SPREAD[raw[edges[0] : edges[-1]]], edges[:-1] - edges[0], axis=0)
        parts.append(counted.astype("<u8").view(np.uint8))
    parts = np.concatenate(parts)
    first = np.cumsum([0, *map(len, runs[:-1])])
    ones = np.add.reduceat(parts, first, axis=0, dtype=np.int64)
    bits = (2 * ones > counts[used][:, None]).astype(np.uint8)
    out[used] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def fingerprints_of(texts: list[str], width: int = 3) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    return signatures_of(texts, width)[:, 0]


def _nearest_words() -> np.ndarray:
    """For each value of seven bits the code word of the Hamming (7,4) code within one bit of it."""
    position = np.arange(1, 8)
    values = np.arange(128)
    syndrome = np.bitwise_xor.reduce(np.where((values[:, None] >> (position - 1)) & 1, position, 0), axis=1)
    return np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values).astype(np.uint64)


_NEAREST = _nearest_words()


def anchor_of(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The anchor of each word of ``bits`` bits: its nearest code word, by blocks of seven; bits left over are free."""
    blocks = bits // 7
    out = words & np.uint64(((1 << bits) - 1) >> (7 * blocks) << (7 * blocks))
    for block in range(blocks):
        shift = np.uint64(7 * block)
        out |= _NEAREST[((words >> shift) & np.uint64(127)).astype(np.int64)] << shift
    return out


def _flips(bits: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(bits, dtype=np.uint64)])


def replicas(words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every distinct anchor of the words within one bit of each."""
    anchors = np.sort(anchor_of(words[:, None] ^ _flips(bits), bits), axis=1)
    first = np.ones(anchors.shape, bool)
    first[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    rows = np.nonzero(first)[0]
    return rows, anchors[first]


def _pairs(anchor: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (smaller, larger fingerprint) of every anchor's list; rows sorted by (anchor, word)."""
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    sizes = np.diff(edges)
    left, right = [], []
    two = edges[:-1][sizes == 2]
    close = np.bitwise_count(word[two] ^ word[two + 1]) <= 2
    left.append(word[two][close])
    right.append(word[two + 1][close])
    for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        members = word[a : a + n]
        if n > CROWD:
            low, high = _by_midpoint(members)
        else:
            i, j = np.nonzero(np.triu(np.bitwise_count(members[:, None] ^ members[None, :]) <= 2, 1))
            # the first link of each row keeps the classes: a spanning forest of the anchor's own links
            low, high = _forest(members, i, j)
        left.append(low)
        right.append(high)
    return np.concatenate(left), np.concatenate(right)


def _forest(members: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = np.arange(len(members))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(members)))
    return members[label[rest]], members[rest]


def _by_midpoint(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (members[:, None] ^ _flips(BITS)).ravel()
    owner = np.repeat(members, BITS + 1)
    order = np.lexsort((owner, middle))
    middle, owner = middle[order], owner[order]
    same = middle[1:] == middle[:-1]
    both = np.unique(np.stack([owner[:-1][same], owner[1:][same]], 1), axis=0)
    return both[:, 0], both[:, 1]


def with_fingerprints(docs: DataFrame, *, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed bigint) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch):
                words = fingerprints_of(texts, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(words)], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join every linked class, from the column fp."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            for first in range(0, len(words), 8192):
                part = words[first : first + 8192]
                rows, anchors = replicas(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(part[rows].view(np.int64))], names=["anchor", "fp"]
                )

    return (
        distinct.select("fp")
        .mapInArrow(spread, "anchor bigint, fp bigint")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "fp")
        .mapInArrow(lambda batches: _by_anchor(batches, _pairs), "a bigint, b bigint")
        .distinct()
    )


def _by_anchor(
    batches: Iterator[pa.RecordBatch], compare: Callable[..., tuple[np.ndarray, np.ndarray]]
) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by their first column; ``compare`` gets whole lists of anchors, never a part of one."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if len(columns[0]) == 0:
            continue
        last = int(np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[-1])
        held = [c[last:] for c in columns]
        if last:
            yield _as_links(*compare(*(c[:last] for c in columns)))
    if held is not None:
        yield _as_links(*compare(*held))


def _as_links(low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["a", "b"])


def _salted_join(rows: DataFrame, by: str, spread: str, table: DataFrame, on: str) -> DataFrame:
    return salted_join(rows, F.col(by) == F.col(on), F.col(spread), table)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of the class, which maps to itself.

    Alternates large-star and small-star steps until a round leaves the links as they were (told by their number and two
    sums of 64-bit hashes); both keep what is connected. Minima are aggregated before the exchange and joined back over
    salted keys, so that a star's centre, however large, is dealt over several tasks.
    """
    spark = links.sparkSession
    edges = scratch.written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links"
    )

    def state(edges: DataFrame) -> tuple:
        hashes = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
        return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())

    now = state(edges)
    for _ in range(rounds):
        start = scratch.mark()
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = _salted_join(both.filter(F.col("v") > F.col("u")), "u", "v", least, "k")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.written(large, "large-star")
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (
            _salted_join(large, "u", "v", small_least, "k").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_least.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        done = scratch.since(start)
        edges = scratch.written(small, "small-star")
        scratch.discard(spark, done)
        before, now = now, state(edges)
        if before == now:
            break
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v"), F.col("v")))


def near_duplicate_groups(docs: DataFrame, *, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = scratch.written(with_fingerprints(docs, width=width, text=text, key=key), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = components(fingerprint_links(distinct))
    named = scratch.written(
        distinct.join(classes, F.col("fp") == F.col("node"), "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        ),
        "classes",
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    by_word = named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return marked.join(by_word, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Lanes of 64 bits in the signatures that :func:`similar_groups` compares.
LANES = 4
#: Nodes of a group that are tested against as many others in one list, by signatures and by sets.
SIGNED_BLOCK, BLOCK = 64, 512
#: Hashes on one side of a list of sets, and in one pass over those of both sides: what bounds a worker's memory where
#: sets are large.
HASHES, PASS = 1 << 21, 1 << 18
#: Bytes of sets that a worker gets at once.
BATCH_BYTES = 4 << 20


#: Tables of a word of ROWS least hashes each. A pair of Jaccard 0.8 misses all of them once in 2e9 pairs.
TABLES, ROWS = 54, 5
#: Nodes with fewer shingles than this may differ in more bits, as sums of few hashes are often zero.
FEW = 32
_MIXERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, TABLES * ROWS), dtype=np.uint64)


def table_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set of hashes a word for each table: equal in two sets with the chance Jaccard ** ROWS. Empty sets: 0."""
    out = np.zeros((len(counts), TABLES), np.uint64)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return out
    starts = counts[used].cumsum() - counts[used]
    for t in range(TABLES):
        word = np.full(len(used), _ODD * (t + 1) % 2**64, np.uint64)
        for k in range(t * ROWS, (t + 1) * ROWS):
            mixed = (hashes ^ _MIXERS[0, k]) * (_MIXERS[1, k] | np.uint64(1))
            word = (word ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0xBF58476D1CE4E5B9)
            word ^= word >> np.uint64(29)
        out[used, t] = word
    return out


def most_bits(similarity: float, miss: float = 1e-9) -> tuple[int, int]:
    """Signature bits in which a pair of the Jaccard similarity differs at most, but for ``miss`` of pairs: (any, few).

    A bit differs with probability acos(2 s / (1 + s)) / pi for large sets. Sums of hashes that are zero raise that:
    by a twentieth at most from FEW shingles on, and by a quarter for four shingles against five, the worst case.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = []
    for raised in (1.05, 1.25):
        p, left, bits = min(0.5, raised * differ), 1.0, -1
        while left > miss:
            bits += 1
            left = sum(math.comb(64 * LANES, k) * p**k * (1 - p) ** (64 * LANES - k) for k in range(bits + 1, 64 * LANES + 1))
        out.append(bits)
    return out[0], out[1]


def _alike(words: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray, bits: tuple[int, int], similarity: float) -> np.ndarray:
    """Which rows may have the similarity to which others, by signatures (a column for each lane) and sizes of the sets."""
    apart = sum(np.bitwise_count(words[:, None, k] ^ others[None, :, k]).astype(np.int16) for k in range(words.shape[1]))
    less, more = np.minimum(sizes[:, None], other_sizes[None]), np.maximum(sizes[:, None], other_sizes[None])
    return (apart <= np.where(less < FEW, bits[1], bits[0])) & (less >= similarity * more - 1e-6)


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The number of hashes that each sorted set shares with each of the others; a range of hashes at a time."""
    passes = max(1, -(-sum(map(len, [*sets, *others])) // PASS))
    cuts = np.array([(k << 64) // passes for k in range(1, passes)], np.uint64)
    edges = [[np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]) for x in side] for side in (sets, others)]
    out = np.zeros((len(sets), len(others)), np.float32)
    for k in range(passes):
        _add_common(out, *([x[e[k] : e[k + 1]] for x, e in zip(side, at, strict=True)] for side, at in zip((sets, others), edges, strict=True)))
    return out


def _add_common(out: np.ndarray, sets: list[np.ndarray], others: list[np.ndarray]) -> None:
    rows, columns = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (sets, others))
    _, value = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    mine, theirs = value[: len(rows)], value[len(rows) :]
    met = np.zeros(int(value.max()) + 1 if len(value) else 0, np.int8)
    met[mine] |= 1
    met[theirs] |= 2
    number = np.cumsum(met == 3) - 1  # of the hashes on both sides
    keep_a, keep_b = met[mine] == 3, met[theirs] == 3
    rows, mine, columns, theirs = rows[keep_a], number[mine[keep_a]], columns[keep_b], number[theirs[keep_b]]
    a, b = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    rows, mine, columns, theirs = rows[a], mine[a], columns[b], theirs[b]
    for start in range(0, int((met == 3).sum()), 4096):
        pair = []
        for at, which, n in ((rows, mine, len(sets)), (columns, theirs, len(others))):
            x, y = np.searchsorted(which, [start, start + 4096])
            held = np.zeros((n, 4096), np.float32)
            held[at[x:y], which[x:y] - start] = 1
            pair.append(held)
        out += pair[0] @ pair[1].T


def _spanning(nodes: np.ndarray, others: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the matrix ``linked`` of nodes and others joins: fewer than there are nodes and others."""
    members, at = np.unique(np.concatenate([nodes, others]), return_inverse=True)
    i, j = np.nonzero(linked)
    return _forest(members, at[i], at[len(nodes) + j])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Lists of rows sorted by (group, row block, column block, side): each one's rows of side 0 and of side 1."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        side = batch.column(3).to_numpy()
        for a, b in zip([0, *edges.tolist()], edges.tolist()):
            cut = a + int(np.searchsorted(side[a:b], 1))
            if a < cut < b:
                yield batch.slice(a, cut - a), batch.slice(cut, b - cut)
        held = batch.slice(edges[-1] if len(edges) else 0)
    if held is not None:
        cut = int(np.searchsorted(held.column(3).to_numpy(), 1))
        if 0 < cut < held.num_rows:
            yield held.slice(0, cut), held.slice(cut)


def _dealt(rows: DataFrame, columns: list[str], size: int, weight: Column | None = None, most: int = 1) -> DataFrame:
    """Rows (group, node, rest, and ``columns``) as lists for :func:`_lists`, which hold each pair of a rest row and any row of its group.

    A group's rows are dealt into blocks of some ``size`` nodes, and of ``weight`` ``most`` together, and so are its rest
    rows; each pair of such blocks is a list, so no task holds a group.
    """
    share = F.lit(1 / size) if weight is None else F.greatest(F.lit(1 / size), weight / F.lit(most))
    shares = [F.sum(share).alias("n_all"), F.sum(F.when(F.col("rest"), share).otherwise(0.0)).alias("n_rest")]
    sizes = rows.groupBy(F.col("group").alias("g")).agg(*shares).filter("n_rest > 0")
    known = _salted_join(rows, "group", "node", sizes, "g")
    blocks = [F.ceil(F.col(n) - F.lit(1e-6)).cast("bigint") for n in ("n_rest", "n_all")]
    mine = [F.pmod(F.xxhash64(F.lit(k), "node"), n) for k, n in enumerate(blocks)]
    every = [F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)) for n in blocks]
    sides = [
        known.filter("rest").select("group", mine[0].alias("i"), every[1].alias("j"), F.lit(0).alias("side"), "node", *columns),
        known.select("group", every[0].alias("i"), mine[1].alias("j"), F.lit(1).alias("side"), "node", *columns),
    ]
    return sides[0].union(sides[1]).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side")


_SIGNATURE = ["size", *(f"s{k}" for k in range(LANES))]


def _signed_nodes(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """n and the signature of each of the nodes (a column node)."""
    known = nodes.select("node").distinct().withColumnRenamed("node", "n")
    found = marked.select("node", *_SIGNATURE).join(known, F.col("node") == F.col("n"), "left_semi")
    return found.groupBy(F.col("node").alias("n")).agg(*(F.first(c).alias(c) for c in _SIGNATURE))


def _anchor_links(marked: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes with fingerprints (lane 0) at two or fewer differing bits, which meet at anchors."""
    heads = marked.groupBy(F.col("s0").alias("fp")).agg(F.min("node").alias("head"), F.max("node").alias("most"))
    heads = scratch.written(heads, "fingerprint-heads")
    links = _salted_join(fingerprint_links(heads), "a", "b", heads.select(F.col("fp").alias("x"), F.col("head").alias("low")), "x")
    links = _salted_join(links, "b", "a", heads.select(F.col("fp").alias("y"), F.col("head").alias("high")), "y")
    shared = heads.filter("head != most").select("fp", "head")
    equal = _salted_join(marked.select("node", "s0"), "s0", "node", shared, "fp").filter("node != head")
    return links.select(F.col("low").alias("a"), F.col("high").alias("b")).union(equal.select("head", "node")).distinct()


def _candidate_links(marked: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all nodes which meet at a table's word and have signatures that allow the similarity.

    Words whose nodes are all of one class of anchor links, ``known`` (node, root), have nothing to add. At each other word its smallest node is the pivot, and the others are tested against it. Nodes that differ from their
    pivot are tested against all nodes at the word, in blocks. Words and nodes alone are exchanged for that;
    signatures only of nodes that meet others.
    """
    bits = most_bits(similarity)
    words = marked.select(F.explode("words").alias("key"), "node")
    classes = known.select(F.col("node").alias("n"), "root")
    classed = salted_join(marked.select("node", "words", "doc_id", "tag"), F.col("node") == F.col("n"), F.struct("doc_id", "tag"), classes, "left")
    classed = classed.select(F.explode("words").alias("key"), "node", F.coalesce("root", "node").alias("class"))
    pivots = classed.groupBy("key").agg(F.min("node").alias("pivot"), F.min("class").alias("least"), F.max("class").alias("most")).filter("least != most")
    met = _salted_join(words, "key", "node", pivots.select(F.col("key").alias("k"), "pivot"), "k").select("key", "pivot", "node")
    met = scratch.written(met.filter("node != pivot").distinct(), "met")
    pairs = met.select("pivot", "node").distinct()
    signed = scratch.written(_signed_nodes(marked, met.select("node").union(met.select("pivot"))), "met-signatures")
    mine = [F.col(c).alias(f"p_{c}") for c in _SIGNATURE]
    tested = _salted_join(pairs, "pivot", "node", signed.select(F.col("n").alias("p"), *mine), "p").drop("p")
    tested = tested.join(signed, F.col("node") == F.col("n"))
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"p_s{k}"))) for k in range(LANES)), F.lit(0))
    less, more = F.least("size", "p_size"), F.greatest("size", "p_size")
    close = (apart <= F.when(less < FEW, bits[1]).otherwise(bits[0])) & (less >= F.lit(similarity) * more - 1e-6)
    tested = scratch.written(tested.select("pivot", "node", close.alias("close")), "pivot-tests")
    far = tested.filter("not close").select(F.col("pivot").alias("f_pivot"), F.col("node").alias("f_node"))
    here = (F.col("pivot") == F.col("f_pivot")) & (F.col("node") == F.col("f_node"))
    rows = met.join(far, here, "left").select(F.col("key").alias("group"), "node", F.col("f_node").isNotNull().alias("rest"))
    # Words with a far node only; their close nodes are kept as partners.
    rows = scratch.written(rows, "met-rest")
    lists = _dealt(rows, [], SIGNED_BLOCK).select("group", "i", "j", "side", "node")
    lists = lists.join(signed, F.col("node") == F.col("n")).select("group", "i", "j", "side", "node", *_SIGNATURE)
    lists = lists.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _lists(batches):
            nodes, sizes, signs = zip(*((
                x.column(4).to_numpy(), x.column(5).to_numpy(), np.stack([x.column(6 + k).to_numpy() for k in range(LANES)], 1).view(np.uint64)
            ) for x in sides), strict=True)
            linked = _alike(signs[0], sizes[0], signs[1], sizes[1], bits, similarity) & (nodes[0][:, None] != nodes[1])
            if linked.any():
                yield _as_links(*_spanning(*nodes, linked))

    found = lists.mapInArrow(compare, "a bigint, b bigint")
    return found.union(tested.filter("close").select("pivot", "node")).distinct()


def _verified(marked: DataFrame, links: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the nodes of exact Jaccard ``similarity`` within each candidate class (node, root).

    Whole shingle sets decide. A class's node with most candidate links is its pivot, and all others are tested against
    it. Those that are similar to it are joined by that; the others are tested against every node of the class, in blocks.
    """
    degrees = links.select(F.col("a").alias("d")).union(links.select(F.col("b").alias("d"))).groupBy("d").agg(F.count(F.lit(1)).alias("degree"))
    members = classes.join(degrees, F.col("node") == F.col("d")).select(F.col("node").alias("m"), "root", "degree")
    texts = marked.select("node", "text").join(members, F.col("node") == F.col("m")).groupBy("node", "root", "degree").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch, characters=500_000):
                hashes, counts = shingle_sets(part, width)
                ends = counts.cumsum().tolist()
                held = [hashes[b - n : b].tobytes() for b, n in zip(ends, counts.tolist(), strict=True)]
                columns = [batch.column(k).slice(first, len(part)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.binary())], names=["node", "root", "degree", "held"])

    sets = texts.select("node", "root", "degree", "text").mapInArrow(cut, "node bigint, root bigint, degree bigint, held binary")
    sets = scratch.written(sets, "class-sets")
    pivots = sets.groupBy("root").agg(F.max(F.struct("degree", "node")).alias("best")).select(F.col("root").alias("r"), F.col("best.node").alias("pivot"))
    pivots = pivots.join(sets.select(F.col("node").alias("n"), F.col("held").alias("p_held")), F.col("pivot") == F.col("n")).select("r", "pivot", "p_held")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                close.append(common >= similarity * (len(x) + len(y) - common) - 1e-6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(close, pa.bool_())], names=["node", "root", "pivot", "close"])

    beside = _salted_join(sets, "root", "node", pivots, "r").filter("node != pivot").select("node", "root", "pivot", "held", "p_held")
    tested = beside.mapInArrow(test, "node bigint, root bigint, pivot bigint, close boolean")
    tested = scratch.written(tested, "class-tests", batch_bytes=BATCH_BYTES)
    flags = tested.select(F.col("node").alias("t"), F.col("root").alias("group"), (~F.col("close")).alias("rest"))
    rows = flags.join(sets.select("node", "held"), F.col("t") == F.col("node")).select("group", "node", "rest", "held")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _lists(batches):
            nodes = [x.column(4).to_numpy() for x in sides]
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.column(5)] for x in sides]
            sizes = [np.array([len(x) for x in part], np.int64) for part in sets]
            common = _common(*sets)
            union = sizes[0][:, None] + sizes[1][None] - common
            linked = (common >= similarity * union - 1e-6) & (union > 0) & (nodes[0][:, None] != nodes[1])
            if linked.any():
                yield _as_links(*_spanning(*nodes, linked))

    lists = _dealt(rows, ["held"], BLOCK, F.octet_length("held") / 8, HASHES)
    found = scratch.written(lists.mapInArrow(compare, "a bigint, b bigint"), "class-links", batch_bytes=BATCH_BYTES)
    return found.union(tested.filter("close").select("pivot", "node")).distinct()


def _similar_classes(docs: DataFrame, width: int, similarity: float, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, node) of every document, and (n, root): the class of every node that is linked to another."""
    names = _SIGNATURE[1:]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, characters=500_000):
                hashes, counts = shingle_sets(texts, width)
                found = _signed(hashes, counts, LANES).view(np.int64)
                ends = counts.cumsum().tolist()
                node = [xxhash.xxh64_intdigest(hashes[b - n : b].tobytes(), SEED) for b, n in zip(ends, counts.tolist(), strict=True)]
                columns = [batch.column(k).slice(first, len(texts)) for k in range(2)]
                columns += [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(counts.astype(np.int64))]
                columns += [pa.array(found[:, k]) for k in range(LANES)]
                words = table_words(hashes, counts).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, len(words) + 1, TABLES, dtype=np.int32), words)
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(texts)], names=["doc_id", "tag", "node", *_SIGNATURE, "words", "text"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_tag(F.col(text)).alias("tag"), F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{n} bigint" for n in ("doc_id", "tag", "node", "size", *names))
    marked = scratch.written(rows.mapInArrow(mark, f"{schema}, words array<bigint>, text string"), "signatures")
    near = scratch.written(_anchor_links(marked), "anchor-links")
    known = scratch.written(components(near), "anchor-classes")
    links = scratch.written(_candidate_links(marked, known, similarity).union(near).distinct(), "candidate-links")
    candidates = scratch.written(components(links), "candidate-classes")
    verified = components(_verified(marked, links, candidates, width, similarity)).withColumnRenamed("node", "n")
    return marked.select("doc_id", "tag", "node"), scratch.written(verified, "similar-classes")


def text_tag(text: Column) -> Column:
    """A hash that tells apart texts of one doc_id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar_groups(
    docs: DataFrame, *, width: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable over similar texts).

    Texts are similar if the sets of their shingles have the Jaccard ``similarity``. Fingerprints over the sets meet at
    anchors first, and those at two or fewer differing bits make classes. For similarities at which fingerprints differ in
    more bits than that, the classes then meet in TABLES tables, at words of ROWS least hashes of their sets each, and
    signatures of 256 bits over the sets are compared there. All this only finds candidates, and the tables and the
    signatures lose a pair of just that similarity with a chance of some 1e-9 each, at any corpus size (for 0.8 and
    above). Within a class of candidates pairs are tested by their whole sets, and only those that pass are linked. Equal sets (by a 64-bit
    hash) are one node. A doc_id that repeats with several texts takes part with each.
    """
    marked, classes = _similar_classes(docs, width, similarity, text, key)
    named = marked.join(classes, F.col("node") == F.col("n"), "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    named = scratch.written(named, "similar-documents")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    return _salted_join(named, "root", "doc_id", least, "r").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, without those that are similar to one that stays, over a chain of similar texts.

    Of each class the document of smallest doc_id stays (of several texts of that doc_id, one); rows are dropped by
    doc_id and text, so a doc_id that repeats with other texts loses none of those. Rows that repeat a doc_id and a set
    of shingles stay or go together; rows without doc_id stay.
    """
    marked, classes = _similar_classes(docs, width, similarity, text, key)
    named = marked.filter("doc_id IS NOT NULL").join(classes, F.col("node") == F.col("n"), "left")
    named = scratch.written(named.select("doc_id", "tag", "node", F.coalesce("root", "node").alias("root")), "similar-documents")
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("stays")).select(F.col("root").alias("r"), "stays")
    gone = _salted_join(named, "root", "tag", least, "r").filter(F.struct("doc_id", "node") != F.col("stays"))
    names = [unused(docs.columns, "_dropped"), unused(docs.columns, "_tag")]
    gone = scratch.written(gone.select(F.col("doc_id").alias(names[0]), F.col("tag").alias(names[1])).distinct(), "similar-dropped")
    same = (docs[key] == gone[names[0]]) & (text_tag(docs[text]) == gone[names[1]])
    return docs.join(gone, same, "left_anti")
