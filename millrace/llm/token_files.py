"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in falling corpus frequency (ties: the smaller id first), counted over every
document. Ranks below 256 take one byte, others ``wide`` bytes (2 where the vocabulary has at most 65,536 ids).
Control bytes stand apart from data bytes: one bit an id, lowest first, tells a wide id. A reader looks each control
byte up in tables of offsets and lengths, so it decodes eight ids a step in numpy without a branch.

A data set is a folder: ``ranks-*.bin`` (little-endian uint32 ids by rank), shards ``shard-*.mrt`` in ascending
doc_id order and the Parquet table ``manifest`` (path, order, doc and id counts). A shard holds, for each document,
its control bytes then its data bytes, and behind them an index (doc_id, null flag, ids, data bytes of each document)
and a footer. Shards are written under a temporary name and renamed, and the manifest is committed by Spark, so
a task that is run again leaves at most an unlisted file.

Rows: null text counts as empty; an empty text is its end id alone. Rows with equal doc_id are kept, in an
order that their ids alone decide, and fill as many shards as they need; rows without doc_id come first. Extra columns of the input are ignored. An empty table gives an empty
manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.tokens import encoder, text_slices

MAGIC = b"MRTIDS01"
FOOTER = struct.Struct("<QQQI8s")  # documents, ids, index offset, wide, magic
#: Ids that are counted or coded at once, if no document has more.
SLICE = 1 << 18
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _tables(wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: where its eight ids' bytes begin, and how many bytes they take."""
    sizes = 1 + _BITS * (wide - 1)
    ends = sizes.cumsum(axis=1)
    return ends - sizes, ends[:, -1]


def encode_ranks(ranks: np.ndarray, wide: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    long = ranks > 255
    control = np.packbits(long, bitorder="little").tobytes()
    sizes = np.where(long, wide, 1)
    ends = sizes.cumsum()
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - sizes
    data[begins] = ranks & 255
    at, rest = begins[long], ranks[long]
    for k in range(1, wide):
        data[at + k] = (rest >> (8 * k)) & 255
    return control, data.tobytes()


def encode_documents(ranks: np.ndarray, counts: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Many documents' ranks, one after the other, as bytes and the end of each one's: as :func:`encode_ranks` gives them."""
    long = ranks > 255
    control = -(-counts // 8)
    ends = counts.cumsum()
    before = np.concatenate([[0], np.where(long, wide, 1).cumsum()])  # data bytes before each id
    data = before[ends] - before[ends - counts]
    stops = (control + data).cumsum()
    starts = stops - control - data
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    # Bits, with each document's padded to whole bytes.
    padded = np.zeros(int(control.sum()) * 8, bool)
    padded[np.arange(len(ranks)) + np.repeat(8 * (control.cumsum() - control) - (ends - counts), counts)] = long
    spot = np.arange(len(padded) // 8)
    out[spot + np.repeat(starts - (control.cumsum() - control), control)] = np.packbits(padded, bitorder="little")
    begins = before[:-1] + np.repeat(starts + control - before[ends - counts], counts)
    out[begins] = ranks & 255
    at, rest = begins[long], ranks[long]
    for k in range(1, wide):
        out[at + k] = (rest >> (8 * k)) & 255
    return out, stops


def decode_documents(block: np.ndarray, control: np.ndarray, counts: np.ndarray, stops: np.ndarray, wide: int, tables=None) -> np.ndarray:
    """The inverse of :func:`encode_documents`: the ranks of documents with so many control bytes and ids, and such ends.

    Looks up the control bytes of all documents at once, as :func:`decode_ranks` does for one.
    """
    begins, totals = tables or _tables(wide)
    first = control.cumsum() - control  # control bytes of the documents before
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    flags = block[np.arange(int(control.sum())) + np.repeat(starts - first, control)]
    # Bytes of groups of eight ids; the last one of a document may count bytes beyond its end, which none of its ids takes.
    group = totals[flags]
    sums = np.concatenate([[0], group.cumsum()])
    base = sums[:-1] + np.repeat(starts + control - sums[first], control)
    held = np.repeat(8 * first - (counts.cumsum() - counts), counts) + np.arange(int(counts.sum()))
    at = (base[:, None] + begins[flags]).ravel()[held]
    long = np.flatnonzero(np.unpackbits(flags, bitorder="little")[held])
    ranks = block[at].astype(np.uint32)
    for k in range(1, wide):
        ranks[long] |= block[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int, wide: int, tables=None) -> np.ndarray:
    """The inverse of :func:`encode_ranks`, by table lookup."""
    begins, totals = tables or _tables(wide)
    group = totals[control]
    at = ((group.cumsum() - group)[:, None] + begins[control]).ravel()[:n]
    long = np.flatnonzero(np.unpackbits(control, count=n, bitorder="little"))
    ranks = data[at].astype(np.uint32)
    for k in range(1, wide):
        ranks[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: its folder, rank file, bytes of a wide id and manifest."""

    folder: str
    ranks: str
    wide: int
    manifest: DataFrame


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, crc (of the ids' bytes, to order equal keys), ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            keys = batch.column(0)
            for first, texts in text_slices(batch):
                raw = [x + end for x in enc.encode(texts)]
                crc = [zlib.crc32(x) for x in raw]
                counts = pa.array([len(x) // enc.dtype.itemsize for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, len(raw)).cast(pa.int64()), counts, pa.array(crc, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "n_tokens", "crc", "ids"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, crc bigint, ids binary")


def id_frequencies(tokens: DataFrame, itemsize: int, size: int) -> np.ndarray:
    """How often each id of the vocabulary occurs in all documents. The driver gets one row per id used."""
    dtype = f"<u{itemsize}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = _joined_ids(batch.column(0), dtype)[0]
            for first in range(0, len(ids), SLICE):
                total += np.bincount(ids[first : first + SLICE], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in rows.collect():
        out[row.id] = row.n
    return out


def _joined_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column's rows, one row after the other, and their count in each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype), np.zeros(len(column), np.int64)
    step = np.dtype(dtype).itemsize
    ids = np.frombuffer(column.buffers()[2], dtype, int(offsets[-1] - offsets[0]) // step, int(offsets[0]))
    return ids, np.diff(offsets) // step


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = None,
    *,
    folder: str | None = None,
    text: str = "text",
    key: str = "doc_id",
    shard_bytes: int = 16 << 20,
) -> TokenFiles:
    """Encode every whole text and write the data set; shards aim at ``shard_bytes`` of ids of two bytes."""
    spark = docs.sparkSession
    folder = folder or scratch.new_folder(spark, "token-files")
    enc = encoder(tokenizer)
    itemsize, dtype = enc.dtype.itemsize, enc.dtype.str
    tokens = scratch.written(tokenized(docs, tokenizer, end_id, text, key), "tokens")
    counts = id_frequencies(tokens, itemsize, enc.size)
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    rank_of = np.empty(enc.size, np.uint32)
    rank_of[by_rank] = np.arange(enc.size, dtype=np.uint32)
    wide = max(2, (int(enc.size - 1).bit_length() + 7) // 8)

    ranks_path = f"{folder}/ranks-{uuid.uuid4().hex}.bin"
    store, at = _open(ranks_path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(by_rank.tobytes())

    shards = max(1, -(-int(counts.sum()) * 2 // shard_bytes))
    inner = [k / shards for k in range(1, shards)]
    lowest = float(-(1 << 63))  # null ids come first
    quantiles = tokens.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).cast("double").alias("k")).approxQuantile
    cuts = sorted(quantiles("k", inner, max(1e-5, 0.05 / shards))) if inner else []
    ranks = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            ids, keys = batch.column(3), batch.column(0)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            place = np.where(null, lowest, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            order = np.searchsorted(cuts, place, side="right")
            # Rows of one id (or of none) that fill several shards are dealt over those by their checksum.
            filled = order - np.searchsorted(cuts, place, side="left")
            several = (filled > 1) & (null | (np.abs(place) < 1 << 53))
            order = order - np.where(several, _numbers(batch.column(2)) % np.maximum(filled, 1), 0)
            found, counts = _joined_ids(ids, dtype)
            ends = np.concatenate([[0], counts.cumsum()])
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
                n = last - first
                data, stops = encode_documents(table[found[ends[first] : ends[last]]], counts[first:last], wide)
                offsets = np.concatenate([[0], stops]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(order[first : first + n], pa.int64()),
                        keys.slice(first, n),
                        batch.column(1).slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                    ],
                    names=["shard", "doc_id", "n_tokens", "crc", "payload"],
                )
                first = last

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            number = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if writer is None or writer.number != number[a]:
                    if writer is not None:
                        yield writer.close()
                    writer = _ShardWriter(folder, int(number[a]), wide)
                writer.add(batch.slice(a, b - a))
        if writer is not None:
            yield writer.close()

    coded_rows = tokens.mapInArrow(coded, "shard bigint, doc_id bigint, n_tokens bigint, crc bigint, payload binary")
    manifest = (
        coded_rows.repartition(max(shards, 1), "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n_tokens", "crc")
        .select("shard", "doc_id", "n_tokens", "payload")
        .mapInArrow(write, "shard bigint, path string, n_docs bigint, n_ids bigint")
    )
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return TokenFiles(folder, ranks_path, wide, spark.read.parquet(path))


class _ShardWriter:
    def __init__(self, folder: str, number: int, wide: int):
        self.number, self.wide, self.offset, self.rows = number, wide, len(MAGIC), []
        self.path = f"{folder}/shard-{number:08d}-{uuid.uuid4().hex}.mrt"
        self.store, self.at = _open(self.path)
        self.out = self.store.open_output_stream(self.at + ".tmp")
        self.out.write(MAGIC)

    def add(self, batch: pa.RecordBatch) -> None:
        payload = batch.column(3)
        for raw in payload:
            self.offset += self.out.write(raw.as_buffer())
        n_ids = batch.column(2).to_numpy()
        sizes = np.diff(np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1])
        self.rows.append((
            batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False), n_ids, sizes - -(-n_ids // 8),
        ))

    def close(self) -> pa.RecordBatch:
        keys, nulls, n_ids, data = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        for column, kind in ((keys, "<i8"), (nulls, "u1"), (n_ids, "<i8"), (data, "<i8")):
            self.out.write(column.astype(kind).tobytes())
        self.out.write(FOOTER.pack(len(keys), int(n_ids.sum()), self.offset, self.wide, MAGIC))
        self.out.close()
        self.store.move(self.at + ".tmp", self.at)
        return pa.RecordBatch.from_pydict(
            {"shard": [self.number], "path": [self.path], "n_docs": [len(keys)], "n_ids": [int(n_ids.sum())]}
        )


def read_shard(path: str, block_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks of a shard: doc_ids, null flags and each document's ranks, in file order."""
    store, at = _open(path)
    with store.open_input_file(at) as source:
        end = source.size()
        source.seek(end - FOOTER.size)
        n, _, index, wide, magic = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(0)
        if magic != MAGIC or source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token shard")
        source.seek(index)
        raw = source.read(25 * n)
        keys = np.frombuffer(raw, "<i8", n)
        nulls = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        n_ids = np.frombuffer(raw, "<i8", n, 9 * n)
        control = -(-n_ids // 8)
        ends = (control + np.frombuffer(raw, "<i8", n, 17 * n)).cumsum()
        tables = _tables(wide)
        source.seek(len(MAGIC))
        first = done = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, done + block_bytes, side="right")))
            block = np.frombuffer(source.read(int(ends[last - 1]) - done), np.uint8)
            ranks = decode_documents(block, control[first:last], n_ids[first:last], ends[first:last] - done, wide, tables)
            documents = np.split(ranks, n_ids[first:last].cumsum()[:-1])
            yield keys[first:last], nulls[first:last], documents
            first, done = last, int(ends[last - 1])


def read_token_files(files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """Decode a data set: shard, position in it, doc_id, start, n_tokens, ids_crc32 and the ids, if wanted.

    ``start`` counts the ids of all documents before, in ascending doc_id order.
    """
    ranks_path = files.ranks

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(ranks_path)
        with store.open_input_file(at) as source:
            table = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, nulls, ranks in read_shard(path):
                    ids = [table[x] for x in ranks]
                    counts = np.array([len(x) for x in ids], np.int64)
                    columns = [
                        pa.array(keys, pa.int64(), mask=nulls),
                        pa.array(base + counts.cumsum() - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    base += int(counts.sum())

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    listed = files.manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    partitions = max(1, int(files.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(partitions, "path").mapInArrow(read, schema)
