"""Tokenization, token files, packing and pieces against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, pieces, token_files, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = " \n\t.,!a'sTé1x\x0b\x1c½中▁ 　😀\x01\x00"


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(ALPHABET + "bcdefghi", max_size=60), max_size=6))
def test_chunks_encode_as_whole_texts(path, texts):
    encoder = tokens.encoder(path)
    want = [np.array(x.ids, encoder.dtype).tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text("aBÉßİŉǅ\u212a\u0338\u0301жªº²'s  .,<\"$-_\\", max_size=40), max_size=6))
def test_words_and_the_marks_behind_them(path, texts):
    encoder = tokens.encoder(path)
    assert encoder.plain and encoder.encode(texts) == encoder.whole(texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_known_word_with_other_marks_is_not_asked_again(path):
    enc, asked = tokens.ChunkEncoder(path), []
    model = enc.tokenizer.model

    class Asked:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    class Library:
        def __init__(self, tokenizer):
            self.encode_batch_fast, self.model = tokenizer.encode_batch_fast, Asked()

    enc.tokenizer = Library(enc.tokenizer)
    texts = ["a word, another word. Word", "one word; a word, and été, a été.", "word) word word."]
    assert [np.frombuffer(x, enc.dtype).tolist() for t in texts for x in enc.encode([t])] == [library(path)(t) for t in texts]
    asked.clear()
    more = "x another; x another) x word."
    assert np.frombuffer(enc.encode([more])[0], enc.dtype).tolist() == library(path)(more)
    assert not any("word" in x or "another" in x for x in asked)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_new_words_go_to_the_model_together(path):
    enc, asked = tokens.ChunkEncoder(path), []

    class Asked:
        def __init__(self, tokenizer):
            self.tokenizer, self.model = tokenizer, self

        def tokenize(self, text):
            asked.append(text)
            return self.tokenizer.model.tokenize(text)

        def encode_batch_fast(self, texts, **options):
            asked.append(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    enc.tokenizer, enc.words = Asked(enc.tokenizer), Asked(getattr(enc, "words", enc.tokenizer))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeirnostÄéñßĿ", k=rng.randint(1, 20))) for _ in range(900)]
    texts = [" ".join(words[k : k + 90]) + ".\n" + words[k] for k in range(0, 900, 90)]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [library(path)(t) for t in texts]
    assert len(asked) < 40


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_marks_behind_each_two_byte_character(path):
    """Signs, letters whose lower case ends in a mark, and letters; at the start of a text and behind others."""
    enc = tokens.encoder(path)
    texts = [f"{before}{chr(c)}{mark}" for c in (*range(33, 127), *range(0xA1, 0x800)) for before, mark in (("", "<"), ("a ", "<\u0338b"), ("é.", "$_"))]
    assert enc.encode(texts) == enc.whole(texts)


def test_a_small_memo_changes_nothing(odd_rows):
    texts = [t or "" for _, t, *_ in odd_rows]
    small, large = tokens.ChunkEncoder(BYTE, 5), tokens.encoder(BYTE)
    for _ in range(3):
        assert small.encode(texts) == large.encode(texts)


def test_token_files_round_trip(odd_docs, odd_rows):
    encode, start = library(BYTE), 0
    files = token_files.write_token_files(odd_docs, BYTE, end_id=0, shard_bytes=4000)
    assert files.manifest.count() > 2
    got = {r.doc_id: r for r in token_files.read_token_files(files).collect()}
    for k, t, *_ in odd_rows:
        ids = [*encode(t or ""), 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32, list(got[k].ids)) == (start, len(ids), crc, ids)
        start += len(ids)


def test_hot_and_missing_ids_fill_several_shards(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 7, 7, k]), " ".join(str(rng.random()) for _ in range(30))) for k in range(400)]
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTE, end_id=0, shard_bytes=8_000)
    shards = [list(token_files.read_shard(r.path)) for r in files.manifest.orderBy("shard").collect()]
    held = [[None if n else int(k) for keys, nulls, _ in blocks for k, n in zip(keys, nulls, strict=True)] for blocks in shards]
    for hot in (None, 7):
        assert sum(hot in keys for keys in held) > 3 and max(keys.count(hot) for keys in held) < 60
    order = [-1 if k is None else k for keys in held for k in keys]
    assert order == sorted(order) and len(order) == 400
    got = token_files.read_token_files(files).collect()
    encode = library(BYTE)
    want = Counter((k, tuple([*encode(t), 0])) for k, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_files_odd_rows(awkward_docs, no_docs):
    files = token_files.write_token_files(awkward_docs, BYTE, end_id=0)
    rows = token_files.read_token_files(files, with_ids=False).orderBy("start").collect()
    assert len(rows) == awkward_docs.count()
    assert [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.doc_id for r in rows[2:]] == sorted(r.doc_id for r in rows[2:])
    assert token_files.read_token_files(token_files.write_token_files(no_docs, BYTE, end_id=0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(ranks=st.lists(st.integers(0, 70000), max_size=40), wide=st.integers(3, 4))
def test_rank_coding(ranks, wide):
    control, data = token_files.encode_ranks(np.array(ranks, np.int64), wide)
    back = token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks), wide)
    assert back.tolist() == ranks
    assert len(control) == -(-len(ranks) // 8)
    assert len(data) == sum(1 if r < 256 else wide for r in ranks)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.integers(0, 70000) | st.integers(0, 300), max_size=40), max_size=9), wide=st.integers(3, 4))
def test_documents_are_coded_together_as_one_by_one(texts, wide):
    counts = np.array([len(x) for x in texts], np.int64)
    joined = np.array([r for x in texts for r in x], np.uint32)
    data, stops = token_files.encode_documents(joined, counts, wide)
    alone = [b"".join(token_files.encode_ranks(np.array(x, np.int64), wide)) for x in texts]
    assert data.tobytes() == b"".join(alone) and stops.tolist() == np.cumsum([len(x) for x in alone], dtype=int).tolist()
    assert token_files.decode_documents(data, -(-counts // 8), counts, stops, wide).tolist() == joined.tolist()


def test_joined_ids_of_a_slice():
    rows = [np.arange(k, dtype="<u2").tobytes() for k in (2, 0, 5, 1, 0)]
    for first, last in ((0, 5), (1, 4), (1, 2), (5, 5)):
        ids, counts = token_files._joined_ids(pa.array(rows, pa.binary()).slice(first, last - first), "<u2")
        assert ids.tobytes() == b"".join(rows[first:last]) and counts.tolist() == [len(x) // 2 for x in rows[first:last]]


@pytest.mark.parametrize("step", [1, 50])
def test_slices_change_no_file(odd_docs, monkeypatch, step):
    """Documents are coded in slices of some ids; a shard's bytes are those of whole batches."""
    held = []
    for size in (1 << 18, step):
        monkeypatch.setattr(token_files, "SLICE", size)
        files = token_files.write_token_files(odd_docs, BYTE, end_id=0)
        held.append([tuple(r) for r in token_files.read_token_files(files, with_ids=False).orderBy("start").collect()])
    assert held[0] == held[1]


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[k]}:
            rest = list(rooms)
            rest[rest.index(r)] -= items[k]
            place(k + 1, rest)
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_packing_is_optimal_on_small_instances(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50, 100])
    low = rng.choice([1, 1 + capacity // 5, 1 + capacity // 3])
    items = [rng.randint(low, rng.choice([capacity, max(low, capacity // 2 + 1)])) for _ in range(rng.randint(1, 10))]
    plan = packing.solve(Counter(items), capacity)
    placed = Counter()
    for pattern, copies in plan:
        assert sum(s * n for s, n in pattern) <= capacity
        for s, n in pattern:
            placed[s] += n * copies
    assert placed == Counter(items)
    best = fewest(items, capacity)
    assert sum(c for _, c in plan) == best >= packing.least_sequences(Counter(items), capacity)


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    improved = [c for c in (Counter(random.Random(s).choices(range(15, 60), k=14)) for s in range(200)) if sum(n for _, n in packing.best_fit(c, 100)) > sum(n for _, n in packing.solve(c, 100))]
    assert improved and packing.solve(counts, 10)


def test_packed_documents(odd_docs, odd_rows):
    encode, capacity = library(WORD), 64
    want = {}
    for k, t, *_ in odd_rows:
        ids = [*encode(t or ""), 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            want[k, piece] = (start, ids[start : start + capacity])
    rows = packing.pack_documents(odd_docs, WORD, capacity=capacity, with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, list(r.ids)) for r in rows} == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= capacity
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // capacity) + 1


def test_packing_odd_rows(awkward_docs, no_docs):
    assert packing.pack_documents(awkward_docs, WORD).select("doc_id").count() >= awkward_docs.count()
    assert packing.pack_documents(no_docs, WORD).count() == 0


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=300, deadline=None)
@given(text=st.text(ALPHABET + "theinrosd", max_size=80))
def test_pieces_equal_the_library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids = pieces.codec(PIECE).encode([text])[0]
    want = sp.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert pieces.codec(PIECE).decode(ids) == sp.decode(want)


def test_long_segments_give_the_same_ids(processor):
    rng = random.Random(1)
    texts = ["a" * 5000, " " * 3000 + "x", "".join(rng.choices("abcdehilnorst", k=6000)), "ab" * 2000 + "é" * 700, "中文" * 900]
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.codec(PIECE).encode(texts)]
    assert got == processor.encode(texts, add_bos=True, add_eos=True)


def test_piece_rows(odd_docs, odd_rows, processor):
    got = {r.doc_id: r for r in pieces.encode_decode(odd_docs, PIECE).collect()}
    for k, t, *_ in odd_rows:
        ids = processor.encode(t or "", add_bos=True, add_eos=True)
        assert (got[k].n_tokens, list(got[k].ids), got[k].decoded) == (len(ids), ids, processor.decode(ids))
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()


def test_piece_odd_rows(awkward_docs, no_docs):
    assert pieces.encode_decode(awkward_docs, PIECE).count() == awkward_docs.count()
    assert pieces.encode_decode(no_docs, PIECE).count() == 0
