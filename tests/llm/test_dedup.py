"""Exact, near, passage and line deduplication against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from millrace.llm.exact_dedup import LOWER, UPPER

ASCII_LOWER = str.maketrans(UPPER, LOWER)


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups(odd_docs, odd_rows):
    norm = {k: (t or "").translate(ASCII_LOWER) for k, t, *_ in odd_rows}
    got = {r.doc_id: r for r in exact_dedup.exact_groups(odd_docs, salts=4).collect()}
    assert set(got) == set(norm)
    for k, text in norm.items():
        group = [j for j, other in norm.items() if other == text]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(group), len(group), max(group) == k)
        assert got[k].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_odd_rows(awkward_docs, no_docs):
    rows = exact_dedup.exact_groups(awkward_docs).collect()
    assert len(rows) == awkward_docs.count()
    assert [r.kept for r in rows if r.doc_id == 3] == [True] * 4
    assert {(r.doc_id, r.kept) for r in rows if r.doc_id is None} == {(None, True), (None, False)}
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_drop_exact(odd_docs, odd_rows):
    last = {}
    for k, t, *_ in odd_rows:
        last[(t or "").translate(ASCII_LOWER)] = k
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(last.values())


def test_exact_handles_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Hot Text', concat('t', id)) AS text")
    got = exact_dedup.exact_groups(docs).groupBy("group_size", "kept").count().collect()
    assert sorted((r.group_size, r.kept, r["count"]) for r in got) == [(1, True, 2000), (1000, False, 999), (1000, True, 1)]


def test_exact_groups_where_digests_meet(odd_docs, awkward_docs, odd_rows):
    norm = {k: (t or "").translate(ASCII_LOWER) for k, t, *_ in odd_rows}
    weak = lambda text: F.unhex(F.hex(F.length(text) % 7))
    got = {r.doc_id: r for r in exact_dedup.exact_groups(odd_docs, digest=weak).collect()}
    for k, text in norm.items():
        group = [j for j, other in norm.items() if other == text]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(group), len(group), max(group) == k)
        assert got[k].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    key = lambda r: str(tuple(r))
    assert sorted(exact_dedup.exact_groups(awkward_docs, digest=weak).collect(), key=key) == sorted(exact_dedup.exact_groups(awkward_docs).collect(), key=key)


def test_hot_texts_without_ids_spread(spark):
    docs = spark.range(4000).selectExpr("IF(id < 1500, NULL, id) AS doc_id", "IF(id % 2 = 0, 'Hot', concat('t', id % 10)) AS text")
    got = exact_dedup.exact_groups(docs).groupBy("text_sha256", "keep_id", "group_size").count().collect()
    assert sorted((r.keep_id, r.group_size, r["count"]) for r in got) == [
        (k, n, n) for k, n in ((3991, 400), (3993, 400), (3995, 400), (3997, 400), (3998, 2000), (3999, 400))
    ]


def test_dropped_by_id_and_text(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "b"), (9, "A"), (None, "a")], "doc_id bigint, text string")
    assert {(r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect()} == {(5, "b"), (9, "A"), (None, "a")}


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_classes(odd_docs, odd_rows):
    words = {k: brute_fingerprint(t, 3) for k, t, *_ in odd_rows}
    links = [(a, b) for a in words for b in words if a < b and (words[a] ^ words[b]).bit_count() <= 2]
    root = roots(links, words)
    got = {r.doc_id: r for r in simhash.near_duplicate_groups(odd_docs).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == words
    assert {k: r.component_id for k, r in got.items()} == root
    assert all(len(r.fingerprint) == 16 for r in got.values())


def test_long_runs_of_shingles_are_counted_whole():
    text = " ".join(random.Random(3).choices("abcdef", k=2000))
    assert int(simhash.fingerprints_of([text])[0]) == brute_fingerprint(text, 3)


@pytest.mark.parametrize("bits", [20, 33, 64])
def test_words_within_two_bits_meet_at_an_anchor(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << min(bits, 63), 500, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, bits, 500).astype(np.uint64)
    y = x ^ flip() ^ flip()
    sets = []
    for words in (x, y):
        rows, anchors = simhash.replicas(words, bits)
        sets.append([set(anchors[rows == k].tolist()) for k in range(500)])
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_crowded_anchors_give_the_same_classes():
    words = np.unique(np.uint64(9) ^ np.random.default_rng(1).integers(0, 2**11, 800, dtype=np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None, :]) <= 2, 1))
    nodes = words.tolist()
    want = roots(zip(words[i].tolist(), words[j].tolist(), strict=True), nodes)
    for low, high in (simhash._by_midpoint(words), simhash._forest(words, i, j)):
        assert roots(zip(low.tolist(), high.tolist(), strict=True), nodes) == want


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(200 + k, 200 + (k + 1) % 7) for k in range(7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == roots(links, {n for pair in links for n in pair})
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_odd_rows(awkward_docs, no_docs):
    assert simhash.near_duplicate_groups(awkward_docs).count() == awkward_docs.count()
    assert simhash.near_duplicate_groups(no_docs).count() == 0
    assert simhash.drop_similar(no_docs).count() == 0
    kept = simhash.drop_similar(awkward_docs)
    assert kept.filter("doc_id IS NULL").count() == 2


def test_similar_documents_go_and_others_stay(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows, originals = [], 40
    for k in range(originals):
        rows.append((k, " ".join(rng.choices(words, k=200))))
    for k in range(originals):  # five of 200 words changed: over 0.8 of the five-word shingles in common
        copy = rows[k][1].split()
        for at in rng.sample(range(200), 4):
            copy[at] = "other"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000 + k, " ".join(rng.choices(words, k=200))) for k in range(200)]
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept >= {*range(originals), *range(2000, 2200)}
    assert len([k for k in kept if 1000 <= k < 2000]) <= 2


def shingle_set(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [512, 7])
def test_only_pairs_of_the_similarity_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):  # pairs of Jaccard 0.6 to 0.95, of which the signatures are within 51 bits or near it
        base = rng.choices(words, k=200)
        copy = list(base)
        copy[: 8 + k % 40] = rng.choices(words, k=8 + k % 40)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    base = rng.choices(words, k=150)
    for k in range(40):  # a chain: each text moves on by some words
        rows.append((1000 + k, " ".join(base[k * 2 :] + words[: k * 2])))
    rows += [(2000, "one two three four five six " * 30), (2001, "one two three four five six " * 3)]  # equal sets
    sets = {k: shingle_set(t) for k, t in rows}
    want = roots([(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8], sets)
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    apart = {r.doc_id: r.component_id for r in got}
    assert all(want[k] == want[root] for k, root in apart.items())  # nothing is linked below the similarity
    assert apart[2001] == 2000
    assert apart == want


def test_pairs_at_just_the_similarity_are_all_linked(spark):
    rng = random.Random(12)
    rows = []
    for k in range(1500):  # 80 of 100 shingles in common, or four of five
        words, kept = (104, 84) if k % 2 else (9, 8)
        base = [f"a{rng.randrange(10**9)}" for _ in range(words)]
        copy = base[:kept]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    sets = {k: shingle_set(t) for k, t in rows}
    pairs = [k for k in range(0, 3000, 2) if 0.8 <= jaccard(sets[k], sets[k + 1]) < 0.82]
    assert len(pairs) == 1500
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [k for k in pairs if got[k + 1] != k] == []
    assert len(set(got.values())) == 1500


def test_similar_texts_meet_at_anchors(spark, monkeypatch):
    """Without the tables, those within two bits are linked: by anchors, and by whole sets among them."""
    met = []

    def no_tables(marked, known, similarity):
        met.append({r.node: r.root for r in known.collect()})
        return spark.createDataFrame([], "a bigint, b bigint")

    monkeypatch.setattr(simhash, "_candidate_links", no_tables)
    rng = random.Random(14)
    rows = []
    for k in range(120):  # one word of 900 is changed, or many are
        base = [f"a{rng.randrange(10**9)}" for _ in range(900)]
        copy = list(base)
        for at in rng.sample(range(900), 1 if k % 2 else 60):
            copy[at] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    fp = [int(simhash._signed(*simhash.shingle_sets([t], 5), 1)[0, 0]) for _, t in rows]
    links = [(k, k + 1) for k in range(0, 240, 2) if (fp[k] ^ fp[k + 1]).bit_count() <= 2 and jaccard(*(shingle_set(rows[j][1]) for j in (k, k + 1))) >= 0.8]
    assert 30 < len(links) < 100
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == roots(links, range(240)) and len(met) == 1 and len(met[0]) >= 2 * len(links)


def test_a_shared_id_loses_no_unlike_text(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(2000)]
    a, b, c = (rng.choices(words, k=120) for _ in range(3))
    other = lambda x: " ".join([*x[:-1], "changed"])
    rows = [(3, other(a)), (5, " ".join(a)), (5, " ".join(b)), (9, other(b)), (5, " ".join(c)), (5, other(c)), (None, " ".join(c))]
    kept = {(r.doc_id, r.text) for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {rows[0], rows[2], rows[6]} <= kept and rows[1] not in kept and rows[3] not in kept
    assert len(kept & {rows[4], rows[5]}) == 1 and len(kept) == 4


@pytest.mark.parametrize("seed", range(3))
def test_common_hashes(seed):
    rng = np.random.default_rng(seed)
    left, right = ([np.unique(rng.integers(0, 9000, rng.integers(0, 6000), dtype=np.uint64)) for _ in range(9)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert simhash._common(left, right).tolist() == want


def test_large_sets_are_compared_in_bounded_memory():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 64, 9000, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 64, k + 1, dtype=np.uint64)])) for k in range(240)]
    held = sum(x.nbytes for x in sets)
    tracemalloc.start()
    common = simhash._common(sets[:120], sets[120:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * held
    assert [common[i, j] for i, j in ((0, 0), (7, 90), (119, 119))] == [len(np.intersect1d(sets[i], sets[120 + j])) for i, j in ((0, 0), (7, 90), (119, 119))]


def test_lists_of_large_sets_are_bounded_by_their_hashes(spark, monkeypatch):
    """A family of long texts, most of them unlike the pivot: no list holds more than some HASHES on a side."""
    monkeypatch.setattr(simhash, "HASHES", 2000)
    rows = spark.range(60).selectExpr("1L AS `group`", "id AS node", "id % 2 = 0 AS rest", "CAST(repeat('x', 8 * 500) AS binary) AS held")
    lists = simhash._dealt(rows, ["held"], simhash.BLOCK, F.octet_length("held") / 8, simhash.HASHES)
    sides = lists.groupBy("i", "j", "side").agg((F.sum(F.octet_length("held")) / 8).alias("hashes")).collect()
    assert max(r.hashes for r in sides) < 5 * simhash.HASHES  # of 30,000
    pairs = lists.filter("side = 0").select("i", "j", F.col("node").alias("a")).join(lists.filter("side = 1").select("i", "j", F.col("node").alias("b")), ["i", "j"])
    assert pairs.select("a", "b").distinct().count() == pairs.count() == 30 * 60


def test_a_large_family_is_linked_in_bounded_memory(spark):
    """6,000 variants of one text, most of them similar to the pivot, some only to each other."""
    rng = random.Random(22)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(6000):
        words = list(base)
        for at in rng.sample(range(150), 2):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    rows += [(10_000 + k, f"nothing like the others {rng.random()} {rng.random()} {rng.random()} {rng.random()}") for k in range(50)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("component_id").count().collect()
    assert sorted((r.component_id, r["count"]) for r in got) == [(0, 6000), *((10_000 + k, 1) for k in range(50))]


def test_recall_and_precision_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set((r.text or "").lower()) for r in docs.collect()}
    by_shingle = {}
    for k, x in sets.items():
        for shingle in x:
            by_shingle.setdefault(shingle, []).append(k)
    shared = {}
    for owners in by_shingle.values():
        for i, a in enumerate(owners):
            for b in owners[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    assert len(links) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == roots(links, sets)


def brute_repeats(texts, length):
    seen, out = set(), []
    for raw in texts:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        out.append(gone)
    return out


def test_repeated_passages(odd_docs, odd_rows):
    raws = [(t or "").encode() for _, t, *_ in odd_rows]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd_docs).collect()}
    for k, (raw, gone) in enumerate(zip(raws, brute_repeats(raws, 100), strict=True)):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        row = got[k]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(raw), int(gone.sum()), runs)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot_rows", [0, 6])
def test_passages_of_hot_grams(odd_docs, odd_rows, monkeypatch, hot_rows):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot_rows)
    test_repeated_passages(odd_docs, odd_rows)


def test_a_passage_of_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 200)
    rng = random.Random(31)
    word = lambda: f"{rng.random()}"
    passage = " ".join(word() for _ in range(12))
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 9))), passage, *(word() for _ in range(rng.randint(0, 9)))]) for _ in range(400)]
    want = [len(t) - int(g.sum()) for t, g in zip(texts, brute_repeats([t.encode() for t in texts], 100), strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[k] for k in range(400)] == want


def test_hot_grams_exchange_no_text(odd_docs, odd_rows, monkeypatch):
    """Texts are joined to anchors once, for the runs; hot windows are found where the texts are."""
    joins, with_anchors = [], suffix_dedup._with_anchors
    monkeypatch.setattr(suffix_dedup, "_with_anchors", lambda *a: joins.append(a) or with_anchors(*a))
    hot, hot_spans = [], suffix_dedup._hot_spans
    monkeypatch.setattr(suffix_dedup, "_hot_spans", lambda *a: hot.append(a) or hot_spans(*a))
    test_passages_of_hot_grams(odd_docs, odd_rows, monkeypatch, 0)
    assert (len(joins), len(hot)) == (1, 1)


def test_a_common_line_is_settled_where_it_is_found(spark):
    rng = random.Random(32)
    line = " ".join(f"{rng.random()}" for _ in range(12))
    texts = ["\n".join([f"{rng.random()}", *[line] * 4, f"{rng.random()}"]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = suffix_dedup._candidates(suffix_dedup._documents(docs, "text", "doc_id", once=True), 100, 32)
    left = found.filter("not settled").groupBy("h").count().agg(F.max("count")).first()[0]
    every = found.groupBy("h").count().agg(F.max("count")).first()[0]
    assert every >= 900 and left < every / 2
    want = [len(t) - int(g.sum()) for t, g in zip(texts, brute_repeats([t.encode() for t in texts], 100), strict=True)]
    got = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[k] for k in range(300)] == want


def test_lanes_reach_one_task_each(spark):
    keys = suffix_dedup._even_keys(spark, 37)
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(37, "k").select(F.spark_partition_id().alias("p"), "k").collect()
    assert sorted((r.p, r.k) for r in rows) == list(enumerate(keys))


def test_stripped_texts_keep_other_columns(odd_docs, odd_rows):
    gone = brute_repeats([(t or "").encode() for _, t, *_ in odd_rows], 100)
    cut = suffix_dedup.strip_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    for k, t, *_ in odd_rows:
        assert got[k] == bytes(b for b, g in zip((t or "").encode(), gone[k], strict=True) if not g).decode("utf-8", "ignore")


def test_passages_odd_rows(awkward_docs, no_docs):
    rows = suffix_dedup.remove_repeats(awkward_docs).collect()
    assert len(rows) == awkward_docs.count()
    assert sum(r.doc_id is None for r in rows) == 2
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_a_repeated_row_over_several_runs_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "repeated_spans", functools.partial(suffix_dedup.repeated_spans, run_rows=40))
    rng = random.Random(8)
    text = " ".join(str(rng.random()) for _ in range(700))
    rows = [(5, text), (5, text), (None, text[:4000]), (None, text[:4000]), (7, text[2000:6000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 4000), (0, 4000), (5, len(text) - 4000), (5, len(text) - 4000), (7, 0)]


def test_more_texts_share_an_id_than_18_bits_number(spark):
    rng = random.Random(9)
    passage = [" ".join(str(rng.random()) for _ in range(20)) for _ in range(10)]
    long = spark.createDataFrame([(f"{rng.random()} {passage[k % 10]} {rng.random()}",) for k in range(80)], "text string")
    docs = spark.range(300_000).selectExpr("concat('t', id) AS text").union(long).selectExpr("CAST(NULL AS bigint) AS doc_id", "text")
    order = [r.text for r in docs.filter("length(text) > 20").orderBy(F.xxhash64("text")).collect()]
    want = sorted(len(t) - int(gone.sum()) for t, gone in zip(order, brute_repeats([t.encode() for t in order], 100), strict=True))
    got = suffix_dedup.remove_repeats(docs).filter("n_bytes > 20").selectExpr("n_bytes - n_removed AS kept").collect()
    assert sorted(r.kept for r in got) == want


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_covered_once_and_runs_merge_in_order(seed):
    rng = random.Random(seed)
    length, gram = rng.choice([(100, 32), (60, 17)])
    base = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 700))) for _ in range(4)]
    docs = [rng.choice(base) + rng.choice(base)[:200] for _ in range(8)] + [b"a" * 400, b"ab" * 150, b""]
    number, place, high, low, hashes = suffix_dedup.document_anchors(docs, length, gram)
    seen = [(d, s) for d, p, a, b in zip(number, place, high, low, strict=True) for s in range(p - a, p - b + 1)]
    assert sorted(seen) == [(d, s) for d, raw in enumerate(docs) for s in range(len(raw) - length + 1)]
    form = suffix_dedup._Form(length, gram)
    data, begins = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs[:-1])])
    rows = form.suffixes(data, begins[number], place, high, low, hashes)
    rows = np.unique(rows, axis=0)
    blobs = [suffix_dedup.front_coded(rows[k::5], np.arange(len(rows[k::5])), np.arange(len(rows[k::5]))) for k in range(5)]
    merged, _, _, shared = suffix_dedup.merge_runs(blobs)
    assert (merged == rows).all()
    for k in range(1, len(rows)):
        different = np.flatnonzero(rows[k] != rows[k - 1])
        assert shared[k] == different[0]


def brute_lines(docs, run):
    seen, out = {}, {}
    for key, text in docs:
        lines = (text or "").split("\n")
        held = [k for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        gone = set()
        for s in range(len(held) - run + 1):
            window = tuple(lines[k] for k in held[s : s + run])
            if window in seen:
                gone.update(held[s : s + run])
            seen.setdefault(window, key)
        out[key] = (len(held), len(gone), "\n".join(line for k, line in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 4])
def test_repeated_lines(odd_docs, odd_rows, run):
    want = brute_lines([(k, t) for k, t, *_ in odd_rows], run)
    got = line_dedup.drop_repeated_lines(odd_docs, run=run, salts=3)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got.collect()} == want


@pytest.mark.parametrize("run", [1, 2, 3])
def test_runs_extend_to_both_sides(spark, run):
    rng = random.Random(run)
    rows = [(k, "\n".join(rng.choices("abcdefgh", k=rng.randint(0, 25)))) for k in range(60)]  # fingerprints with many contexts
    want = brute_lines(rows, run)
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), run=run)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got.collect()} == want


@pytest.mark.parametrize("window", [2, 3, 5])
def test_single_lines_are_winnowed_and_extended(spark, window):
    rng = random.Random(window)
    rows = []
    for k in range(60):  # passages of lines that repeat, in whole or in part, and single lines
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 6))]
        a, n = rng.randrange(8), rng.randint(0, 9)
        lines += [f"shared {j}" for j in range(a, a + n)] + rng.choices(["x", "y", " ", ""], k=rng.randint(0, 4))
        rows.append((k, "\n".join(lines + lines[: rng.randint(0, 3)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    documents = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.xxhash64("text").alias("_tag"))
    seen, later = set(), set()
    for k, text in rows:
        held = [line for line in text.split("\n") if line.strip()]
        copies = [line in seen or line in held[:s] for s, line in enumerate(held)]
        later |= {(k, s) for s, copy in enumerate(copies) if copy}
        seen.update(held)
    matched = {(r._key, r.s) for r in line_dedup.matched_lines(documents, window).collect()}
    assert matched <= later and len(matched) > len(later) / 3
    want = brute_lines(rows, 1)
    got = line_dedup.drop_repeated_lines(docs, window=window)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got.collect()} == want


def test_a_long_match_is_found_whole_by_its_fingerprints(spark):
    passage = [f"line {k}" for k in range(200)]
    rows = [(1, "\n".join(["a", *passage, "b"])), (2, "\n".join(["c", *passage, "d", "a"]))]
    documents = spark.createDataFrame([(k, t, k) for k, t in rows], "_key bigint, _text string, _tag bigint")
    got = sorted((r._key, r.s) for r in line_dedup.matched_lines(documents, 4).collect())
    assert got[:200] == [(2, s) for s in range(1, 201)]
    assert {(r._key, r.s) for r in line_dedup.later_runs(documents, 1, 4, 4).collect()} == {*((2, s) for s in range(1, 201)), (2, 202)}


def test_lines_odd_rows(awkward_docs, no_docs):
    assert line_dedup.drop_repeated_lines(awkward_docs).count() == awkward_docs.count()
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(no_docs, run=0)
