"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

Kernel. A word, with its bounds as characters of their own, is compared by its subsequences of four characters that
span six places at most: each counts ``DECAY`` to the power of its span, so up to two inserted characters or one
longer gap leave most of an insult's weight. k(x, y) sums the products over shared subsequences, divided by a norm
that depends on the words' lengths alone (a positive factor for each side, so k stays a kernel). Characters other than
letters and digits are skipped (``i.d.i.o.t``); case and common look-alike digits fold to Latin letters. Letters of all
other scripts are hashed to 220 symbols.

Training. Examples are the sentences of labelled documents (they end at ``.``, ``!`` or ``?`` before white space and at
line feeds), which bear their document's label. A sentence scores as its most toxic word, so the machine is a latent
one: with f the score of a word, a clean sentence asks for f <= -1 of all its words, and a toxic one for f >= 1 of one
of them, its witness. The witness is at first the word that toxic documents hold most unusually often (by the likelihood
ratio over documents), then in ``rounds`` further fits the word that the fit before scores highest. Not every sentence
of a toxic document is toxic: those whose witness scores below the ``QUIET`` quantile of clean sentences are left out.
Landmarks are the most telling witnesses and words of clean sentences; words are mapped by their kernel values to the
landmarks times the inverse root of the landmarks' kernel matrix, and a linear SVM is
fitted (squared hinge; each clean word and each witness costs the root of its sentences' number, so a common clean word
that toxic documents hold too is not outweighed as a witness).
A bounded sample is learned from, so the driver's work does not grow with the corpus: at most ``toxic_documents`` and
``clean_documents`` labelled documents, at most ``sentences`` sentences of each class, both chosen by a hash, and
``landmarks`` landmarks of 2 to ``LANDMARK_CHARS`` characters.

Scoring. The machine is linear in subsequences, so it folds into one table of weights (2^20 slots, hashed), and every
word of every whole text is scored by table lookups. A document's largest word score (its most toxic sentence's),
sum of positive word scores and share of positive words go through a logistic function. That is fitted out of sample: the labelled documents are
dealt into two halves, and each half's features come from a machine that was fitted on the other (in sample only where
a half lacks a class).

Rows: null and empty texts have no words and get the score that goes with that; texts of over ``PART`` characters are
taken in parts that are cut at white space, however far that is, so no word is cut; null labels and null ids are not learned
from; a document with contradicting label rows counts as toxic; repeated rows are each scored; with labels of one class
alone, or none, every score is the share of toxic labels (0 without labels); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.tokens import text_slices

DECAY = 0.6
SLOTS = 20  # bits
#: Steps between the four places of a subsequence: at least 1, and at most 5 together.
STEPS = tuple(s for s in product((1, 2, 3), repeat=3) if sum(s) <= 5)
_DELIMITER, _SKIP = 0, 255
FEATURES = ("largest", "total", "share")
QUIET = 0.98
LANDMARK_CHARS = 40


def _symbols() -> np.ndarray:
    """A number for each code point of the basic plane: 0 for white space, 255 for what is skipped."""
    table = np.full(1 << 16, _SKIP, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isspace():
            table[code] = _DELIMITER
        elif char.isalpha():
            folded = unicodedata.normalize("NFD", char.lower())[0]
            table[code] = ord(folded) - 96 if "a" <= folded <= "z" else _hashed(ord(folded))
        elif char.isdigit():
            table[code] = 27 + (code % 8)
    for digit, letter in zip("013457@$", "oieastas", strict=True):  # look-alikes
        table[ord(digit)] = ord(letter) - 96
    return table


def _hashed(code):
    """A symbol from 35 to 254 for a code point, or an array of them."""
    return 35 + (code * 0x9E3779B1 >> 7) % 220


_TABLE = _symbols()


def _symbols_of(codes: np.ndarray) -> np.ndarray:
    out = _TABLE[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():
        out[beyond] = _hashed(codes[beyond].astype(np.int64)).astype(np.uint8)
    return out


def _flat(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each between delimiters, and the place of each text's first delimiter."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    symbols = _symbols_of(codes)
    keep = symbols != _SKIP
    before = np.cumsum(keep) - keep
    return symbols[keep], before[begins]


def _subsequences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(slot of the subsequence that starts at each place, whether it lies in one word, weight), for each of STEPS."""
    wide = symbols.astype(np.uint32)
    word = (symbols == _DELIMITER).cumsum(dtype=np.int32)
    inside = {}
    for a, b, c in STEPS:
        span = a + b + c
        n = len(symbols) - span
        if n <= 0:
            continue
        if span not in inside:
            inside[span] = word[span - 1 : span - 1 + n] == word[:n]
        ids = (wide[:n] << np.uint32(24)) | (wide[a : a + n] << np.uint32(16)) | (wide[a + b : a + b + n] << np.uint32(8)) | wide[span : span + n]
        yield (ids * np.uint32(2654435769)) >> np.uint32(32 - SLOTS), inside[span], DECAY ** (span + 1)


#: Sums over STEPS of the squared weight, and of that times the span: a word of n >= 5 places has the norm sqrt(n A - B).
_SQUARES = np.array([(DECAY ** (2 * (sum(s) + 1)), sum(s)) for s in STEPS])


def _norm_of(places: np.ndarray) -> np.ndarray:
    """The norm of words by their places, bounds included: their subsequences taken as different from each other."""
    found = np.maximum(places[..., None] - _SQUARES[:, 1], 0) @ _SQUARES[:, 0]
    return np.where(found > 0, np.sqrt(found), 1.0)


def word_features(words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and weights of each word's subsequences, normalised."""
    out = []
    for word in words:
        symbols, _ = _flat([word])
        found = [(slots[ok], np.full(int(ok.sum()), weight)) for slots, ok, weight in _subsequences(symbols)]
        slots = np.concatenate([s for s, _ in found]) if found else np.empty(0, np.uint32)
        weights = np.concatenate([w for _, w in found]) if found else np.empty(0)
        out.append((slots, weights / _norm_of(np.array([len(symbols)]))[0]))
    return out


def _kernel(words: Sequence[str], landmarks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Kernel values of words and landmarks, a row for each word."""
    used = np.unique(np.concatenate([s for s, _ in landmarks]))
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j, (slots, weights) in enumerate(landmarks):
        np.add.at(dense[:, j], np.searchsorted(used, slots), weights)
    row_of = np.full(1 << SLOTS, len(used), np.int32)
    row_of[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for first in range(0, len(words), 2000):
        symbols, begins = _flat(words[first : first + 2000])
        total = np.zeros((len(symbols), len(landmarks)), np.float32)
        for slots, ok, weight in _subsequences(symbols):
            rows = np.where(ok, row_of[slots], len(used))
            hit = np.flatnonzero(rows < len(used))
            total[hit] += dense[rows[hit]] * np.float32(weight)
        part = np.add.reduceat(total, begins, axis=0)
        out[first : first + len(part)] = part / _norm_of(np.diff(np.append(begins, len(symbols) - 1)) + 1)[:, None]
    return out


_SENTENCE_END = re.compile(r"(?<=[.!?])(?=\s)|\n")


def sentences_of(text: str) -> list[str]:
    """The sentences of a text that have a word."""
    return [x for x in map(str.strip, _SENTENCE_END.split(text)) if x]


def telling_words(split: Sequence[Sequence[int]], toxic: np.ndarray, document: Sequence[int], n_words: int) -> np.ndarray:
    """The signed likelihood ratio of each word (a number): positive where toxic documents hold it more often.

    A word counts once for each document; the share expected of toxic ones is theirs among all such counts, as more
    sentences may be sampled of a document of one class than of the other.
    """
    counts = np.zeros((2, n_words))
    number = {d: k for k, d in enumerate(dict.fromkeys(document))}
    held = [defaultdict(set), defaultdict(set)]
    for words, t, d in zip(split, toxic.tolist(), document, strict=True):
        held[int(t > 0)][number[d]].update(words)
    for t in (0, 1):
        for words in held[t].values():
            counts[t, list(words)] += 1
    b, a = counts
    rate = a.sum() / (a + b).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        found = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * rate)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - rate))), 0))
    return np.where(a > (a + b) * rate, found, -found)


def _svm(mapped: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge, each example at its own cost, by Newton steps."""
    mapped = np.hstack([mapped, np.ones((len(y), 1), mapped.dtype)]).astype(np.float64)
    w = np.zeros(mapped.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + (weight * np.maximum(0, 1 - y * (mapped @ w)) ** 2).sum()

    now = loss(w)
    for _ in range(50):
        margin = 1 - y * (mapped @ w)
        active = margin > 0
        part, scale = mapped[active], weight[active]
        gradient = ridge * w - 2 * part.T @ (scale * y[active] * margin[active])
        hessian = np.diag(ridge) + 2 * (part * scale[:, None]).T @ part
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * abs(before):
            break
    return w


def fit_sentence_machine(
    sentences: Sequence[str], toxic: Sequence[int], document: Sequence[int], *, landmarks: int = 192, rounds: int = 3
) -> tuple[np.ndarray, float] | None:
    """(weight of each slot, bias) of the machine; None without sentences of a class, or without a telling word."""
    toxic = np.asarray(toxic, np.int64)
    number: dict[str, int] = {}
    split = [[number.setdefault(w, len(number)) for w in map(_bare, text.split()) if w] for text in sentences]
    used = np.array([len(x) > 0 for x in split], bool)
    split, toxic = [x for x in split if x], toxic[used]
    document = [d for d, u in zip(document, used.tolist(), strict=True) if u]
    if len(set(toxic.tolist())) < 2:
        return None
    names = list(number)
    telling = telling_words(split, toxic, document, len(names))
    fit = np.array([2 <= len(w) <= LANDMARK_CHARS for w in names])
    most = [k for k in np.argsort(-telling, kind="stable").tolist() if telling[k] > 0 and fit[k]]
    common = np.bincount(np.concatenate([x for x, t in zip(split, toxic, strict=True) if not t]), minlength=len(names))
    clean = [k for k in np.argsort(-common, kind="stable").tolist() if telling[k] <= 0 and fit[k] and common[k]]
    if not most or not clean:
        return None
    first = min(len(most), landmarks * 2 // 3)
    chosen = [names[k] for k in [*most[:first], *clean[: landmarks - first]]]
    marks = word_features(chosen)
    values, vectors = np.linalg.eigh(_kernel(chosen, marks).astype(np.float64))
    root = (vectors * np.where(values > 1e-6 * values[-1], 1 / np.sqrt(np.maximum(values, 1e-300)), 0)).astype(np.float32)
    mapped = _kernel(names, marks) @ root
    words = np.concatenate(split)
    begins = np.cumsum([0, *map(len, split[:-1])])
    asked = np.flatnonzero(common > 0)  # words of clean sentences: each is asked for f <= -1
    score = telling  # of each word: at first by the likelihood ratio
    for _ in range(rounds + 1):
        largest = np.maximum.reduceat(score[words], begins)
        loud = (toxic > 0) & (largest > max(0.0, np.quantile(largest[toxic == 0], QUIET)))
        if not loud.any():
            break
        held = np.repeat(largest, np.diff(np.append(begins, len(words)))) == score[words]
        owner = np.repeat(np.arange(len(split)), np.diff(np.append(begins, len(words))))
        witness, often = np.unique(words[held & loud[owner]], return_counts=True)
        examples = np.concatenate([witness, asked])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(asked))])
        weight = np.concatenate([np.sqrt(often), np.sqrt(common[asked])])
        w = _svm(mapped[examples], y, weight)
        score = mapped @ w[:-1] + w[-1]
    if score is telling:
        return None
    beta = root @ w[:-1]
    table = np.zeros(1 << SLOTS)
    for b, (slots, weights) in zip(beta, marks, strict=True):
        np.add.at(table, slots, b * weights)
    return table.astype(np.float32), float(w[-1])


def _bare(word: str) -> str:
    """A word as training names it: in lower case, without what stands around its letters and digits."""
    return _AROUND.sub("", word.lower())


_AROUND = re.compile(r"^[\W_]+|[\W_]+$")


#: Characters of texts that are scored at once.
PART = 500_000
_SPACE = re.compile(r"\s")


def _text_parts(texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Parts of texts, cut at white space, and the text that each belongs to."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        start = 0
        while len(text) - start > PART:
            space = _SPACE.search(text, start + PART)
            if space is None:
                break
            parts.append(text[start : space.start()])
            owner.append(k)
            start = space.start()
        parts.append(text[start:])
        owner.append(k)
    return parts, np.array(owner, np.int64)


def _word_scores(texts: Sequence[str], table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all words, and the text that each is in."""
    symbols, begins = _flat(texts)
    total = np.zeros(len(symbols), np.float32)
    for slots, ok, weight in _subsequences(symbols):
        total[: len(slots)] += np.where(ok, table[slots], np.float32(0)) * np.float32(weight)
    starts = np.flatnonzero(symbols == _DELIMITER)
    places = np.diff(np.append(starts, len(symbols))) + 1
    scores = np.add.reduceat(total, starts, dtype=np.float64) / _norm_of(places) + bias
    is_word = places > 2
    return scores[is_word], (np.searchsorted(begins, starts, side="right") - 1)[is_word]


def document_features(texts: Sequence[str], table: np.ndarray, bias: float) -> np.ndarray:
    """For each text: largest word score, sum of positive word scores, share of positive words; -1, 0, 0 without words."""
    out = np.tile([-1.0, 0.0, 0.0], (len(texts), 1))
    parts, text_of = _text_parts(texts)
    found, size, group = [], 0, []
    for k, part in enumerate([*parts, None]):
        if group and (part is None or size + len(part) > PART):
            scores, owner = _word_scores([parts[g] for g in group], table, bias)
            found.append((scores, text_of[np.array(group)][owner]))
            group, size = [], 0
        if part is not None:
            group.append(k)
            size += len(part)
    if not found:
        return out
    scores, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(owner):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    at = owner[first]
    out[at, 0] = np.maximum.reduceat(scores, first)
    out[at, 1] = np.add.reduceat(np.maximum(scores, 0), first)
    out[at, 2] = np.add.reduceat((scores > 0).astype(float), first) / np.diff(np.append(first, len(owner)))
    return out


def _expand(features: np.ndarray) -> np.ndarray:
    largest, total, share = features.T
    return np.stack([np.clip(largest, -2, 3), np.log1p(total), np.sqrt(share)], 1)


@dataclass(frozen=True)
class Calibration:
    """A logistic function of the document features, or a constant."""

    weights: tuple[float, ...] | None
    bias: float

    def score(self) -> Column:
        if self.weights is None:
            return F.lit(float(self.bias))
        terms = (
            F.greatest(F.least(F.col("largest"), F.lit(3.0)), F.lit(-2.0)),
            F.log1p("total"),
            F.sqrt("share"),
        )
        logit = sum((F.lit(w) * t for w, t in zip(self.weights, terms, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-logit))


def fit_calibration(features: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> Calibration:
    x = np.hstack([_expand(features), np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(tuple(map(float, w[:-1])), float(w[-1]))


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; null ids are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(labels: DataFrame, toxic_documents: int, clean_documents: int) -> DataFrame:
    """(_id, toxic) of the labelled documents to learn from: a bounded number, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    mixed = F.xxhash64("_id")
    parts = [known.filter(F.col("toxic") == t).orderBy(mixed, "_id").limit(n) for t, n in ((1, toxic_documents), (0, clean_documents))]
    return scratch.written(parts[0].union(parts[1]), "training-sample")


def _half(key: int) -> int:
    """Which half a labelled document is in, for scores out of sample."""
    return zlib.crc32(b"half %d" % key) & 1


def labelled_sentences(docs: DataFrame, sample: DataFrame, most: int) -> list[tuple[int, int, str]]:
    """(doc_id, toxic, sentence) of at most ``most`` sentences of each class, chosen by a hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, characters=200_000):
                parts = [sentences_of(text) for text in texts]
                row = pa.array(np.repeat(np.arange(first, first + len(texts)), [len(x) for x in parts]))
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array([x for part in parts for x in part], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "sentence"])

    rows = docs.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "toxic", "text")  # the sample's bound is a parameter
    cuts = scratch.written(rows.mapInArrow(cut, "doc_id bigint, toxic int, sentence string"), "labelled-sentences")
    order = F.xxhash64("doc_id", "sentence")
    parts = [cuts.filter(F.col("toxic") == t).orderBy(order, "doc_id", "sentence").limit(most) for t in (1, 0)]
    return [(r.doc_id, r.toxic, r.sentence) for r in parts[0].union(parts[1]).collect()]


Machine = tuple[np.ndarray, float]


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    toxic_documents: int = 6000,
    clean_documents: int = 14000,
    sentences: int = 12000,
    landmarks: int = 192,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5), and the document features."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = training_sample(labels, toxic_documents, clean_documents)
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    machine, halves = None, []
    if len(totals) == 2:
        known = labelled_sentences(rows, sample, sentences)
        fit = lambda part: fit_sentence_machine([s for _, _, s in part], [t for _, t, _ in part], [d for d, _, _ in part], landmarks=landmarks)
        machine = fit(known)
        halves = [fit([x for x in known if _half(x[0]) != h]) for h in (0, 1)]
        halves = [machine if half is None else half for half in halves]
    spark = docs.sparkSession

    def features(frame: DataFrame, machines: list[Machine]) -> DataFrame:
        shared = spark.sparkContext.broadcast(machines)  # 4 MB each at any input size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = shared.value
            for batch in batches:
                for first, texts in text_slices(batch, characters=200_000):
                    columns = batch.column(0).slice(first, len(texts))
                    if len(machines) == 1:
                        found = document_features(texts, *machines[0])
                    else:
                        half = np.array([_half(k) for k in columns.to_pylist()])
                        both = [document_features(texts, *m) for m in machines]
                        found = np.where(half[:, None] == 0, *both)
                    yield pa.RecordBatch.from_arrays([columns, *(pa.array(c) for c in found.T)], names=["doc_id", *FEATURES])

        return frame.mapInArrow(run, "doc_id bigint, largest double, total double, share double")

    learned = machine is not None
    if learned:
        labelled = rows.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "text")
        outside = features(labelled, halves).dropDuplicates(["doc_id"]).join(sample, F.col("_id") == F.col("doc_id"))
        outside = outside.select(*FEATURES, "toxic").toPandas()  # as many rows as the sample has, of four numbers
        calibration = fit_calibration(outside[list(FEATURES)].to_numpy(float), outside["toxic"].to_numpy(float))
    else:
        machine = np.zeros(1 << SLOTS, np.float32), -1.0
        seen = sum(totals.values())
        calibration = Calibration(None, totals.get(1, 0) / seen if seen else 0.0)
    scored = features(rows, [machine]).withColumn("score", calibration.score())
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES
    )
