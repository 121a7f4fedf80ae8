"""Toxicity by compression distance: zstandard dictionaries of the two classes.

Windows of PHRASE consecutive words, overlapping by half, cover the whole text.
A window's gain is how many bytes shorter the dictionary trained on toxic texts
makes it than that trained on ordinary ones; the strongest windows of a text
are features.  Single words are windows too, against dictionaries of words
typical of either class, and are counted at each gain; they repeat, so a task
keeps the gains of those it has met.  The windows of many texts are segments of
one buffer, which zstandard compresses in one call, each by itself.  A third of
the labelled texts, kept out of first dictionaries, chooses what counts as
typical and calibrates the features by a logistic fit.

The model is trained on a bounded sample of labelled texts (``most_rows`` rows
of at most ``most_bytes`` bytes in all); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from heapq import nsmallest
from itertools import chain
from typing import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, slices

MOST_ROWS = 12_000
MOST_BYTES = 48_000_000
DICT_BYTES = 100_000
ORDINARY_WORDS = 12_000
#: Likelihood ratios of which validation chooses the one that a word must pass to count as typical of toxic text.
TYPICAL = (4.5, 9.0, 18.0, 36.0, 72.0)
#: Words of a phrase window and from one window to the next, and the strongest windows whose mean is a feature.
PHRASE, STEP, STRONGEST = 6, 3, 4
#: Rows of which one validates.
VALIDATE = 3
LEVELS = 7
#: Words whose gains a task keeps before it drops those that the texts at hand don't hold.
MEMO = 100_000
#: Windows compressed by one call, and rows of training texts looked at together.
AT_ONCE, ROWS_AT_ONCE = 50_000, 500
#: From the first letter, digit or underscore between blanks to the last.
_WORD = re.compile(r"\w(?:\S*\w)?")


@dataclass
class ToxicityModel:
    """Dictionaries of words and of texts as bytes, weights of the features, and the share of toxic texts."""

    toxic: bytes
    ordinary: bytes
    toxic_texts: bytes
    ordinary_texts: bytes
    weights: list[float]
    prior: float


def windows(text: str) -> list[str]:
    """The words of a text in lower case without marks at their ends."""
    return _WORD.findall(text.lower())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=16, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    table = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_AUTO)
    table.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=table, compression_params=params)


def _lengths(compressor: zstandard.ZstdCompressor, content: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Compressed bytes of each segment of ``content``."""
    found = []
    for k in range(0, len(starts), AT_ONCE):
        segments = np.column_stack((starts[k : k + AT_ONCE], (ends - starts)[k : k + AT_ONCE])).astype(np.uint64)
        found.extend(map(len, compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(content, segments.tobytes()), threads=1)))
    return np.array(found, np.int64)


def _segments(words: list[str], starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Windows from word ``starts`` to before word ``stops``, blanks at their ends included, as segments of one buffer."""
    content = f" {' '.join(words)} ".encode("utf-8", "replace")
    blanks = np.flatnonzero(np.frombuffer(content, np.uint8) == 32)
    return content, blanks[starts], blanks[stops] + 1


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.toxic, self.ordinary = _compressor(model.toxic), _compressor(model.ordinary)
        self.toxic_texts, self.ordinary_texts = _compressor(model.toxic_texts), _compressor(model.ordinary_texts)
        self.memo: dict[str, int] = {}

    def gains(self, words: list[str]) -> list[int]:
        """The gain of each word as a window of its own."""
        held = set(words)
        new = [w for w in held if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo = {w: self.memo[w] for w in held if w in self.memo}
        at = np.arange(len(new))
        single = _segments(new, at, at + 1)
        self.memo.update(zip(new, (_lengths(self.ordinary, *single) - _lengths(self.toxic, *single)).tolist()))
        return [self.memo[w] for w in words]

    def phrase_features(self, texts: list[list[str]]) -> list[list[float]]:
        """Of each text's words the strongest gain of a phrase window, the mean of the strongest, and that of all."""
        sizes = np.array([len(words) for words in texts], np.int64)
        counts = np.where(sizes > 0, (np.maximum(1, sizes - PHRASE + STEP) + STEP - 1) // STEP, 0)
        ends, upto = np.cumsum(sizes), np.cumsum(counts)
        starts = np.repeat(ends - sizes, counts) + STEP * (np.arange(counts.sum()) - np.repeat(upto - counts, counts))
        stops = np.minimum(starts + PHRASE, np.repeat(ends, counts))
        phrases = _segments(list(chain.from_iterable(texts)), starts, stops)
        every = _lengths(self.ordinary_texts, *phrases) - _lengths(self.toxic_texts, *phrases)
        found = []
        for n, end in zip(counts.tolist(), upto.tolist()):
            gains = sorted(every[end - n : end].tolist(), reverse=True) or [0]
            strongest = gains[:STRONGEST]
            found.append([gains[0] / 10, sum(strongest) / len(strongest) / 10, sum(gains) / len(gains) / 10])
        return found

    def word_features(self, texts: list[list[str]]) -> list[list[float]]:
        """Counts of each text's words at each gain."""
        sizes = [len(words) for words in texts]
        level = np.clip(self.gains(list(chain.from_iterable(texts))), 0, LEVELS).astype(np.int64)
        at = np.repeat(np.arange(len(texts)), sizes) * (LEVELS + 1) + level
        found = []
        for total, seen in zip(sizes, np.bincount(at, minlength=len(texts) * (LEVELS + 1)).reshape(-1, LEVELS + 1).tolist()):
            counts = seen[2:]
            strong = sum(counts[1:])
            found.append([1.0, *(math.log1p(n) for n in counts), math.sqrt(strong / total) if total else 0.0, math.log1p(total) / 10])
        return found

    def scores(self, texts: list[str | None]) -> list[float]:
        words = [windows(t or "") for t in texts]
        z = (float(np.dot(self.model.weights, w + p)) for w, p in zip(self.word_features(words), self.phrase_features(words)))
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _dictionary(words: list[str]) -> bytes:
    """Words up to DICT_BYTES, the most telling last, where matches cost least."""
    kept, size = [], 0
    for w in words:
        size += len(w.encode("utf-8", "replace")) + 1
        if size > DICT_BYTES:
            break
        kept.append(w)
    return f" {' '.join(reversed(kept))} ".encode("utf-8", "replace")


def _ratio(a: int, b: int, na: int, nb: int) -> float:
    both = a + b
    return 2 * sum(x * math.log(x * (na + nb) / (both * n)) for x, n in ((a, na), (b, nb)) if x)


def _text_dictionary(texts: list[list[str]]) -> bytes:
    """A dictionary trained on the words of whole texts; few ones are their own dictionary."""
    samples = [f" {' '.join(words)} ".encode("utf-8", "replace") for words in texts]
    if sum(map(len, samples)) <= DICT_BYTES:
        return b"".join(samples)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples, however long
        return b"".join(samples)[-DICT_BYTES:]


class _Typical:
    """Words typical of toxic and of ordinary texts, rated once for all bounds."""

    def __init__(self, held: dict[int, Counter], rows: Counter):
        self.rated = sorted(((_ratio(n, held[0][w], rows[1], rows[0]), w) for w, n in held[1].items() if n * rows[0] > held[0][w] * rows[1]), reverse=True)
        self.common = [w for _, w in nsmallest(ORDINARY_WORDS, ((-n, w) for w, n in held[0].items()))]
        self.own = [(n, w) for w, n in held[0].items() if w not in held[1]]
        at = np.arange(len(self.own))
        self.single = _segments([w for _, w in self.own], at, at + 1)

    def dictionaries(self, least: float, turns: int) -> tuple[bytes, bytes]:
        """The toxic and the ordinary dictionary.

        Ordinary words that the toxic dictionary shortens are added to the ordinary
        dictionary, turn by turn, so that chance syllables stop counting."""
        toxic, common = _dictionary([w for r, w in self.rated if r > least]), self.common
        ordinary = _dictionary(common)
        shortened = _lengths(_compressor(toxic), *self.single)
        for _ in range(turns):
            wrong = [self.own[i] for i in np.flatnonzero(_lengths(_compressor(ordinary), *self.single) - shortened >= 3)]
            known = {w for _, w in wrong}
            common = [w for _, w in sorted(wrong, reverse=True)[: ORDINARY_WORDS // 3]] + [w for w in common if w not in known]
            ordinary = _dictionary(common)
        return toxic, ordinary


def _held(words: list[list[str]], toxic: list[int]) -> tuple[dict[int, Counter], Counter]:
    """Rows of each class that hold a word, and rows of each class."""
    held = {0: Counter(), 1: Counter()}
    for w, label in zip(words, toxic):
        held[label].update(set(w))
    return held, Counter(toxic)


def train(texts: list[str | None], toxic: list[int], turns: int = 3) -> ToxicityModel:
    """Dictionaries of either class, and a calibration on texts that first
    dictionaries haven't seen, which chooses the bound of typical words too.

    With one class only, or none, every score is the share of toxic rows (0.5 of none)."""
    share = sum(toxic) / len(toxic) if toxic else 0.5
    if not 0 < sum(toxic) < len(toxic):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(b" ", b" ", b" ", b" ", [math.log(p / (1 - p)), *[0.0] * (LEVELS + 4)], share)
    known: dict[str, str] = {}  # a repeated word is kept once
    words = [[known.setdefault(w, w) for w in windows(t or "")] for t in texts]
    seen: Counter = Counter()
    away = np.zeros(len(toxic), bool)
    for i, label in enumerate(toxic):
        away[i] = seen[label] % VALIDATE == VALIDATE - 1
        seen[label] += 1
    own, check = (~away, away) if min(seen.values()) >= VALIDATE else (away | True, away | True)
    y = np.array(toxic, float)[check]

    def of(rows: np.ndarray, label: int) -> list[list[str]]:
        return [words[i] for i in np.flatnonzero(rows) if toxic[i] == label]

    typical = _Typical(*_held([words[i] for i in np.flatnonzero(own)], [toxic[i] for i in np.flatnonzero(own)]))
    model = ToxicityModel(b"", b"", _text_dictionary(of(own, 1)), _text_dictionary(of(own, 0)), [], share)
    rest = [words[i] for i in np.flatnonzero(check)]
    phrases = _in_turn(Scorer(model).phrase_features, rest)
    best = (math.inf, 0.0, [])
    for least in TYPICAL:
        model.toxic, model.ordinary = typical.dictionaries(least, turns)
        x = np.array([w + p for w, p in zip(_in_turn(Scorer(model).word_features, rest), phrases)])
        weights = _logistic(x, y)
        loss = _loss(x, y, weights)
        weights[0] -= _parting(x @ weights, y)
        best = min(best, (loss, least, weights.tolist()))
    every = np.ones(len(toxic), bool)
    words_toxic, words_ordinary = _Typical(*_held(words, toxic)).dictionaries(best[1], turns)
    return ToxicityModel(words_toxic, words_ordinary, _text_dictionary(of(every, 1)), _text_dictionary(of(every, 0)), best[2], share)


def _in_turn(features: Callable[[list[list[str]]], list[list[float]]], texts: list[list[str]]) -> list[list[float]]:
    """Features of some texts at a time."""
    return [x for k in range(0, len(texts), ROWS_AT_ONCE) for x in features(texts[k : k + ROWS_AT_ONCE])]


def _parting(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds, between two rows, that leave the least sum of the shares of
    toxic rows below and of ordinary rows above."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate(([0.0], np.cumsum(y / y.sum() - (1 - y) / (1 - y).sum())))
    wrong[1:-1][z[1:] == z[:-1]] = np.inf
    k = int(np.argmin(wrong))
    return float(np.mean(z[max(0, k - 1) : k + 1]))


def _loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """Mean log loss in the two classes."""
    each = np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ weights))
    return float(each[y > 0].mean() + each[y <= 0].mean())


def _logistic(x: np.ndarray, y: np.ndarray, turns: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps; both classes weigh the same, so that 0.5 parts them evenly."""
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * len(y) * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, label) of whole labelled texts: ``most_rows`` rows and
    ``most_bytes`` bytes in all at most, the documented bound of the training set.

    The rows with the least hash of doc_id are looked at; one that doesn't fit in
    what is left of the bytes is left out, so no text is cut.  Rows with a null id,
    text or label, or another label than 0 and 1, are left out too; of a
    repeated doc_id the smallest text counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & allowed).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    found = materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
    # at most ``most_rows`` ids and sizes
    sizes = found.select("doc_id", F.octet_length("text").alias("bytes")).toPandas()
    order = sorted(zip(sizes["doc_id"], sizes["bytes"]), key=lambda x: (crc32(str(x[0]).encode()), x[0]))
    ids, left = [], most_bytes
    for i, n in order:
        if n <= left:
            ids.append(int(i))
            left -= int(n)
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
    return found.join(F.broadcast(wanted), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[list[str], list[int]]:
    """The texts and labels of ``labelled_rows`` by doc_id."""
    kept = sorted(labelled_rows(docs, labels, label, allowed, most_rows, most_bytes).toLocalIterator(), key=lambda r: r["doc_id"])
    return [r["text"] for r in kept], [int(r["label"]) for r in kept]


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder`` modulo ``of``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def score_texts(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row: whole texts, null as empty.

    Repeated rows score alike, an empty table gives none."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in slices(batches):
            scores = np.array(scorer.scores(b.column("text").to_pylist()), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
