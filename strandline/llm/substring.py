"""Substring dedup by sliding spans of consecutive sentences and parts of sentences."""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, release, slices

#: A span is the shortest run of so many parts of sentences with so many words.
SENTENCES, WORDS = 2, 25
#: A sentence is cut after the word of least hash in each run of so many of its words.  Whether
#: a word is one depends on WINDOW - 1 words either side, so every repeated run of at least
#: WORDS + 4 * WINDOW - 3 words (50) holds a whole span, wherever it starts and without full stops too.
WINDOW = 7
_BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_MARKS = np.array([ord(c) for c in ".!?"], np.uint32)
#: Blanks by code point; none lies behind the last but one.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
_LOW, _HIGH = 0xFFFFFFFF, np.uint64(0xFFFFFFFF00000000)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A span's place as one number: first part, parts after it, bits of the text's hash.
_RUN_BITS, _MARK_BITS = 6, 25
#: A part has a word at least, so spans of so many words fit in the bits of a run.
MOST_WORDS = (1 << _RUN_BITS) - 1


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence's parts; the parts cover the whole
    text, each with the blanks behind it.  Sentences end at . ! ? before blanks
    and at line breaks, and are cut by their own words into parts of WINDOW words
    at most, alike in all copies; words are in lower case."""
    words, _, ends, starts = _parts(text)
    edges, n = [0, *starts[ends[1:-1]].tolist(), len(text)], ends.tolist()
    return [(a, z, words[i:j]) for a, z, i, j in zip(edges, edges[1:], n, n[1:])]


def _parts(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text, their hashes, the number of words before each part and
    in all, and the place of each word."""
    words = text.lower().split()
    hashes = _hashes(words)
    if not words:
        return words, hashes, np.zeros(1, np.int64), np.empty(0, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(chars, len(_BLANK) - 1)]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    behind = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
    lines = np.cumsum(chars == 10)
    ends = np.isin(chars[behind], _MARKS) | (lines[np.append(starts[1:], len(chars)) - 1] > lines[behind])
    ends[-1] = True
    ends[_least(hashes, np.cumsum(ends) - ends)] = True
    return words, hashes, np.concatenate(([0], np.flatnonzero(ends) + 1)), starts


def _hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode("utf-8", "surrogatepass").split(b" ") if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(words))


def _least(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Places of the words of least hash, the last of equal ones, in all runs of
    WINDOW words of one sentence."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64)
    key = (hashes & _HIGH) | np.arange(_LOW, _LOW - len(hashes), -1, dtype=np.uint64)
    least = key[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, key[k : k + n], out=least)
    return _LOW - (least[sentence[:n] == sentence[WINDOW - 1 :]] & np.uint64(_LOW)).astype(np.int64)


def spans(parts: list[tuple[int, int, list[str]]], least: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the spans: from each part the shortest run on
    that is long enough, and to each part the shortest run before it, so the
    last parts of a repeated passage are covered too."""
    return _spans(_hashes([x for _, _, w in parts for x in w]), np.cumsum([0, *(len(w) for _, _, w in parts)]), least, words)


def _spans(hashes: np.ndarray, total: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spans`` by the hashes of all words and the numbers of words before each part."""
    n = len(total) - 1
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + words) - 1, i + least - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, i - least + 1)
    a = np.concatenate((i[last < n], first[first >= 0]))
    z = np.concatenate((last[last < n], i[first >= 0]))
    pairs = np.unique(a << 32 | z)
    a, z = pairs >> 32, pairs & _LOW
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), _P))))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), _P_INVERSE))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * power[:-1])))
    x, y = total[a], total[z + 1]
    value = (sums[y] - sums[x]) * back[x] + (y - x).astype(np.uint64)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29)), a, z


def span_rows(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(hash, doc_id, at) of every span of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, owners, places = [], [], []
            for doc, text, mark in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("mark").to_pylist()):
                _, known, ends, _ = _parts(text.as_py())
                value, a, z = _spans(known, ends, least, words)
                hashes.append(value.view(np.int64))
                owners.append(np.full(len(value), doc, np.int64))
                places.append(((a << _RUN_BITS | (z - a)) << _MARK_BITS) | mark)
            columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (hashes, owners, places)]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "at"])

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark"))
    return known.mapInArrow(run, "hash long, doc_id long, at long")


def _mark():
    return F.pmod(F.xxhash64("text"), F.lit(1 << _MARK_BITS))


def repeated(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, cuts, firsts): ranges of parts of a document that repeat an
    earlier span, and the documents that hold the first of them.

    Spans are counted by hash before they meet; only repeated ones are joined
    again, against a table with a row a span, so a span that a third of all
    documents hold is split over tasks."""
    rows = materialize(span_rows(docs, least, words), "substring-spans")
    known = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "at")).alias("one")).where("c > 1")
    known = materialize(known.select("hash", F.col("one.doc_id").alias("first_doc"), F.col("one.at").alias("first_at")), "substring-known")
    later = rows.join(known, "hash").where("doc_id <> first_doc OR at <> first_at")
    mark = F.col("at").bitwiseAND((1 << _MARK_BITS) - 1)
    run = F.shiftright("at", _MARK_BITS)
    place = F.struct(F.shiftright(run, _RUN_BITS).cast("int").alias("a"), (F.shiftright(run, _RUN_BITS) + run.bitwiseAND((1 << _RUN_BITS) - 1)).cast("int").alias("z"))
    firsts = F.array_sort(F.collect_set("first_doc"))
    found = later.groupBy("doc_id", mark.alias("mark")).agg(F.collect_set(place).alias("cuts"), firsts.alias("firsts"))
    found = materialize(found, "substring-cuts")
    release(rows, known)
    return found


def without(text: str, cuts: list) -> tuple[str, int, int]:
    """The text without the parts of ``cuts``, its parts, and the sentences that lost any."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for c in cuts:
        gone[c["a"]] += 1
        gone[min(c["z"] + 1, len(parts))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return text, len(parts), 0
    starts = np.array([a for a, _, _ in parts])
    lost = np.unique(np.searchsorted([m.end() for m in _BREAK.finditer(text)], starts[gone], side="right"))
    return "".join(text[a:z] for (a, z, _), g in zip(parts, gone) if not g).rstrip(), len(parts), len(lost)


def remove_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with the parts of sentences of every non-first repeated span removed.

    All columns stay, whatever their names, but for earlier ``removed_sentences``
    and ``first_docs``; an empty table gives none; ``text`` is the text that is left, and
    ``removed_sentences`` (those that lost all or a part) and ``first_docs`` are added.  First is the smallest
    (doc_id, place).  A document that loses all sentences keeps an empty text.
    Null texts and rows with a null doc_id stay as they are and count for
    nothing; a row that repeats a doc_id and its text is the same document, one
    that repeats the doc_id with another text is another.  Texts shorter than
    a span lose nothing unless a span of another document covers them, which
    none can."""
    if words > MOST_WORDS:
        raise ValueError(f"a span of over {MOST_WORDS} words may have more parts than its place can say")
    names = [c for c in docs.columns if c not in ("removed_sentences", "first_docs")]
    cuts = repeated(docs, least, words)
    # the other columns travel in one, so their names can't clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(F.col("text").isNotNull(), _mark()).alias("mark"))
    joined = rows.join(cuts, ["doc_id", "mark"], "left")

    @F.pandas_udf("text string, removed int")
    def clean(text, cuts):
        import pandas as pd

        rows = [(t, 0) if t is None or c is None else without(t, c)[::2] for t, c in zip(text, cuts)]
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "removed": [r[1] for r in rows]})

    done = joined.select("row", "firsts", clean("text", "cuts").alias("clean"))
    kept = [F.col("clean.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return done.select(*kept, F.col("clean.removed").alias("removed_sentences"), F.coalesce("firsts", F.array().cast("array<long>")).alias("first_docs"))
