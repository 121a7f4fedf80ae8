"""Document fingerprints by prefix polynomial hashes.

A text has an array of hashes of all its prefixes for each of four bases, modulo
a prime.  Any span's hash is the difference of two of them, so two spans are
compared in constant time, and the longest extension that two places have in
common is found by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import give_back, materialize, slices, small_batches

BITS = 31
PRIME = (1 << BITS) - 1
#: Four bases, so that a fingerprint has 124 bits; spans are compared by the first two.
BASES = tuple(int.from_bytes(hashlib.sha256(f"base {i}".encode()).digest()[:8]) % (PRIME - 1000) + 500 for i in range(4))
#: Code points of a span that counts as common to two texts between their ends.
BLOCK = 32
_powers = np.ones((len(BASES), 1), np.uint32)


def _mod(x: np.ndarray) -> np.ndarray:
    """Of whole numbers below 2**62 the remainders by PRIME."""
    x = (x & PRIME) + (x >> BITS)
    x = (x & PRIME) + (x >> BITS)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(n: int) -> np.ndarray:
    """The powers 0 to ``n`` of each base, held by the worker for the next text."""
    global _powers
    while _powers.shape[1] <= n:
        have = _powers.shape[1]
        step = np.array([[pow(b, have, PRIME)] for b in BASES], np.uint64)
        _powers = np.concatenate((_powers, _mod(_powers * step).astype(np.uint32)), axis=1)
    return _powers


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """The prefix hashes of a text: ``sums[:, i]`` is that of its first ``i`` code points.

    They take 16 bytes a code point, and the powers as much again."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.n = sums, sums.shape[1] - 1

    @classmethod
    def of(cls, codes: np.ndarray) -> Prefixes:
        n = len(codes)
        sums = np.zeros((len(BASES), n + 1), np.uint32)
        p, c = powers(n), codes.astype(np.uint64) + 1
        for k in range(len(BASES)):
            sums[k, 1:] = _mod(np.cumsum(_mod(c * p[k, :n]), dtype=np.uint64))
        return cls(sums)

    def followed_by(self, upto: int, other: Prefixes, length: int) -> Prefixes:
        """Those of the first ``upto`` code points and then the first ``length`` of another text, without reading either again."""
        step, base = powers(upto)[:, upto, None].astype(np.uint64), self.sums[:, upto, None].astype(np.uint64)
        rest = _mod(base + _mod(other.sums[:, 1 : length + 1] * step))
        return Prefixes(np.concatenate((self.sums[:, : upto + 1], rest.astype(np.uint32)), axis=1))

    def fingerprint(self) -> str:
        """Length and hash of the whole text: equal for equal texts."""
        return f"{self.n}:" + "".join(f"{int(v):08x}" for v in self.sums[:, -1])

    def same(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether the spans of ``length`` from ``i`` here and from ``j`` there are equal."""
        p = powers(max(i, j))
        for k in (0, 1):
            a, b = int(self.sums[k, i + length]) - int(self.sums[k, i]), int(other.sums[k, j + length]) - int(other.sums[k, j])
            if (a * int(p[k, j]) - b * int(p[k, i])) % PRIME:
                return False
        return True

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """How far the texts agree from ``i`` here and ``j`` there on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, i: int, other: Prefixes, j: int, most: int) -> int:
        """How far, up to ``most``, the texts agree before ``i`` here and ``j`` there."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def spans(self, starts: np.ndarray, length: int, top: int) -> np.ndarray:
        """Hashes of 62 bits of the spans from ``starts``, brought to the place ``top``."""
        p, out = powers(top), np.zeros(len(starts), np.uint64)
        for k in (0, 1):
            d = self.sums[k, starts + length].astype(np.uint64) + PRIME - self.sums[k, starts]
            out = (out << np.uint64(BITS)) | _mod(_mod(d) * p[k, top - starts])
        return out


def likeness(a: Prefixes, b: Prefixes) -> float:
    """The share of the longer text, 0 to 1, that both have in common: the longest
    common beginning and end, and between them the blocks of ``BLOCK`` code
    points of the shorter text that stand anywhere in the other.  Two empty
    texts are alike; the order of the texts doesn't matter."""
    if (a.n, a.fingerprint()) > (b.n, b.fingerprint()):
        a, b = b, a
    if not b.n:
        return 1.0
    head = a.extension(0, b, 0)
    tail = a.extension_back(a.n, b, b.n, a.n - head)
    common = head + tail
    starts = np.arange(head, a.n - tail - BLOCK + 1, BLOCK)
    if len(starts) and b.n - head - tail >= BLOCK:
        blocks = np.sort(a.spans(starts, BLOCK, b.n))
        there = b.spans(np.arange(head, b.n - tail - BLOCK + 1), BLOCK, b.n)
        at = np.minimum(np.searchsorted(blocks, there), len(blocks) - 1)
        common += BLOCK * int(np.isin(blocks, there[blocks[at] == there]).sum())
    return common / b.n


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ENDS = pa.schema([*_SCHEMA, ("text", pa.string()), ("place", pa.int32()), ("kind", pa.int32())])


def _row(doc_id: int | None, codes: np.ndarray, own: Prefixes, next_codes: np.ndarray, following: Prefixes) -> dict:
    """A document's result, given the document after it."""
    cut = own.n - own.n // 3
    taken = min(own.n // 3, following.n)
    edited = own.followed_by(cut, following, taken)
    text = codes[:cut].tobytes() + next_codes[:taken].tobytes()
    digest = hashlib.sha256(text.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return {"doc_id": doc_id, "n_chars": own.n, "edited_sha256": digest, "fingerprint": own.fingerprint(), "edited_fingerprint": edited.fingerprint(), "near_edited": likeness(own, edited), "near_next": likeness(own, following)}


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every document and its edited text, whose last third
    (rounded down) is replaced by the beginning of the next document.

    The next document is that of the next smaller id; the last one's is the first.
    Null texts count as empty ones, rows with a null id come last, and rows that
    share an id follow each other by a hash of their texts, repeated rows one
    after the other.  One document alone is its own next one; no documents give
    no rows.  Other columns aren't looked at.

    The rows are sorted over the cluster once; a task goes through its part with two
    texts in hand, and only the ends of the parts meet in a join.  A text of
    any length is worked on whole, in about 100 bytes a code point."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.orderBy(F.desc_nulls_last("doc_id"), "mark", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId(), None
        for b in slices(batches):
            out = []
            for doc_id, value in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                codes = code_points(value)
                own = Prefixes.of(codes)
                if held is None:
                    out.append({"text": value, "place": place, "kind": 1})
                else:
                    out.append({**_row(held[0], held[2], held[3], codes, own), "kind": 0})
                held = doc_id, value, codes, own
            yield pa.RecordBatch.from_pylist(out, schema=_ENDS)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "text": held[1], "place": place, "kind": 2}], schema=_ENDS)
        give_back()

    small_batches(docs.sparkSession)
    found = materialize(ordered.mapInArrow(run, f"{RESULT}, text string, place int, kind int"), "fingerprints", by="kind")
    heads = found.where("kind = 1").select("place", F.col("text").alias("next_text"))
    by_place = Window.orderBy("place")  # a row a task
    after = heads.select("place", F.coalesce(F.lead("place").over(by_place), F.first("place").over(by_place)).alias("next"))
    ends = found.where("kind = 2").select("doc_id", "text", "place").join(after, "place")
    ends = ends.select("doc_id", "text", F.col("next").alias("place")).join(heads, "place").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                codes, following = code_points(r["text"]), code_points(r["next_text"])
                out.append(_row(r["doc_id"], codes, Prefixes.of(codes), following, Prefixes.of(following)))
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return found.where("kind = 0").select(*_SCHEMA.names).union(ends.mapInArrow(close, RESULT))


def common_extensions(pairs: DataFrame, left: str = "left", at: str = "at", right: str = "right", there: str = "there", name: str = "common") -> DataFrame:
    """Add ``name``: how many code points the texts ``left`` from place ``at`` on and
    ``right`` from ``there`` on have in common.

    Null texts count as empty ones; a null place, or one outside its text, gives
    null.  Rows may repeat, and all other columns stay as they are."""
    schema = pairs.select(*pairs.columns).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, i, y, j in zip(*[b.column(c).to_pylist() for c in (left, at, right, there)]):
                a, c = Prefixes.of(code_points(x)), Prefixes.of(code_points(y))
                inside = i is not None and j is not None and 0 <= i <= a.n and 0 <= j <= c.n
                found.append(a.extension(i, c, j) if inside else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, name])

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, schema)
