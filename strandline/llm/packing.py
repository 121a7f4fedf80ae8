"""Best-fit packing of token pieces into sequences of fixed room.

Spark ranks the pieces within their lengths and counts each length; lengths are
bounded by the room, so these counts are at most as many numbers as the room has
tokens, however many documents there are.  Supersteps over the counts alone find
the successor of every run of equal pieces among the runs of equal gaps by sweeps
over both orders, give contested gaps by rank, and update the gaps; the next
superstep takes what is left.  They end in a table of runs (a length, ranks from
and to, the first sequence, pieces a sequence, offset), which every executor gets
and where each piece reads its place by length and rank.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, rank_within, slices

ROOM = 2048
END_ID = 0
#: Bands of lengths, the longest first: up to a half of the room, and up to a sixth.
BANDS = (2, 6)
#: Rows of one size that one task numbers, and the least number of parts that a size is dealt to.
RANKED, PARTS = 100_000, 256
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Texts with a run of so many characters without a border go to the tokenizer
#: that merges long runs in n log n.
_RUN = re.compile(r"\S{1500}|\s{1500}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _by_merges(vocabulary: str):
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def encoder(vocabulary: str, ranks: str):
    """A function from a text to its ids, by tiktoken over the same vocabulary;
    the ids are those of tokenizers with add_special_tokens=False."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)

    def encode(text: str) -> np.ndarray:
        if _RUN.search(text):
            return np.array(_by_merges(vocabulary).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def piece_starts(n: int, room: int = ROOM) -> list[int]:
    """Where the pieces of ``n`` ids begin: whole rooms, the first may be shorter."""
    first = n - room * ((n - 1) // room)
    return [0, *range(first, n, room)]


def token_pieces(docs: DataFrame, room: int = ROOM, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the
    closing id 0.  A null text is empty and gives one piece of one id; repeated
    rows and null doc_ids give their own pieces; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                starts = piece_starts(len(ids), room)
                for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(out, (doc, i, a, z - a, crc32(ids[a:z].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, room: int = ROOM, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (length and any other columns).

    Lengths must lie in 1 .. ``room``; another or null length raises an error.
    Repeated rows and rows of nulls are pieces like any other, names of other
    columns never clash, and an empty table gives none.  The table of runs has a
    few rows for each length and superstep, whatever the number of pieces, and
    is all that goes through the driver but the counts."""
    everything = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("piece")
    length = F.col("length").cast("int")
    fits = F.when(length.between(1, room), length).otherwise(F.raise_error(F.lit(f"a length is not in 1 .. {room}")).cast("int"))
    table = materialize(pieces.select(everything, fits.alias("length"), F.monotonically_increasing_id().alias("id")), "pack-pieces")
    lengths, counts = _counts(table, "length")
    ranked = rank_within(table, ["length"], ["id"], rank="rank", buckets=PARTS + int(counts.sum()) // RANKED)
    turn = F.col("rank") - 1 - F.col("first")
    placed = ranked.join(_small(table, runs(lengths, counts, room, bands)), "length").where((turn >= 0) & (turn < F.col("n")))
    at = {"sequence_id": F.col("sequence") + F.floor(turn / F.col("each")), "offset": F.col("start") + turn % F.col("each") * F.col("length")}
    return placed.select("piece.*", *[c.cast("long").alias(name) for name, c in at.items()])


def _counts(rows: DataFrame, size: str) -> tuple[np.ndarray, np.ndarray]:
    """The sizes in order and their rows: at most as many numbers as the room."""
    found = sorted(rows.groupBy(size).agg(F.count(F.lit(1))).collect())
    return tuple(np.array([r[k] for r in found], np.int64) for k in (0, 1))


def _small(beside: DataFrame, columns: dict[str, np.ndarray]) -> DataFrame:
    """A table of at most ``room`` rows of whole numbers, for every executor."""
    return F.broadcast(beside.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})))


def runs(lengths: np.ndarray, counts: np.ndarray, room: int, bands: tuple[int, ...] = BANDS) -> dict[str, np.ndarray]:
    """Where the pieces go, by ``counts`` of ``lengths`` (ascending): the ``n`` pieces of
    ``length`` from rank ``first`` (from 0) fill ``each`` places a sequence, from
    ``sequence`` on and from the offset ``start``.

    Pieces of over half a room open a sequence each.  The others follow in
    bands of lengths, the longest first: supersteps fill the gaps until none
    holds a piece of the band; then as many sequences are opened as the words
    left need at least, and it goes on.  Gaps are runs of sequences with equal
    room."""
    edges = [room // b for b in bands] + [0]
    alone = lengths > edges[0]
    opened = int(counts[alone].sum())
    begin = (np.cumsum(counts) - counts)[alone] - int(counts[~alone].sum())
    none, one = np.zeros(alone.sum(), np.int64), np.ones(alone.sum(), np.int64)
    out = [(lengths[alone], none, counts[alone], begin, one, none)]
    gaps = room - lengths[alone], begin, counts[alone]  # free room, first sequence, sequences
    for k in range(len(bands)):
        mine = (lengths <= edges[k]) & (lengths > edges[k + 1])
        sizes, left = lengths[mine], counts[mine]
        given = np.zeros_like(left)
        while left.any():
            fits = gaps[0] >= sizes[left > 0][0]
            idle, held = ([g[keep] for g in gaps] for keep in (~fits, fits))
            free, at = np.unique(held[0], return_inverse=True)
            pieces_at, gaps_at, offered = sweep(sizes, left, free, np.bincount(at, held[2], len(free)).astype(np.int64))
            taken = pieces_at[2]
            if taken.any():
                found, held = _fill(held, pieces_at, gaps_at, given, room)
                out.append(found)
                left, given = left - taken, given + taken
            else:
                more = -(-int(left @ sizes) // room)
                held = [np.append(g, v) for g, v in zip(held, (room, opened, more))]
                opened += more
            gaps = [np.concatenate(g) for g in zip(idle, held)]
            gaps = [g[gaps[0] >= lengths[0]] for g in gaps]
    return dict(zip(("length", "first", "n", "sequence", "each", "start"), map(np.concatenate, zip(*out))))


def _fill(gaps: list[np.ndarray], pieces_at: tuple[np.ndarray, np.ndarray, np.ndarray], gaps_at: dict[str, np.ndarray], given: np.ndarray, room: int) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """What a superstep places, as rows of ``runs``, and the runs of gaps after it.

    Runs of gaps are cut so that all gaps of a run get the same pieces: where
    the pieces of a length begin or end inside a gap, it is a run of its own."""
    by = np.argsort(gaps_at["free"])
    kind = by[np.searchsorted(gaps_at["free"][by], gaps[0])]
    order = np.lexsort((gaps[1], kind))
    free, sequence, n = (g[order] for g in gaps)
    slots = gaps_at["slots"][kind[order]]
    ends = np.cumsum(n * slots)
    begin, before = ends - n * slots, np.cumsum(n) - n
    lengths, at, taken = (x[pieces_at[2] > 0] for x in pieces_at)
    given = given[pieces_at[2] > 0]
    edge = np.concatenate((at, at + taken))
    edge = edge[edge < ends[-1]]
    of = np.searchsorted(begin, edge, side="right") - 1
    low, part = np.divmod(edge - begin[of], slots[of])
    cut = np.unique(np.concatenate((before, before[of] + low, before[of] + low + (part > 0))))
    cut = cut[cut < n.sum()]
    of = np.searchsorted(before, cut, side="right") - 1
    free, slots, sequence, begin = free[of], slots[of], sequence[of] + cut - before[of], begin[of] + (cut - before[of]) * slots[of]
    n = np.diff(np.append(cut, n.sum()))
    head, tail = np.searchsorted(begin, at, side="right") - 1, np.searchsorted(begin, at + taken, side="left")
    piece = np.repeat(np.arange(len(at)), tail - head)
    run = np.arange(len(piece)) - np.repeat(np.cumsum(tail - head) - (tail - head), tail - head) + head[piece]
    x, y = np.maximum(at[piece], begin[run]), np.minimum((at + taken)[piece], (begin + n * slots)[run])
    used = (y - x) * lengths[piece]
    held = np.bincount(run, used, len(n)).astype(np.int64)
    into = np.cumsum(used) - used
    into -= into[np.searchsorted(run, run, side="left")]
    found = lengths[piece], given[piece] + x - at[piece], y - x, sequence[run], np.where(n[run] > 1, slots[run], y - x), room - free[run] + into
    return found, [free - held // n, sequence, n]


def sweep(lengths: np.ndarray, left: np.ndarray, free: np.ndarray, gaps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray], int]:
    """The successors of one superstep: for each length the place of its first
    piece and how many pieces find one, for each gap size the place of its
    first slot and the slots of a gap, and the number of gaps.

    ``left`` pieces of ``lengths`` (ascending) are open and ``gaps`` gaps have
    ``free`` room (ascending).  A gap that holds several of the longest piece
    is offered in equal slots, as many as it holds but no more than every piece
    needs.  The sweep from the largest size down says how many pieces of each
    length find a slot, larger pieces first.  The sweep from the smallest size
    up gives those, in order, their successor or, where a piece before has it,
    the next slot: place i + max over j <= i of (successor(j) - j).  Within a
    size only ranks count, so both sweeps run over counts by size."""
    share = -(-int(left.sum()) // max(1, int(gaps.sum()))) + 1
    slots = np.clip(free // lengths[left > 0].max(), 1, share)
    order = np.lexsort((free, free // slots))
    free, slots, gaps = free[order], slots[order], gaps[order]
    size = free // slots
    ends = np.cumsum(gaps * slots)
    successor = np.concatenate(([0], ends))[np.searchsorted(size, lengths)]
    lacking = np.cumsum(left[::-1])[::-1] - (ends[-1] if len(ends) else 0) + successor
    short = np.maximum.accumulate(np.maximum(lacking, 0)[::-1])[::-1]
    taken = left - short + np.append(short[1:], 0)
    first = np.cumsum(taken) - taken
    at = first + np.maximum.accumulate(np.where(taken > 0, successor - first, 0))
    return (lengths, at, taken), {"free": free, "slots": slots, "at": ends - gaps * slots}, int(gaps.sum())
