"""Exact top-k by inner product, pruned with segment statistics, coarse to fine."""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandline.llm.common import materialize

SCALE = 1024.0
K = 10
SEGMENTS = (1, 4, 16)
#: Bytes of query vectors that one pass over the rows holds in each task.
BLOCK_BYTES = 16_000_000
#: Pairs whose bounds a task holds at once.
PAIRS = 1_000_000
#: Queries of a block whose rows give all its queries a first threshold.
REFERENCES = 2048
NONE = -np.inf


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows with an id and only finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~odd
    return vectors.where(ok).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Segment means and deviations, each times the root of the segment's length.

    For two vectors the product of these rows is at least their inner product:
    within a segment the means give their part exactly, and the rest is at most
    the product of the deviations.  In distances, it is the sum over segments of
    the squared differences of means and deviations, a lower bound."""
    parts = min(parts, x.shape[1])
    edges = np.linspace(0, x.shape[1], parts + 1).astype(int)
    n = np.diff(edges).astype(float)
    sums, squares = np.add.reduceat(x, edges[:-1], axis=1), np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.concatenate((sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0.0))), axis=1)


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.q = k, np.empty(0, np.int64)
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.float64)
        self.floor, self.n = floor.copy(), n

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - first[q]
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], scores[full])
        keep = rank < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]


def _search(best: Best, queries: np.ndarray, query_ids: np.ndarray, stats: list[np.ndarray], norms: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Offer the rows ``x`` to every query of the block."""
    own = query_ids[:, None] == ids[None, :]
    slack = 1e-9 * norms[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-6
    alive = ~own
    for parts, mine in zip(SEGMENTS, stats):
        theirs = statistics(x, parts)
        if alive.mean() > 0.1:
            bound = mine @ theirs.T + slack
            alive &= bound >= best.floor[:, None]
        else:
            qi, vi = np.nonzero(alive)
            bound = np.einsum("ij,ij->i", mine[qi], theirs[vi]) + slack[qi, vi]
            alive[qi, vi] = bound >= best.floor[qi]
    qi, vi = np.nonzero(alive)
    if not len(qi):
        return
    exact = (queries @ x.T)[qi, vi] if len(qi) > 0.1 * alive.size else np.einsum("ij,ij->i", queries[qi], x[vi])
    worth = exact >= best.floor[qi]
    best.add(qi[worth], ids[vi[worth]], exact[worth])


def _large(queries: np.ndarray, x: np.ndarray) -> bool:
    """Whether a product may pass the whole numbers that a double holds."""
    return float(abs(queries).max(initial=0)) * float(abs(x).max(initial=0)) * max(1, x.shape[1]) >= 2.0**52


def _search_large(held: dict, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> None:
    """Products of very large components in unbounded whole numbers; the ``k`` best
    (negative score, id) of each query are held."""
    rows = [(int(i), [int(v) for v in r]) for i, r in zip(ids, x)]
    for own, query in zip(query_ids.tolist(), queries):
        q = [int(v) for v in query]
        scored = [(-sum(a * b for a, b in zip(q, r)), i) for i, r in rows if i != own]
        held[own] = heapq.nsmallest(k, held.get(own, []) + scored)


def first_floors(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's ``k``-th best is not below: its ``k``-th best among
    the first ``REFERENCES`` queries, which are rows too."""
    floor = np.full(len(ids), NONE)
    some, others = x[:REFERENCES], ids[:REFERENCES]
    if len(others) <= k or not x.shape[1] or _large(x, x):
        return floor
    step = max(1, PAIRS // len(others))
    for at in range(0, len(ids), step):
        scores = x[at : at + step] @ some.T
        scores[ids[at : at + step, None] == others[None, :]] = NONE
        floor[at : at + step] = np.partition(scores, -k, axis=1)[:, -k]
    return floor


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, within: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products
    of floor(1024 * component), ties to the smaller vec_id, over all rows but
    those with the query's own id.

    ``vectors`` and ``queries`` have (vec_id, vector); ``within`` says that the
    queries are among the vectors, so that their scores with each other give a
    first threshold.  The rows are read once for each block of queries of
    bounded bytes; a task drops a row by the bounds of 1, 4 and 16 segments
    before it computes a product.  Vectors of another length than the query's,
    and those left out by ``usable``, take no part; a repeated row counts each time;
    a query id repeated with other vectors stands for the smallest of them;
    scores beyond 64 bits are held to the nearest long; no queries give no rows,
    and other columns of either table are not looked at."""
    spark = vectors.sparkSession
    asked = materialize(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "topk-queries")
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * 8 * (longest or 1) // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks if n else 0):
        rows = asked.where(F.col("block") == block).orderBy("vec_id").collect()
        parts.append(materialize(_pass(vectors, rows, k, within), "topk-part"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pass(vectors: DataFrame, rows: list, k: int, within: bool) -> DataFrame:
    """Candidates of one block of queries from every partition of the rows."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in {len(r["vector"]) for r in rows}:
        own = [r for r in rows if len(r["vector"]) == length]
        ids = np.array([r["vec_id"] for r in own], np.int64)
        x = np.floor(np.array([r["vector"] for r in own], np.float64).reshape(len(own), length) * SCALE)
        by_length[length] = ids, x, first_floors(ids, x, k) if within else np.full(len(ids), NONE)
    sent = vectors.sparkSession.sparkContext.broadcast(by_length)

    def fresh(length: int) -> dict:
        ids, x, floor = sent.value[length]
        stats = [statistics(x, p) for p in SEGMENTS] if length else []
        return {"ids": ids, "x": x, "stats": stats, "norms": np.linalg.norm(x, axis=1), "best": Best(len(ids), k, floor.copy())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, dict] = {}
        found: list[tuple[int, int, int]] = []
        held: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            lists = b.column("vector")
            flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lengths)
            for length in np.unique(lengths):
                if int(length) not in sent.value:
                    continue
                state = states.setdefault(int(length), None) or fresh(int(length))
                states[int(length)] = state
                at = np.nonzero(lengths == length)[0]
                x = np.floor(flat[(ends[at] - length)[:, None] + np.arange(length)[None, :]] * SCALE)
                step = max(1, PAIRS // max(1, len(state["ids"])))
                for i in range(0, len(at), step):
                    some, own = x[i : i + step], ids[at[i : i + step]]
                    if length == 0 or _large(state["x"], some):
                        _search_large(held, state["x"], state["ids"], own, some, k)
                    else:
                        _search(state["best"], state["x"], state["ids"], state["stats"], state["norms"], own, some)
        for state in states.values():
            best = state["best"]
            found += zip(state["ids"][best.q].tolist(), best.ids.tolist(), best.scores.astype(np.int64).tolist())
        found += [(q, i, max(-(2**63), min(2**63 - 1, -s))) for q, best in held.items() for s, i in best]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score long")


def query_rows(vectors: DataFrame, every: int) -> Column:
    """The stated query set: ids divisible by ``every``."""
    return F.pmod("vec_id", F.lit(every)) == 0
