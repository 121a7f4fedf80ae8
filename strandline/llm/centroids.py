"""Centroid clustering with Drake's adaptive bounds, exact in whole numbers.

Each vector keeps an upper bound of the distance to its own centroid, lower
bounds of the distances to its several next ones in ascending order, and one
remainder bound for all others.  When the centroids have moved the bounds are
widened by the moves; a vector looks again only at the centroids that its bounds
don't rule out, and at all of them where even the remainder bound can't."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, release

#: Rows whose distances a task holds at once.
ROWS = 2048
#: Components and sums up to this size are computed in 64 bits, larger ones in unbounded whole numbers.
SMALL = 1 << 26
#: Bits of a part of a sum, so that Spark can add the parts of all tasks in 64 bits.
PART_BITS = 40
MOST = (1 << 63) - 1
STATE = "vec_id long, x array<double>, cluster int, upper double, near array<int>, low array<double>, distance long, part int, n long, sums array<long>, used int, kind int"


def kept_vectors(rows: DataFrame, components: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with exactly ``components`` finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == components) & ~odd).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole as 64-bit numbers, or as unbounded ones if any is large."""
    if np.abs(x).max(initial=0.0) < SMALL:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    d = x - c
    return (d * d).sum(axis=-1)


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Pass:
    """One assignment of the rows of a task to centroids that have moved."""

    def __init__(self, centroids: list[list[int]], moves: np.ndarray | None, held: int):
        large = any(abs(v) >= SMALL for c in centroids for v in c)
        self.c = np.array(centroids, dtype=object if large else np.int64)
        self.moves, self.k = moves, len(centroids)
        self.b = min(held, self.k - 1)
        self.used = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """All distances: own centroid, upper bound, next ones, lower bounds."""
        d = np.stack([_squared(x, c) for c in self.c], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, : self.b + 2]
        sorted_d = _roots(np.take_along_axis(d, order, axis=1))
        low = np.full((len(x), self.b + 1), np.inf)
        low[:, : sorted_d.shape[1] - 1] = sorted_d[:, 1:]
        return order[:, 0].astype(np.int32), sorted_d[:, 0], order[:, 1 : self.b + 1].astype(np.int32), low

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for rows with bounds from before the moves."""
        if x.dtype == object or self.c.dtype == object:
            return self.nearest(x)
        own, near = own.copy(), near[:, : self.b].copy()
        low = low[:, : self.b + 1].copy()
        upper = upper + self.moves[own]
        low[:, : self.b] -= self.moves[near]
        low[:, self.b] -= self.moves.max()
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        sure = lambda u, bound: u * (1 + 1e-12) + 1e-9 < bound * (1 - 1e-12)
        at = np.nonzero(~sure(upper, low[:, 0]))[0]
        upper[at] = _roots(_squared(x[at], self.c[own[at]]))
        depth = np.zeros(len(x), np.int64)  # so many of the next centroids aren't ruled out
        depth[at] = (~sure(upper[at, None], low[at])).sum(axis=1)
        self.used = max(self.used, int(min(depth.max(initial=0), self.b)))
        for z in np.unique(depth[(depth > 0) & (depth <= self.b)]):
            rows = np.nonzero(depth == z)[0]
            some = np.sort(np.concatenate((own[rows, None], near[rows, :z]), axis=1), axis=1)
            d = _squared(x[rows][:, None, :], self.c[some])
            order = np.argsort(d, axis=1, kind="stable")
            some, d = np.take_along_axis(some, order, axis=1), _roots(np.take_along_axis(d, order, axis=1))
            own[rows], upper[rows], near[rows, :z], low[rows, :z] = some[:, 0], d[:, 0], some[:, 1:], d[:, 1:]
        rows = np.nonzero(depth > self.b)[0]
        if len(rows):
            own[rows], upper[rows], near[rows], low[rows] = self.nearest(x[rows])
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        return own, upper, near, low


def _parts(total: list[int]) -> list[list[int]]:
    """Whole numbers as parts of PART_BITS bits each, the last with the sign."""
    n = max(1, *(-(-(v.bit_length() + 1) // PART_BITS) for v in total))
    mask = (1 << PART_BITS) - 1
    return [[(v >> (PART_BITS * j)) & mask if j < n - 1 else v >> (PART_BITS * j) for v in total] for j in range(n)]


def _array(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, wide = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _pass(state: DataFrame, centroids: list[list[int]], moves: np.ndarray | None, held: int, scale: float, last: bool) -> DataFrame:
    """The next state (kind 0) and, of each task, how sums and counts of the clusters change (kind 1)."""
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("distance", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("used", pa.int32()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Pass(centroids, moves, held)
        totals: dict[int, list] = {}

        def count(own: np.ndarray, x: np.ndarray, sign: int) -> None:
            for c in np.unique(own):
                mine = x[own == c]
                n, sums = totals.get(int(c), (0, 0))
                totals[int(c)] = [n + sign * len(mine), sums + sign * mine.sum(axis=0).astype(object)]

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                n = some.num_rows
                raw = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                first = moves is None
                raw = np.floor(scale * raw) if first else raw
                x = _whole(raw)
                if first:
                    own, upper, near, low = here.nearest(x)
                    count(own, x, 1)
                else:
                    was = some.column("cluster").to_numpy()
                    wide = lambda name: some.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    own, upper, near, low = here.assign(x, was, some.column("upper").to_numpy(), wide("near"), wide("low"))
                    moved = own != was
                    count(was[moved], x[moved], -1)
                    count(own[moved], x[moved], 1)
                none = pa.nulls(n)
                exact = pa.array([min(MOST, int(v)) for v in _squared(x, here.c[own])], pa.int64()) if last else none.cast(pa.int64())
                bounds = [none.cast(schema.field(f).type) for f in ("x", "upper", "near", "low")] if last else [_array(raw, pa.float64()), pa.array(upper), _array(near, pa.int32()), _array(low, pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), bounds[0], pa.array(own, pa.int32()), *bounds[1:], exact, none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), none.cast(pa.int32()), pa.array(np.zeros(n, np.int32))],
                    schema=schema,
                )
        rows = [{"cluster": c, "part": j, "n": n if j == 0 else 0, "sums": part, "used": here.used, "kind": 1} for c, (n, sums) in totals.items() for j, part in enumerate(_parts([int(v) for v in sums]))]
        rows.append({"cluster": 0, "part": 0, "n": 0, "sums": [0] * len(centroids[0]), "used": here.used, "kind": 1})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = ["vec_id", "x"] if moves is None else ["vec_id", "x", "cluster", "upper", "near", "low"]
    return state.select(*names).mapInArrow(run, STATE)


def cluster(vectors: DataFrame, k: int, rounds: int, scale: float, seed: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row
    of ``vectors`` (vec_id, x) after ``rounds`` replacements of the centroids.

    A component counts as floor(scale * x).  The first centroids are the ``k``
    vectors with the smallest sha256 of ``seed`` and their id; fewer vectors make
    fewer centroids.  Distances are compared exactly, ties go to the smaller
    centroid number; means are exact floors, and an empty centroid stays.
    Rows that repeat count each time (of equal hashes the smaller vector comes
    first), rows with a null id are clustered but come last as first centroids,
    and no rows give no rows.  Other columns aren't looked at.  Components of
    any finite size are exact; distances and their sums beyond 64 bits are held
    to the largest long."""
    spark = vectors.sparkSession
    starts = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).select("x").collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    wide = len(starts[0]["x"])
    centroids = [[math.floor(scale * v) for v in r["x"]] for r in starts]
    total: list[tuple[int, list[int]]] = [(0, [0] * wide) for _ in centroids]
    held = max(1, len(centroids) // 4)
    least = max(1, len(centroids) // 8)
    state, moves, written = vectors, None, None
    for turn in range(rounds + 1):
        out = materialize(_pass(state, centroids, moves, held, scale, turn == rounds), f"centroids-{turn}", by="kind")
        if written is not None:
            release(written)
        written, state = out, out.where("kind = 0")
        if turn == rounds:
            break
        changes = out.where("kind = 1").groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.max("used").alias("used"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)]).collect()  # k rows for each part
        for r in changes:
            n, sums = total[r["cluster"]]
            total[r["cluster"]] = n + r["n"], [s + (r[f"s{i}"] << (PART_BITS * r["part"])) for i, s in enumerate(sums)]
        if moves is not None:
            held = max(least, min(held, max(r["used"] for r in changes)))
        fresh = [[s // n for s in sums] if n else old for (n, sums), old in zip(total, centroids)]
        moves = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + 1e-12) for x, y in zip(fresh, centroids)])
        centroids = fresh
    inertia = {r["cluster"]: MOST if r["s"] is None else r["s"] for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = min(MOST, sum(inertia.values()))
    rows = [(c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
