"""Near-duplicates of word shingles by MinHash with tensored banding.

A table key needs several minhashes.  Instead of computing them anew for every
table, two small collections of half keys are made, each half key of
``HALF`` minhashes, and every pair of halves keys a table: m + m half keys give
m * m tables.  Candidates are confirmed on whole shingle sets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded, connected_components, materialize, release, slices

WORDS = 5
SIMILARITY = 80
#: Minhashes in a half key; a table key has twice as many.
HALF = 3
#: Chance that the tables miss a pair just at the threshold.
MISS = 1e-4
#: Tables with up to so many members compare them pair by pair.
SMALL = 8
#: Shingles of a chunk of a large family; pairs of chunks are compared in one task.
CHUNK = 1 << 16
#: Members of a large family that are compared with all others of it first.
HUBS = 8
#: Words whose hashes a task keeps (some 10 MB).
KNOWN = 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def collections_for(similarity: int, miss: float = MISS) -> int:
    """How many half keys each collection needs so that at the threshold both
    collections agree somewhere but for a chance of ``miss``."""
    agree = (similarity / 100) ** HALF
    return math.ceil(math.log(miss / 2) / math.log(1 - agree))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words, computed once and forgotten beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, words: int, known: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text: words are runs
    without space and characters 9 to 13, A to Z lower-cased; a text of fewer
    words than a shingle is one shingle; without words there is none."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    value = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        value = _mix(value * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(value)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
    return base[:n], base[n:] | _U(1)


def half_keys(sets: list[np.ndarray], each: int) -> np.ndarray:
    """(set, 2 * each) half keys of non-empty sets."""
    joined = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    keys = np.zeros((len(sets), 2 * each), np.uint64)
    xor, mul = _seeds(2 * each * HALF)
    for i in range(2 * each * HALF):
        least = np.minimum.reduceat((joined ^ xor[i]) * mul[i], starts)
        keys[:, i // HALF] = _mix(keys[:, i // HALF] + least)
    return _mix(keys + np.arange(1, 2 * each + 1, dtype=np.uint64)[None, :])


def sketches(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """(doc_id, n, mark, left, right) of every row: set size, a 128-bit mark of
    the set, and the two collections of half keys (null for empty sets)."""
    each = collections_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in slices(batches):
            sets = [shingles(t.as_py(), words, known) for t in b.column("text")]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = half_keys([sets[i] for i in some], each).view(np.int64) if some else np.empty((0, 2 * each), np.int64)
            left: list = [None] * len(sets)
            right: list = [None] * len(sets)
            for row, i in enumerate(some):
                left[i], right[i] = keys[row, :each], keys[row, each:]
            marks = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                ["doc_id", "n", "mark", "left", "right"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, mark string, left array<long>, right array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n): the tables of each class in which another may stand.

    Half keys that only one class has are dropped first, so most documents
    enter no table at all."""
    halves = classes.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("keys")), F.struct(F.lit(1).alias("side"), F.col("right").alias("keys")))).alias("s"))
    halves = halves.select("id", "s.side", F.explode("s.keys").alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "minhash-halves")
    live = halves.join(bounded(shared), "half", "left_semi").groupBy("id")
    live = live.agg(*[F.collect_set(F.when(F.col("side") == i, F.col("half"))).alias(x) for i, x in enumerate(("a", "b"))])
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = live.select("id", F.explode(pairs).alias("key")).join(classes.select("id", "n"), "id").select("key", "id", "n")
    keys = materialize(keys, "minhash-keys")
    release(shared)
    return keys


def candidates(keys: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of small tables and members (family, id) of large ones.

    Tables are counted first.  One of two members is a pair as it stands; up to
    SMALL members are paired if their sizes allow the similarity; larger
    tables that share members join into families."""
    tables = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("u"), F.max("id").alias("v")).where("c > 1"), "minhash-tables")
    two = tables.where("c = 2").select("u", "v").distinct()
    wider = materialize(tables.where("c > 2").select("key", "c", F.col("u").alias("least")), "minhash-wider")
    more = materialize(keys.join(bounded(wider), "key"), "minhash-members")
    grouped = more.where(F.col("c") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m"))
    fits = lambda x, y: (x["id"] < y["id"]) & (F.greatest(x["n"], y["n"]) * similarity <= F.least(x["n"], y["n"]) * 100)
    own = F.transform("m", lambda x: F.transform(F.filter("m", lambda y: fits(x, y)), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v"))))
    small = grouped.select(F.explode(F.flatten(own)).alias("p")).select("p.u", "p.v").distinct()
    # a member of many large tables points to one of their least members, and those to each other
    held = more.where(F.col("c") > SMALL).groupBy("id").agg(F.min("least").alias("u"), F.collect_set("least").alias("all"))
    large = held.select("u", F.explode(F.array_union("all", F.array("id"))).alias("v")).where("u <> v").distinct()
    labels = connected_components(large, "minhash-families")
    families = materialize(labels.select(F.col("component").alias("family"), "id"), "minhash-families")
    release(labels)
    pairs = two.union(small).distinct()
    in_u, in_v = (families.select(F.col("id").alias(x), F.col("family").alias(f"f{x}")) for x in "uv")
    apart = pairs.join(in_u, "u", "left").join(in_v, "v", "left").where("fu IS NULL OR fv IS NULL OR fu <> fv")
    apart = materialize(apart.select("u", "v"), "minhash-pairs")
    release(keys, tables, wider, more)
    return apart, families


def shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, shingles) of one row for each of ``ids``; the set as bytes of
    sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in slices(batches):
            sets = [shingles(t.as_py(), words, known) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "mark", "n", "shingles"])

    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(bounded(materialize(ids.select("id").distinct(), "minhash-wanted")), "id", "left_semi")
    return some.mapInArrow(run, "id long, mark string, n long, shingles binary")


def _alike(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def confirm_pairs(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the similarity."""
    wide = bounded(pairs).join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good = [_alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), similarity) for a, b in zip(x.column("a"), x.column("b"))]
            yield x.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return wide.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def linked_within(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links that join the same members as all links would; with two groups,
    links across them.

    Two sets can only be alike if they share one of the rarest shingles of
    each (as many as the similarity leaves room for), so members meet through
    those; pairs that are joined already are not compared again."""
    names, spots = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(spots, minlength=len(names))
    code = np.empty(len(names), np.int64)
    code[np.lexsort((names, often))] = np.arange(len(names))
    cut = np.cumsum([0, *map(len, sets)])
    ranked = [np.sort(code[spots[a:z]]) for a, z in zip(cut[:-1], cut[1:])]
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lists: dict[int, list[int]] = defaultdict(list)
    links: list[tuple[int, int]] = []
    hubs: list[int] = []
    for i in sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(ids[k]))):
        mine = ranked[i]
        room = len(mine) - -(-similarity * len(mine) // 100) + 1
        met = {j for s in mine[:room].tolist() for j in lists[s]}
        for j in sorted(met, key=lambda j: (j not in hubs, -j)) if met else ():
            if group[i] == group[j] and group.max() > 0 or top(i) == top(j) or 100 * len(sets[j]) < similarity * len(mine):
                continue
            both = len(np.intersect1d(mine, ranked[j], assume_unique=True))
            if 100 * both >= similarity * (len(mine) + len(ranked[j]) - both):
                links.append((int(ids[i]), int(ids[j])))
                root[top(i)] = top(j)
                if j not in hubs:
                    hubs = [j, *hubs[:15]]
        for s in mine[:room].tolist():
            lists[s].append(i)
    return links


def _parts(n) -> Column:
    """Chunks that shingles ``n`` in all are cut into."""
    return F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int")


def _dealt(parts) -> Column:
    """The chunk of a member among ``parts``."""
    return F.pmod(F.xxhash64("id"), parts).cast("int")


def _unit_links(units: DataFrame, sets: DataFrame, keys: list[str], similarity: int) -> DataFrame:
    """Links (u, v) inside each unit (keys, id, side), or across its sides if it has two."""

    def run(unit: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in unit.column("shingles")]
        links = linked_within(unit.column("id").to_numpy(), sets_, unit.column("side").to_numpy(), similarity)
        links = [x for x in links if x[0] != x[1]]
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return units.join(sets.select("id", "shingles"), "id").groupBy(*keys).applyInArrow(run, "u long, v long")


def join_hubs(members: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame, list[DataFrame]]:
    """(family, id, n, cohort) for ``members`` (family, id, n), and tables of links
    (u, v) that join each cohort.

    HUBS members of each family of over a chunk are sent to all its chunks, so
    this work grows with the family and not with its square.  Members that
    links to hubs join are a cohort; those that no hub reaches choose hubs of
    their own, as long as a turn joins half of them, and are cohort '' then."""
    left, done, links = materialize(members, "minhash-left"), [], []
    while True:
        hubs = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(HUBS)]))
        large = materialize(left.groupBy("family").agg(_parts(F.sum("n")).alias("parts"), F.count(F.lit(1)).alias("c"), hubs.alias("hubs")).where("parts > 1"), "minhash-large")
        before = large.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if not before:
            break
        placed = left.join(bounded(large.select("family", "parts")), "family").select("family", _dealt(F.col("parts")).alias("a"), "id", F.lit(1).alias("side"))
        sent = large.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), "hubs").select("family", "a", F.explode("hubs").alias("id"), F.lit(0).alias("side"))
        found = materialize(_unit_links(placed.union(sent), sets, ["family", "a"], similarity), "minhash-hub-links")
        labels = connected_components(found, "minhash-cohorts")
        links.append(found)
        done.append(materialize(left.join(labels, "id").select("family", "id", "n", F.col("component").cast("string").alias("cohort")), "minhash-cohorts"))
        rest = materialize(left.join(labels.select("id"), "id", "left_anti").select("family", "id", "n"), "minhash-left")
        joined = labels.count()
        release(left, large, labels)
        left = rest
        if 2 * joined < before:
            break
    found = left.select("family", "id", "n", F.lit("").alias("cohort"))
    for table in done:
        found = found.union(table)
    return found, links


def confirm_families(families: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) that join the members of families as all their links would.

    Cohorts are joined already, so only members of two cohorts, or of none, can
    still give a link that joins more.  Cohorts are cut into chunks of bounded
    shingles, and every two chunks to be compared meet in a unit of their own,
    so memory doesn't grow with the family."""
    members, links = join_hubs(families.join(sets.select("id", "n"), "id").select("family", "id", "n"), sets, similarity)
    members = materialize(members, "minhash-cohort-members")
    sizes = materialize(members.groupBy("family", "cohort").agg(_parts(F.sum("n")).alias("parts")), "minhash-chunks")
    one, other = (sizes.select("family", F.col("cohort").alias(c), F.col("parts").alias(f"parts_{c}")) for c in ("one", "other"))
    pairs = materialize(one.join(other, "family").where("one < other OR (one = '' AND other = '')"), "minhash-cohort-pairs")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("cohort")), F.struct(F.lit(1).alias("side"), F.col("other").alias("cohort")))
    asked = pairs.withColumn("s", F.explode(sides)).where("one <> other OR s.side = 0").select("family", "one", "other", "parts_one", "parts_other", "s.side", "s.cohort")
    first = F.col("side") == 0
    met = members.join(asked, ["family", "cohort"])
    met = met.withColumn("own", _dealt(F.when(first, F.col("parts_one")).otherwise(F.col("parts_other"))))
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0), F.when(first, F.col("parts_other")).otherwise(F.col("parts_one")) - 1)))
    alone = F.col("one") == F.col("other")
    units = met.select(
        "family", "one", "other", "id",
        F.when(alone, F.least("own", "to")).when(first, F.col("own")).otherwise(F.col("to")).alias("a"),
        F.when(alone, F.greatest("own", "to")).when(first, F.col("to")).otherwise(F.col("own")).alias("b"),
        F.when(alone, (F.col("own") > F.col("to")).cast("int")).otherwise(F.col("side")).alias("side"),
    )
    found = _unit_links(units, sets, ["family", "one", "other", "a", "b"], similarity)
    for table in links:
        found = found.union(table)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links) of every row of ``docs``
    (doc_id, text).

    Two documents are linked if 100 * |both sets| >= similarity * |either|;
    component_id is the smallest doc_id reachable by links.  Equal sets are
    first brought together, so thousands of copies count as one.  ``links``
    says to how many other classes of equal sets confirmed links were kept.
    Empty and null texts, and rows with a null doc_id, are linked with
    nothing; a null doc_id has a null component and is kept.  Rows that repeat
    a doc_id share its component."""
    sketched = materialize(sketches(docs, words, similarity), "minhash-sketches")
    rows = materialize(sketched.select("doc_id", "n", "mark"), "minhash-rows")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = materialize(classes, "minhash-classes")
    release(sketched)
    pairs, families = candidates(table_keys(classes), similarity)
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).union(families.select("id"))
    sets = shingle_table(docs, wanted, words).join(classes.select("id", "mark"), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    sets = materialize(sets.select("id", "n", "shingles"), "minhash-sets")
    links = materialize(confirm_pairs(pairs, sets, similarity).union(confirm_families(families, sets, similarity)), "minhash-links")
    degree = links.union(links.select("v", "u")).groupBy("u").agg(F.count_distinct("v").alias("links")).withColumnRenamed("u", "id")
    # rows with the doc_id of a class's least row hang together as well as those of equal sets
    same = full.join(classes.where("id < last").select("mark", "id"), "mark").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    labels = connected_components(links.union(same), "minhash-components")
    whole = materialize(labels.where("component < id").withColumnRenamed("id", "doc_id"), "minhash-result")
    degree = materialize(degree.withColumnRenamed("id", "doc_id"), "minhash-degree")
    release(pairs, families, sets, links, labels, classes)
    found = rows.join(bounded(whole), "doc_id", "left").join(bounded(degree), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_first(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is that of their group; all columns stay.

    Rows that repeat a kept doc_id all stay."""
    gone = materialize(near_duplicates(docs, words, similarity).where(~F.col("kept")).select("doc_id").distinct(), "minhash-gone")
    return docs.join(bounded(gone), "doc_id", "left_anti")
