"""A Merkle manifest of a dataset, built and verified by supersteps of messages.

Upward, each node of a tree sends its digest to its parent; a parent that has all
its children hashes them and is a node of the next superstep.  The subroots of
all trees are the leaves of one more tree, whose root stands for the dataset.
Downward, each parent sends its children their siblings and the path that it got
from above, so that every leaf can be folded to the root again.

Supersteps are pair RDDs keyed by (tree, place in the level); each level is
written to the shared scratch folder, so a lost executor repeats only the level
it was in."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BROADCAST_BYTES, materialize

ARITY = 8
WIDE = 32
#: Messages that a task of a superstep gets, as long as the cluster's cores aren't all busy.
MESSAGES = 20_000
NODE = "tree long, idx long, n long, digest binary, children binary"
PATH = "tree long, idx long, children binary, subroot binary, path binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns, each ``-`` if null, else its byte count, ``:`` and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _pieces(digests: bytes) -> list[bytes]:
    return [digests[i : i + WIDE] for i in range(0, len(digests), WIDE)]


def node_digest(children: list[bytes]) -> bytes:
    """The digest of a run of digests, which are hashed as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def path_entry(slot: int, children: list[bytes]) -> bytes:
    """The place of a child in its run, and its siblings."""
    return bytes([slot, len(children) - 1]) + b"".join(children[:slot] + children[slot + 1 :])


def path_steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a path, from below."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + path[at + 1] * WIDE
        out.append((path[at], _pieces(path[at + 2 : end])))
        at = end
    return out


def fold(digest: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a digest and its path lead to."""
    for slot, siblings in steps:
        digest = node_digest(siblings[:slot] + [digest] + siblings[slot:])
    return digest


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def numbered(rows: DataFrame, *order: Column, label: str) -> DataFrame:
    """The rows with ``index``, their place from 0 in an order over the whole table.

    The rows are sorted by ranges and written; each range's count gives the next
    one's first place, so only a row a range meets in one task."""
    placed = materialize(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    starts = starts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("index", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def _tasks(rdd: RDD, messages: int) -> int:
    return max(1, min(messages // MESSAGES + 1, 16 * rdd.context.defaultParallelism))


def _superstep_up(nodes: DataFrame, count: int, label: str) -> DataFrame:
    """The parents of all nodes whose trees have more than one."""
    messages = nodes.where("n > 1").select("tree", "idx", "n", "digest").rdd.map(lambda r: ((r[0], r[1] // ARITY), (r[1] % ARITY, r[2], bytes(r[3]))))

    def complete(item: tuple) -> tuple:
        (tree, idx), got = item
        got.sort()
        n, children = got[0][1], [d for _, _, d in got]
        if len(children) != min(ARITY, n - ARITY * idx):
            raise ValueError(f"node {idx} of tree {tree} has {len(children)} children")
        return tree, idx, -(-n // ARITY), node_digest(children), b"".join(children)

    parents = messages.combineByKey(lambda m: [m], lambda a, m: a + [m], lambda a, b: a + b, _tasks(messages, count)).map(complete)
    return materialize(nodes.sparkSession.createDataFrame(parents, NODE, verifySchema=False), label)


def climb(nodes: DataFrame, count: int, largest: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (tree, idx, n, digest), and (tree, digest) of all roots."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    for level in range(height(largest)):
        nodes = _superstep_up(nodes, count, f"{label}-up{level + 1}")
        levels.append(nodes)
        roots = roots.union(nodes.where("n = 1").select("tree", "digest"))
        count = -(-count // ARITY) + 1
    return levels, roots


def descend(levels: list[DataFrame], starts: DataFrame, count: int, label: str) -> DataFrame | None:
    """(tree, idx, children, subroot, path) of the parents of leaves, from ``starts``
    (tree, n, subroot, path): what each root knows and the leaves of its tree."""
    spark, below = starts.sparkSession, None
    for level in range(len(levels), 0, -1):
        own = levels[level - 1].select("tree", "idx", "children").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
        here = starts.select("tree", "n", "subroot", "path").rdd.filter(lambda r, level=level: height(r[1]) == level).map(lambda r: ((r[0], 0), (bytes(r[2]), bytes(r[3]))))
        if below is not None:

            def send(r) -> Iterator[tuple]:
                children = _pieces(bytes(r[2]))
                return (((r[0], r[1] * ARITY + i), (bytes(r[3]), path_entry(i, children) + bytes(r[4]))) for i in range(len(children)))

            here = here.union(below.select("tree", "idx", "children", "subroot", "path").rdd.flatMap(send))
        tasks = _tasks(own, count // ARITY ** (level - 1))
        met = own.join(here, tasks).map(lambda x: (x[0][0], x[0][1], x[1][0], x[1][1][0], x[1][1][1]))
        below = materialize(spark.createDataFrame(met, PATH, verifySchema=False), f"{label}-down{level}")
    return below


def verified_manifest(docs: DataFrame, tampered: Column, where: Column, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    Each group has a tree over its rows in ascending order of ``key`` (null
    first; rows with one key in the order of their leaves, repeated rows each a
    leaf), and the subroots in bytewise order of the groups, null first, have
    one more.  Where ``where`` holds, the folded root starts from the leaf with
    ``tampered`` in place of the column ``changed``, elsewhere from the leaf
    itself, always with the original siblings; it is verified if it is the root.
    Null, empty and very long values are hashed as the leaf's rule says, other
    columns aren't looked at, and an empty table gives no rows.  A group of any
    size is spread over all tasks: runs of 8 are the only groups that meet."""
    spark = docs.sparkSession
    other = leaf_digest(*[tampered if c == changed else F.col(c) for c in columns])
    leaves = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(group).cast("string").alias("group"), F.unhex(leaf_digest(*[F.col(c) for c in columns])).alias("leaf"), F.when(F.coalesce(where, F.lit(False)), F.unhex(other)).alias("other"))
    ranked = numbered(materialize(leaves, "merkle-leaves"), F.asc_nulls_first("group"), F.asc_nulls_first("doc_id"), F.asc("leaf"), label="merkle-sorted")
    groups = numbered(ranked.groupBy("group").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n")), F.asc_nulls_first("group"), label="merkle-groups")
    groups = groups.select(F.col("group").alias("_group"), "first", "n", F.col("index").alias("tree"))
    trees, size, largest, count = groups.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("_group"), F.lit(0)) + 24), F.max("n"), F.sum("n")).first()
    if not trees:
        return spark.createDataFrame([], RESULT)
    small = F.broadcast(groups) if size <= BROADCAST_BYTES else groups
    nodes = ranked.join(small, F.col("group").eqNullSafe(F.col("_group"))).select("tree", (F.col("index") - F.col("first")).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "other")
    levels, subroots = climb(nodes, count, largest, "merkle")
    tops = materialize(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).alias("n"), "digest"), "merkle-tops")
    top_levels, roots = climb(tops, trees, trees, "merkle-top")
    root = bytes(roots.first()["digest"])
    start = spark.createDataFrame([(0, trees, root, b"")], "tree long, n long, subroot binary, path binary")
    over = descend(top_levels, start, trees, "merkle-top")
    if over is None:
        paths = tops.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), F.lit(b"").alias("path"))
    else:

        def to_subroots(r) -> Iterator[tuple]:
            children = _pieces(bytes(r[2]))
            return ((r[1] * ARITY + i, children[i], path_entry(i, children) + bytes(r[4])) for i in range(len(children)))

        paths = spark.createDataFrame(over.select("tree", "idx", "children", "subroot", "path").rdd.flatMap(to_subroots), "tree long, subroot binary, path binary", verifySchema=False)
    starts = materialize(paths.join(groups.select("tree", "n"), "tree").select("tree", "n", "subroot", "path"), "merkle-starts")
    runs = starts.where("n = 1").select("tree", F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("children"), "subroot", "path", F.lit(True).alias("alone"))
    met = descend(levels, starts, count, "merkle")
    if met is not None:
        runs = runs.union(met.withColumn("alone", F.lit(False)))
    above = runs.rdd.map(lambda r: ((r[0], r[1]), (bytes(r[2]), bytes(r[3]), bytes(r[4]), r[5])))
    own = nodes.select("tree", "idx", "doc_id", "digest", "other").rdd.map(lambda r: ((r[0], r[1] // ARITY), (r[1] % ARITY, r[2], bytes(r[3]), r[4] and bytes(r[4]))))

    def close(item: tuple) -> Iterator[tuple]:
        members, (above_run,) = item[1]
        children, subroot, path, alone = above_run
        digests, rest = _pieces(children), path_steps(path)
        tail = "".join(d.hex() for _, siblings in rest for d in siblings)
        for slot, doc_id, leaf, changed_leaf in members:
            first = [] if alone else [(slot, digests[:slot] + digests[slot + 1 :])]
            proof = "".join(d.hex() for _, siblings in first for d in siblings) + tail
            folded = fold(changed_leaf or leaf, first + rest)
            yield doc_id, leaf.hex(), subroot.hex(), root.hex(), sha256(proof.encode()).hexdigest(), folded.hex(), folded == root

    return spark.createDataFrame(own.cogroup(above, _tasks(own, count)).flatMap(close), RESULT, verifySchema=False)
