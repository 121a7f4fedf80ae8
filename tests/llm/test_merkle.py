"""The Merkle manifest against a plain tree, and odd rows."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle
from strandline.llm.common import ascii_lower

DOC = "doc_id long, source string, lang string, n_chars long, text string, tree int, idx string, n int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def tree(leaves):
    """Root and each leaf's (place, siblings) from below."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    nodes = list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 8 : i - i % 8 + 8]
            paths[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            at[k] = i // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([m[2] for m in sorted(groups[g], key=lambda m: m[:3])]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        subroot, paths = trees[g]
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda m: m[:3]), paths):
            folded = own
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf(r, r[4] and r[4].translate({i: i + 32 for i in range(65, 91)}))
            siblings = []
            for slot, others in path + top:
                folded = h(*others[:slot], folded, *others[slot:])
                siblings += others
            out.append((r[0], own, subroot, root, h(*siblings), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOC).repartition(parts)
    got = merkle.verified_manifest(docs, ascii_lower(F.col("text")), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("counts", [{"en": 700, "de": 65, "fr": 9, "es": 8, None: 1}, {"a": 3}, {f"g{i}": 1 + i % 3 for i in range(70)}])
def test_manifest_is_that_of_a_plain_tree(spark, counts):
    rng, rows = random.Random(3), []
    for g, n in counts.items():
        for _ in range(n):
            i = len(rows) * 7 + 1
            rows.append((i, rng.choice(["web", None, ""]), g, rng.choice([None, i]), rng.choice([None, "", "lower é", f"Upper {i} 漢", "ÉÀ"])))
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == plain(rows)
    chosen = {r[0] for r in rows if crc32(str(r[0]).encode()) % 3 == 0 and r[4] and r[4] != ascii_only_lower(r[4])}
    assert {r[0] for r in got if not r[6]} == chosen


def ascii_only_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_few_odd_and_repeated_rows(spark):
    assert run(spark, []) == []
    one = [(5, "s", "en", 3, "Abc")]
    assert run(spark, one) == plain(one)
    assert run(spark, one)[0][1] == run(spark, one)[0][3]  # a lone leaf is the root
    rows = [(5, "s", "en", 3, "Abc")] * 20 + [(None, None, None, None, None), (None, "s", "en", 1, "X"), (5, "s", "en", 3, "other"), (6, "s", "", 0, "Q" * 100_000)]
    assert run(spark, rows) == plain(rows)


def test_a_path_folds_to_the_root_only_for_its_own_leaf():
    leaves = [sha256(str(i).encode()).digest() for i in range(8)]
    root = merkle.node_digest(leaves)
    steps = merkle.path_steps(merkle.path_entry(3, leaves))
    assert merkle.fold(leaves[3], steps) == root
    assert merkle.fold(leaves[4], steps) != root
    assert [merkle.height(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]


def test_a_lost_child_is_noticed(spark):
    nodes = spark.createDataFrame([(0, i, 5, sha256(b"x").digest()) for i in (0, 1, 2, 4)], "tree long, idx long, n long, digest binary")
    with pytest.raises(Exception, match="children"):
        merkle.climb(nodes, 5, 5, "test-lost")
