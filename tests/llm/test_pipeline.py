"""The pipeline at the smallest size, stage by stage against plain Python."""

import numpy as np

import __spark_entry__
import corpus_pipeline
from strandline.llm import mixing, packing, quality, substring
from strandline.llm.queries import COLUMNS, quality_model
from tests.llm.test_operators import groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_model(spark, SF)
    model.weights = model.weights.astype(np.float32)
    for name, stage in corpus_pipeline.STAGES:
        before = rows.collect()
        rows = corpus_pipeline.materialize(stage(spark, rows, SF), f"test-{name}")
        after = rows.collect()
        if name != "packing":
            assert rows.columns == list(COLUMNS)
        ids = sorted(r.doc_id for r in after)
        if name == "quality":
            assert ids == sorted(r.doc_id for r in before if quality.score(model, r.text) >= corpus_pipeline.REJECT_BELOW)
        elif name == "minhash":
            want = groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "substring":
            assert {r.doc_id: r.text for r in after} == plain_substring({r.doc_id: r.text for r in before})
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
            assert abs(len(after) - sum(taken.values())) <= 0.1 * len(after) and set(ids) <= set(taken)
        else:
            encode = packing.encoder(packing.VOCABULARY, packing.RANKS)
            assert sum(r.length for r in after) == sum(len(encode(r.text)) + 1 for r in before)


def plain_substring(texts):
    """Spans in a dictionary instead of a join."""
    first, found = {}, {}
    for i in sorted(texts):
        value, a, z = substring.spans(substring.sentences(texts[i]))
        found[i] = list(zip(value.tolist(), a.tolist(), z.tolist()))
        for v, x, y in sorted(found[i], key=lambda s: s[1:]):
            first.setdefault(v, (i, x, y))
    return {i: substring.without(t, [{"a": x, "z": y} for v, x, y in found[i] if first[v] != (i, x, y)])[0] for i, t in texts.items()}


def test_registered():
    assert "pipeline" in __spark_entry__.queries() and len([k for k in __spark_entry__.queries() if k.startswith("op")]) == 10


def test_stages_take_odd_rows(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 15)] * 2 + [(None, None, None, None, None), (3, "x", "en", None, 1), (4, "", "en", "t", 0), (5, "w " * 30_000, "en", "t", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS _m", "2 AS _row", "3 AS _copy", "4 AS copies", "5 AS row")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == list(COLUMNS) and stage(spark, docs.limit(0), SF).count() == 0
        if name != "mixing":
            assert got.count() == 6
        else:
            assert {r.doc_id for r in got.collect()} <= {1, None, 3, 4, 5}
