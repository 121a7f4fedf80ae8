"""The corpus pipeline: five of the operators in a row over ``documents``.

All stages read only the columns of documents, so further columns of any name
are left behind and clash with nothing.  An empty table stays empty, rows with
null fields and repeated rows go through like others, and texts of any length
are whole; what a stage does with them is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import minhash, mixing, packing, quality, substring
from strandline.llm.common import bounded, materialize
from strandline.llm.queries import COLUMNS, quality_model, table

#: A document goes only if its probability of good quality is below this.
REJECT_BELOW = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    The model learns from the labels of ``sf_dir``; scores meet their documents
    by id and a hash of the text.  A null text is scored as an empty one, repeated
    rows share their decision, and without labels every document stays."""
    docs = _columns(docs)
    mark = F.xxhash64("text")
    scored = quality.score_texts(docs, quality_model(spark, sf_dir), REJECT_BELOW, also={"_mark": mark})
    gone = materialize(scored.where("predicted = 0").select("doc_id", "_mark").distinct(), "pipeline-rejected")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._m") == F.col("g._mark"))
    return _columns(docs.withColumn("_m", mark).alias("d").join(bounded(gone).alias("g"), same, "left_anti"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Rows without an id or without words have no duplicates and stay, and rows
    that repeat a kept id all stay."""
    return _columns(minhash.keep_first(docs))


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier one has.

    Null texts and rows without an id stay as they are; a document that loses
    all sentences keeps an empty text."""
    cleaned = substring.remove_repeats(_columns(docs))
    return _columns(cleaned.withColumn("n_chars", F.length("text").cast("long")))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows are told apart by a number of their own, so repeated ids and null ids
    are rows like any other; null sources are one source, and null texts have
    size 0, of which the mix takes some like of other sizes."""
    marked = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = mixing.mix(marked, key="_row").where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    repeated = marked.join(bounded(materialize(taken, "pipeline-copies")), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _columns(repeated)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is one piece of one id."""
    return packing.pack(packing.token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("minhash", keep_first_copies),
    ("substring", drop_repeated_spans),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Classifier, sentence spans and tokens have no SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
