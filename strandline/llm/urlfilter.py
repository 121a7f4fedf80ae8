"""URL filters by expression digests (native DataFrame code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import ascii_lower

#: Rules up to this many rows are sent to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame of literals."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), r)]) for r in rules]
    kind = "array<struct<host:string,path:string,verdict:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host runs from the first ``://`` to ``/ ? #`` or the end,
    A to Z lower-cased; the path from there to ``? #`` or the end.  A null url
    or one without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: str) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _short(digest: Column) -> Column:
    """The first 4 bytes of a digest as a number: the key of the join."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, rule_host, verdict) for every row of ``pages``.

    Each url's expressions are the suffixes of its host at label borders and
    prefixes of its path, for each pair of labels and path length that some
    rule has.  They meet the rules by the first 4 bytes of their digests
    and count where the whole digests agree.  The longest rule (host and path)
    wins; at equal length a block goes first, then the greater text.  Urls
    without a rule get ``default``.  Null keys and repeated rows each keep a
    row.  Rules with a null field are left out; no rules leave all to
    ``default``."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).withColumn("host", ascii_lower(F.col("host"))).dropDuplicates(["host", "path", "verdict"])
    shape = rules.agg(F.array_sort(F.collect_set(F.struct(_labels("host").alias("labels"), F.length("path").alias("long")))).alias("shapes"), F.count(F.lit(1)).alias("n")).first()
    host, path = url_parts(F.col(url))
    seen = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    # repeated rows are counted within each part of the input, so none of them is brought to one task
    rows = seen.withColumn("part", F.spark_partition_id()).groupBy("page_id", "host", "path", "part").agg(F.count(F.lit(1)).alias("times"))
    shapes = F.array(*[F.struct(F.lit(x["labels"]).alias("labels"), F.lit(x["long"]).alias("long")) for x in shape["shapes"]]).cast("array<struct<labels:int,long:int>>")
    held = F.filter(shapes, lambda x: (x["labels"] <= F.col("host_labels")) & (x["long"] <= F.length("path")))
    found = F.transform(held, lambda x: _digest(F.call_function("substring_index", F.col("host"), F.lit("."), -x["labels"]), F.substring("path", F.lit(1), x["long"])))
    wide = rows.withColumn("host_labels", _labels("host")).withColumn("digest", F.explode_outer(found)).withColumn("short", _short(F.col("digest")))
    digest = _digest(F.col("host"), F.col("path"))
    table = rules.select(
        digest.alias("rule_digest"), _short(digest).alias("short"),
        F.struct(F.length(F.concat("host", "path")).alias("long"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), "verdict").alias("hit"),
    )
    if shape["n"] <= BROADCAST_RULES:
        met = wide.join(F.broadcast(table), "short", "left")
    else:  # a common expression may be on many rows: its rule is dealt to as many salts
        salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(32)).cast("int")
        met = wide.withColumn("salt", salt).join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), ["short", "salt"], "left")
    hit = F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("hit")))
    best = met.groupBy("page_id", "host", "path", "part", "times").agg(hit.alias("hit"))
    best = best.withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return best.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.rule_host").alias("rule_host"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
