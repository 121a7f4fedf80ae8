"""Reports and digests of all periods at once, as texts with their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import float_text
from strandline.operators.advice import severity_rank

DOUBLES = ("value_num", "coverage_ratio", "score")


def _shown(name: str) -> Column:
    return float_text(F.col(name)) if name in DOUBLES else F.col(name)


def _lines(*parts: Column) -> Column:
    """Arrays of lines joined by line breaks."""
    return F.array_join(F.concat(*parts), "\n")


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _metrics(metrics: DataFrame, period: str, columns: tuple[str, ...]) -> DataFrame:
    """A row a period: metric lines in the order of keys, and the first and last hash."""
    line = _line("metric_key=", F.col("metric_key"), *[x for c in columns for x in (f",{c}=", _shown(c))])
    rows = F.array_sort(F.collect_list(F.struct("metric_key", line.alias("line"), *columns, "input_hash")))
    return metrics.groupBy(period).agg(rows.alias("m"))


def _advice_lines(advice: DataFrame, period: str) -> DataFrame:
    line = _line("advice rule=", F.col("rule_key"), ",severity=", F.col("severity"), ",score=", _shown("score"), ',text="', F.col("advice_text"), '"')
    item = F.struct("rule_key", "severity", "score", "advice_text")
    rows = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("r"), F.col("rule_key").alias("k"), line.alias("line"), item.alias("item"))))
    return advice.groupBy(period).agg(rows.alias("a"))


def hourly_report(metrics: DataFrame, evidence: DataFrame) -> DataFrame:
    """(hour_ms, txt, json, csv, hour_hash, sha256) of each hour."""
    df = _metrics(metrics, "hour_ms", ("value_num", "coverage_ratio")).join(evidence, "hour_ms", "left")
    proof = F.when(F.col("evidence_json").isNull() | (F.col("evidence_json") == "[]"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("evidence[ top_app_minutes ]="), "evidence_json")))
    csv = F.concat(F.lit("coverage_ratio,metric_key,value_num\r\n"), F.array_join(F.transform("m", lambda x: F.concat_ws(",", float_text(x["coverage_ratio"]), x["metric_key"], float_text(x["value_num"]))), "\r\n"), F.lit("\r\n"))
    # numbers as plain digits, which to_json doesn't give for small ones
    each = F.transform("m", lambda x: F.concat(F.lit('"'), x["metric_key"], F.lit('":{"coverage_ratio":'), float_text(x["coverage_ratio"]), F.lit(',"value_num":'), float_text(x["value_num"]), F.lit("}")))
    some = F.when(F.size(_apps()) > 0, F.concat(F.lit('"evidence":{"top_app_minutes":'), "evidence_json", F.lit("},")))
    digest = F.coalesce(F.concat(F.lit('"'), F.col("m")[0]["input_hash"], F.lit('"')), F.lit("null"))
    body = F.concat(F.lit("{"), F.coalesce(some, F.lit("")), F.lit('"hour_hash":'), digest, F.lit(',"hour_start_ms":'), F.col("hour_ms").cast("string"), F.lit(',"metrics":{'), F.array_join(each, ","), F.lit("}}"))
    txt = _lines(F.col("m.line"), proof)
    return df.select("hour_ms", txt.alias("txt"), body.alias("json"), csv.alias("csv"), F.col("m")[0]["input_hash"].alias("hour_hash"), F.sha2(txt, 256).alias("sha256"))


def daily_report(metrics: DataFrame) -> DataFrame:
    """(day_ms, txt, json, csv, day_hash, sha256) of each day."""
    df = _metrics(metrics, "day_ms", ("value_num", "hours_counted", "low_conf_hours"))
    digest, text = F.col("m")[0]["input_hash"], lambda c: c.cast("string")
    txt = _lines(F.col("m.line"), F.array(F.concat(F.lit("day_hash="), digest)))
    fields = lambda x: (text(x["hours_counted"]), text(x["low_conf_hours"]), float_text(x["value_num"]))

    def item(x: Column) -> Column:
        counted, low, value = fields(x)
        return F.concat(F.lit('"'), x["metric_key"], F.lit('":{"hours_counted":'), counted, F.lit(',"low_conf_hours":'), low, F.lit(',"value_num":'), value, F.lit("}"))

    def row(x: Column) -> Column:
        counted, low, value = fields(x)
        return F.concat_ws(",", counted, low, x["metric_key"], value)

    body = F.concat(F.lit('{"day_hash":"'), digest, F.lit('","day_start_ms":'), text(F.col("day_ms")), F.lit(',"metrics":{'), F.array_join(F.transform("m", item), ","), F.lit("}}"))
    csv = F.concat(F.lit("hours_counted,low_conf_hours,metric_key,value_num\r\n"), F.array_join(F.transform("m", row), "\r\n"), F.lit("\r\n"))
    return df.select("day_ms", txt.alias("txt"), body.alias("json"), csv.alias("csv"), digest.alias("day_hash"), F.sha2(txt, 256).alias("sha256"))


def hourly_digest(metrics: DataFrame, evidence: DataFrame, advice: DataFrame) -> DataFrame:
    """(hour_ms, txt, json, hour_hash, sha256): metrics, evidence and advice, warnings first."""
    df = _metrics(metrics, "hour_ms", ("value_num", "coverage_ratio")).join(evidence, "hour_ms", "left").join(_advice_lines(advice, "hour_ms"), "hour_ms", "left")
    none = F.array().cast("array<string>")
    proof = F.when(F.col("evidence_json").isNull(), none).otherwise(F.array(F.concat(F.lit("evidence[top_app_minutes]="), "evidence_json")))
    txt = _lines(F.col("m.line"), proof, F.coalesce("a.line", none))
    last = F.element_at("m", -1)["input_hash"]
    return df.select("hour_ms", txt.alias("txt"), _digest_json("hour_ms", "hour_start_ms", last, "hour_hash", _evidence_map()).alias("json"), last.alias("hour_hash"), F.sha2(txt, 256).alias("sha256"))


def daily_digest(metrics: DataFrame, advice: DataFrame) -> DataFrame:
    """(day_ms, txt, json, day_hash, sha256)."""
    df = _metrics(metrics, "day_ms", ("value_num", "hours_counted", "low_conf_hours")).join(_advice_lines(advice, "day_ms"), "day_ms", "left")
    last = F.element_at("m", -1)["input_hash"]
    txt = _lines(F.col("m.line"), F.coalesce("a.line", F.array().cast("array<string>")), F.array(F.concat(F.lit("day_hash="), last)))
    return df.select("day_ms", txt.alias("txt"), _digest_json("day_ms", "day_start_ms", last, "day_hash").alias("json"), last.alias("day_hash"), F.sha2(txt, 256).alias("sha256"))


def _apps() -> Column:
    """The top apps of an hour; none for an hour without evidence."""
    return F.from_json("evidence_json", "array<struct<app_id string, minutes double>>")


def _evidence_map() -> Column:
    """``{"top_app_minutes": [...]}``, or an empty object."""
    filled = F.map_from_arrays(F.array(F.lit("top_app_minutes")), F.array(_apps()))
    return F.when(_apps().isNotNull(), filled).otherwise(F.map_filter(F.map_from_arrays(F.array(F.lit("top_app_minutes")), F.array(_apps())), lambda k, v: F.lit(False)))


def _digest_json(period: str, name: str, digest: Column, hash_name: str, evidence: Column | None = None) -> Column:
    values = F.map_from_entries(F.transform("m", lambda x: F.struct(x["metric_key"], x["value_num"])))
    fields = {"advice": F.coalesce("a.item", F.array()), name: F.col(period), hash_name: digest, "metrics": values}
    if evidence is not None:
        fields["evidence"] = evidence
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def artifact_path(kind: str, period: Column, digest: Column, form: str) -> Column:
    """``YYYY/MM/DD/kind-ms-hash8.form``; a missing hash gives zeros."""
    day = F.date_format(F.timestamp_millis(period), "yyyy/MM/dd")
    return F.concat(day, F.lit(f"/{kind}-"), period.cast("string"), F.lit("-"), F.substring(F.coalesce(digest, F.lit("0" * 8)), 1, 8), F.lit(f".{form}"))
