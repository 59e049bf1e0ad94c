"""The data side of an optional model review of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrier.schema import severity_rank

#: What an answer may say, and how long its texts may be.
VERDICTS = ["malicious", "suspicious", "benign", "unknown"]
CONFIDENCES = ["low", "medium", "high"]
SHORT, LONG = 100, 1000
_ANSWER = "verdict string, confidence string, category string, summary string, recommended_action string"


def mark_pending(alerts: DataFrame, min_severity: str) -> DataFrame:
    """analysis_status `pending` for alerts of that severity or more."""
    return alerts.withColumn("analysis_status", F.when(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)), "pending"))


def mark_skipped(alerts: DataFrame, capacity: int, batch: str = "event_date") -> DataFrame:
    """Pending alerts of a batch beyond the queue's capacity are skipped."""
    order = Window.partitionBy(batch, "analysis_status").orderBy("timestamp", "seq")
    full = (F.col("analysis_status") == "pending") & (F.row_number().over(order) > capacity)
    return alerts.withColumn("__full", full).withColumns({"analysis_status": F.when(F.col("__full"), "skipped").otherwise(F.col("analysis_status")), "analysis_error": F.when(F.col("__full"), "analysis queue full")}).drop("__full")


def analysis_payload(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """id and request: the alert and its event as JSON in which no tag can begin."""
    e = events.select(F.struct(*events.columns).alias("event"), F.col("ip").alias("e_ip"), F.col("seq").alias("e_seq"))
    rows = alerts.join(e, (F.col("ip") == F.col("e_ip")) & (F.col("seq") == F.col("e_seq")))
    text = F.to_json(F.struct("event_type", "severity", "reason", "event_count", "trigger_rule", "related_rules", "event"))
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return rows.select("id", text.alias("request"))


def _cut(text, n: int):
    text = F.trim(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def parse_analysis(answers: DataFrame) -> DataFrame:
    """Rows (id, answer) with status completed or failed, the answer's parts, and the error of a failed one."""
    a = F.from_json("answer", _ANSWER)
    rows = answers.withColumn("a", a)
    low = lambda c: F.lower(F.trim(F.col(f"a.{c}")))
    error = (
        F.when(F.try_parse_json("answer").isNull() | ~F.trim("answer").startswith("{"), "answer is not JSON")
        .when(~F.coalesce(low("verdict").isin(VERDICTS), F.lit(False)), "invalid verdict")
        .when(~F.coalesce(low("confidence").isin(CONFIDENCES), F.lit(False)), "invalid confidence")
        .when(F.coalesce(F.trim(F.col("a.summary")), F.lit("")) == "", "summary is empty")
    )
    rows = rows.withColumn("error", error)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), fine(low("verdict")).alias("verdict"), fine(low("confidence")).alias("confidence"), fine(_cut(F.col("a.category"), SHORT)).alias("category"), fine(_cut(F.col("a.summary"), LONG)).alias("summary"), fine(_cut(F.col("a.recommended_action"), LONG)).alias("recommended_action"), "error")


def attach_analysis(alerts: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with their results by (ip, id), and the results that belong to no alert."""
    r = results.select(F.col("ip").alias("r_ip"), F.col("id").alias("r_id"), F.struct(*[c for c in results.columns if c not in ("ip", "id")]).alias("analysis"))
    on = (F.col("ip") == F.col("r_ip")) & (F.col("id") == F.col("r_id"))
    return alerts.join(r, on, "left").drop("r_ip", "r_id"), results.join(alerts.select(F.col("ip").alias("a_ip"), F.col("id").alias("a_id")), (F.col("ip") == F.col("a_ip")) & (F.col("id") == F.col("a_id")), "left_anti")


def analysis_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("provider", "status").agg(F.count("*").alias("count"))
