"""Tables of the library: events, alerts, connection snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_DDL = (
    "id string, seq long, timestamp timestamp, ip string, event_type string, user_agent string, path string, port int, status_code int, message string, "
    "metadata map<string,string>, dst_ip string, src_port int, protocol string, direction string, domain string"
)
ANALYSIS_DDL = "struct<status:string,verdict:string,confidence:string,category:string,summary:string,recommended_action:string,provider:string,model:string,error:string,analyzed_at:timestamp>"
ALERT_DDL = (
    "id string, seq long, timestamp timestamp, ip string, event_type string, severity string, reason string, event_count int, trigger_rule string, "
    f"related_rules array<string>, ai_analysis {ANALYSIS_DDL}"
)
SOCKET_DDL = "host string, snapshot_ts timestamp, proto string, local_ip string, local_port int, remote_ip string, remote_port int, state string, pid int, process string, uid string"

#: Severities in rising order.
SEVERITIES = ["low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    """1 for low to 4 for critical, 0 for anything else."""
    return F.coalesce(reduce(lambda c, s: c.when(severity == s[1], s[0]), enumerate(SEVERITIES[1:], 2), F.when(severity == SEVERITIES[0], 1)), F.lit(0))


def unset(column: Column) -> Column:
    """Empty text is an unset value."""
    return F.when(column != "", column)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Every source in one table of events; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
