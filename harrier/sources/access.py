"""Web access logs: combined and common text, and JSON with configurable fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions.fields import client_ip
from harrier.sources.lines import log_time, metadata, usable

#: Fixed value: address, user, time, request, status, size, and optionally referer and agent.
COMBINED = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "((?:[^"\\]|\\.)*)" (\d{3}) (\S+)(?: "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)")?'
#: Where each preset finds a field; | separates alternatives, dots lead into objects. The places of `user`,
#: and `time` as a further name of the time, are additions of this library.
PRESETS = {
    "json": {"time": "time_iso8601|time_local|msec|time", "ip": "remote_addr", "method": "request_method", "path": "request_uri", "status": "status", "user_agent": "http_user_agent", "host": "host", "user": "remote_user", "referer": "http_referer"},
    "caddy": {"time": "ts", "ip": "request.client_ip|request.remote_ip", "method": "request.method", "path": "request.uri", "status": "status", "user_agent": "request.headers.User-Agent", "host": "request.host", "user": "user_id", "referer": "request.headers.Referer"},
    "traefik": {"time": "StartUTC|time", "ip": "ClientHost|ClientAddr", "method": "RequestMethod", "path": "RequestPath", "status": "DownstreamStatus", "user_agent": "request_User-Agent", "host": "RequestHost", "user": "ClientUsername", "referer": "request_Referer"},
}


def unescape(text: Column) -> Column:
    r"""Quoted text with \xHH, \" and \\ undone."""
    guarded = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    coded = F.regexp_replace(guarded, r"\\x([0-9A-Fa-f]{2})", "%$1")
    plain = F.coalesce(F.try_url_decode(coded), text)
    return F.when(text.contains("\\"), F.regexp_replace(plain, r'\\(["\\])', "$1")).otherwise(text)


def _json(path: str) -> Column:
    """The first alternative that is set in `__j`, the line's top level; a key with dots in it comes before a path, an array gives its first element."""
    plain = lambda v: F.when(v.startswith("["), F.get_json_object(v, "$[0]")).otherwise(v)
    found = []
    for alternative in path.split("|"):
        first, *rest = alternative.split(".")
        values = [F.try_element_at("__j", F.lit(alternative))]
        if rest:
            values.append(F.get_json_object(F.try_element_at("__j", F.lit(first)), "$" + "".join(f"['{p}']" for p in rest)))
        found += [F.transform(F.array(plain(v)), lambda x: F.when((x != "") & ~x.startswith("{") & ~x.startswith("["), x))[0] for v in values]
    return F.coalesce(*found)


def _to_event(rows: DataFrame, r: dict[str, Column], source: str, bad: Column) -> DataFrame:
    dash = lambda c: F.when(~c.isin("-", ""), c)
    ip = client_ip(r["ip"])
    path, method = dash(r["path"]), dash(r["method"])
    return rows.withColumns(
        {
            "outcome": F.when(bad | ip.isNull(), "parse_error").otherwise("parsed"),
            "timestamp": log_time(r["time"]),
            "ip": ip,
            "event_type": F.lit("http_request"),
            "path": path,
            "status_code": r["status"].try_cast("int"),
            "user_agent": dash(r["user_agent"]),
            "message": F.when(method.isNotNull() | path.isNotNull(), F.concat_ws(" ", method, path)),
            "metadata": metadata(method=method, host=dash(r["host"]), user=dash(r["user"]), referer=dash(r["referer"]), source=F.lit(source)),
        }
    )


def parse_access_log(lines: DataFrame, preset: str = "combined", fields: dict[str, str] | None = None, source: str = "access") -> DataFrame:
    """Lines to events; `fields` replaces single places of a JSON preset. Lines without a client address are parse errors."""
    rows = usable(lines)
    if preset in ("combined", "common"):
        # one match a line: its groups, with the one character between them that no line of text holds
        rows = rows.withColumn("__p", F.when(F.col("value").rlike(COMBINED), F.split(F.regexp_replace("value", COMBINED + "(?s:.*)$", "\0".join(f"${i}" for i in (1, 2, 3, 4, 5, 7, 8))), "\0")))
        got = lambda i: F.nullif(F.get("__p", F.lit(i)), F.lit(""))
        rows = rows.withColumn("__words", F.split(unescape(got(3)), " ", 3))
        words, whole = F.col("__words"), F.size("__words") >= 2  # the protocol may be missing
        r = {"ip": got(0), "user": got(1), "time": got(2), "method": F.when(whole, words[0]), "path": F.when(whole, words[1]), "status": got(4), "referer": unescape(got(5)), "user_agent": unescape(got(6)), "host": F.lit(None).cast("string")}
        return _to_event(rows, r, source, F.col("__p").isNull()).drop("__p", "__words")
    places = PRESETS[preset] | (fields or {})
    # a line is parsed once; its fields are then read from what that gave
    rows = rows.withColumn("__j", F.from_json("value", "map<string,string>")).withColumn("__f", F.struct(*[_json(v).alias(k) for k, v in places.items()]))
    r = {k: F.col("__f")[k] for k in places}
    bad = F.col("__j").isNull() | (F.size("__j") == 0) | ~F.trim("value").startswith("{") | r["ip"].isNull()
    return _to_event(rows, r, source, bad).drop("__j", "__f")


def reclassify_failed_login(events: DataFrame, paths: list[str], status_codes: tuple[int, ...] = (401,)) -> DataFrame:
    """Requests to a login path that the server refused become failed_login."""
    plain = lambda p: p.lower().split("?")[0].removesuffix("/") or "/"
    path = F.regexp_replace(F.lower(F.substring_index("path", "?", 1)), "(?<=.)/$", "")
    hit = path.isin([plain(p) for p in paths]) & F.col("status_code").isin(list(status_codes))
    return events.withColumn("event_type", F.when(F.coalesce(hit, F.lit(False)), "failed_login").otherwise(F.col("event_type")))
