"""Column helpers for event fields: addresses, domains, decoded variants, durations, texts."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ["id", "ip", "event_type", "user_agent", "path", "port", "status_code", "message", "dst_ip", "src_port", "protocol", "direction", "domain"]
_NUMBERS = {"port", "status_code", "src_port"}
#: Second levels under which a two-letter country domain registers names.
SECOND_LEVELS = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go"]
_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "d": 86_400_000_000}
_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def micros(duration: str) -> int:
    """Microseconds of a duration such as 1m, 1h30m or 250ms; d stands for days."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|[dhms])", duration)
    if not parts or "".join(a + b for a, b in parts) != duration:
        raise ValueError(f"invalid duration {duration!r}")
    return round(sum(float(a) * _UNITS[b] for a, b in parts))


def duration_text(us: int) -> str:
    """Such as 1m0s, 30s, 2h0m0s."""
    seconds = us / 1e6
    h, m, s = int(seconds // 3600), int(seconds % 3600 // 60), seconds % 60
    tail = f"{s:g}s"
    return f"{h}h{m}m{tail}" if h else f"{m}m{tail}" if m else tail


def duration_column(us: Column) -> Column:
    """duration_text for a column, rounded to seconds."""
    s = F.bround(us / 1e6).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    tail = F.concat(r.cast("string"), F.lit("s"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), tail)).when(m > 0, F.concat(m.cast("string"), F.lit("m"), tail)).otherwise(tail)


def field(name: str) -> Column:
    """A field's value as text, null where it is unset; metadata.<key> reads the metadata."""
    if name.startswith("metadata."):
        value = F.try_element_at(F.col("metadata"), F.lit(name.removeprefix("metadata.")))
    elif name in FIELDS:
        value = F.nullif(F.col(name), F.lit(0)).cast("string") if name in _NUMBERS else F.col(name)
    else:
        raise ValueError(f"unknown field {name!r}")
    return F.when(value != "", value)


_V6 = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def _canonical_v6(text: Column) -> Column:
    """Lower case, no zone, groups without leading zeros, the longest run of two or more zero groups (the first of such) as ::, a mapped IPv4 address as such; null if it is none."""
    plain = F.lower(F.substring_index(text, "%", 1))
    # dotted digits at the end stand for two groups
    octet = lambda i: F.regexp_extract(plain, r"^.*:(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    dotted = plain.rlike(r":" + _V4.removeprefix("^"))
    two = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
    plain = F.when(dotted, F.concat(F.regexp_extract(plain, r"^(.*:)[\d.]+$", 1), two(1), F.lit(":"), two(3))).otherwise(plain)

    def expanded(t: Column) -> Column:
        halves = F.split(t, "::")
        left, right = _groups(halves[0]), F.coalesce(_groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        fine = t.rlike(_V6) & F.when(t.contains("::"), n <= 7).otherwise(n == 8)
        return F.when(fine, F.array_join(F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))

    def shortened(t: Column) -> Column:
        edged = F.concat(F.lit(":"), t, F.lit(":"))
        out = edged
        for n in range(2, 9):
            run = ":0" * n + ":"
            out = F.when(edged.contains(run), F.regexp_replace(edged, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    def named(t: Column) -> Column:
        parts = F.split(t, ":")
        number = lambda i: F.conv(F.get(parts, F.lit(i)), 16, 10).cast("int")
        byte = lambda i, high: (F.shiftright(number(i), 8) if high else F.pmod(number(i), F.lit(256))).cast("string")
        v4 = F.concat_ws(".", byte(6, True), byte(6, False), byte(7, True), byte(7, False))
        return F.when(t.startswith("0:0:0:0:0:ffff:"), v4).when(t.isNotNull(), shortened(t))

    return _let(expanded(plain), named)


def normalize_ip(text: Column) -> Column:
    """The canonical address, null if there is none."""
    text = F.trim(text)
    return F.when(text.rlike(_V4), text).when(text.contains(":"), _canonical_v6(text))


def client_ip(text: Column) -> Column:
    """The canonical address of address, address:port or [address]:port; null if there is none."""
    text = F.trim(text)
    bare = F.when(text.rlike(r"^\[.*\](:\d+)?$"), F.regexp_extract(text, r"^\[(.*)\]", 1)).when(text.rlike(r"^[^:]+:\d+$"), F.substring_index(text, ":", 1)).otherwise(text)
    return normalize_ip(bare)


def ip_hex(ip: Column) -> Column:
    """A canonical IPv4 address as 8 hexadecimal digits, an IPv6 one as 32; they sort like the addresses."""
    parts = F.split(ip, r"\.")
    v4 = F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0")), "")
    halves = F.split(ip, "::")
    wide = lambda g: F.lpad(g, 4, "0")
    left, right = _groups(halves[0]), F.coalesce(_groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    v6 = F.array_join(F.transform(F.concat(left, gap, right), wide), "")
    return F.when(ip.contains(":"), v6).when(ip.rlike(_V4), v4)


def in_cidr(hexed: Column, cidr: str) -> Column:
    """Whether an address (as ip_hex gives it) lies in a network: a comparison of texts that scans can push down."""
    net = ipaddress.ip_network(cidr, strict=False)
    n = 8 if net.version == 4 else 32
    low, high = (f"{int(x):0{n}x}" for x in (net.network_address, net.broadcast_address))
    return F.coalesce((F.length(hexed) == n) & hexed.between(low, high), F.lit(False))


def network_key(hexed: Column, bits: Column) -> Column:
    """The first bits of an address (as ip_hex gives it), with their number and the kind of address: equal for all addresses of a network."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.coalesce(F.conv(F.substring(hexed, whole + 1, F.lit(1)), 16, 2), F.lit(""))
    return F.concat_ws("/", F.length(hexed), bits, F.concat(F.substring(hexed, F.lit(1), whole), F.lit("-"), F.substring(F.lpad(digit, 4, "0"), F.lit(1), rest)))


def base_domain(domain: Column) -> Column:
    """The registrable part: two labels, three below a country's usual second level."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    country = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(SECOND_LEVELS)
    keep = F.when(n < 2, n).when((n >= 3) & country, 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(keep, n), keep), ".")


def _decoded(text: Column) -> Column:
    """Percent and plus decoding that never fails: signs that start no escape stay."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.rlike("[%+]"), F.try_url_decode(safe)).otherwise(text)


def decoded_variants(text: Column) -> Column:
    """The lower-cased text as it is, decoded once and decoded twice, without repeats."""
    once = F.coalesce(_decoded(text), text)
    return F.array_distinct(F.array(F.lower(text), F.lower(once), F.lower(F.coalesce(_decoded(once), once))))


def event_detail() -> Column:
    """Method and path, path, domain or message, whichever there is first."""
    method = field("metadata.method")
    return F.coalesce(F.when(field("path").isNotNull(), F.concat_ws(" ", method, field("path"))), field("domain"), field("message"))


def destination() -> Column:
    """ip:port, [v6]:port, the address alone or :port."""
    ip, port = field("dst_ip"), field("port")
    host = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    return F.when(ip.isNotNull() & port.isNotNull(), F.concat(host, F.lit(":"), port)).when(ip.isNotNull(), ip).when(port.isNotNull(), F.concat(F.lit(":"), port))


def metadata_text() -> Column:
    """Metadata as sorted k=v pairs."""
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, " ")


def render(template: str, values: dict[str, Column]) -> Column:
    """A text with its {name} places filled in one pass; {event.<field>} reads the event, an unknown name stays as it is."""
    parts = re.split(r"(\{[a-z_.0-9A-Z-]+\})", template)

    def part(text: str) -> Column:
        name = text[1:-1] if text.startswith("{") and text.endswith("}") else None
        if name and name.startswith("event."):
            return F.coalesce(field(name.removeprefix("event.")), F.lit(""))
        return F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(text)

    return F.concat(*[part(p) for p in parts if p] or [F.lit("")])
